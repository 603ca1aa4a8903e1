"""Which part of a page is its main content."""

import pytest

from webloom.html import page as p
from webloom.html.readable import CLEAN, STRIP, WEIGH, blocks, link_share, main_node, readable, scores
from webloom.html.tree import parse

PROSE = "The river rose for three days, and on the fourth, when the rain had stopped, the people of the lower town came back to look for what it had left. "
LINKS = "".join(f"<li><a href='/{i}'>Another headline, quite long, about something else {i}</a></li>" for i in range(30))


def text(html):
    got = readable(parse(html))
    return got.text() if got is not None else None


def para(n, mark):
    return "".join(f"<p>{mark}{i} {PROSE}</p>" for i in range(n))


def test_prose_beats_longer_lists_of_links():
    got = text(f"<body><div id=a><ul>{LINKS}</ul></div><div id=b>{para(5, 'm')}</div><div id=c><p>short</p></div></body>")
    assert "m0" in got and "m4" in got and "headline" not in got and "short" not in got


def test_unlikely_names_go_unless_little_is_left():
    got = text(f"<body><div class='sidebar'>{para(9, 's')}</div><div>{para(5, 'm')}</div></body>")
    assert "s0" not in got and "m0" in got
    assert "s0" in text(f"<body><div class='sidebar'>{para(9, 's')}</div><div><p>Nothing, really.</p></div></body>")


def test_class_weights_decide_between_equals():
    assert "m0" in text(f"<body><div class=promo>{para(4, 's')}</div><div class=article>{para(4, 'm')}</div></body>")
    assert "s0" not in text(f"<body><div><div class=promo>{para(4, 's')}</div></div><div><div class=article>{para(4, 'm')}</div></div></body>")


def test_siblings_that_read_like_prose_are_joined():
    got = text(f"<body><div><p>Lead, {PROSE}</p><div class=x>{para(6, 'm')}</div><div class=x>{para(2, 'n')}</div><p>See it.</p><p><a href=/>Only a link</a></p></div></body>")
    assert "Lead" in got and "n0" in got and "See it." in got and "Only a link" not in got


def test_scores_are_carried_up_with_decay():
    doc = parse(f"<body><section><div id=o><div id=i><p>{PROSE}</p></div></div></section></body>")
    by = {e.attrs.get("id") or e.tag: s for e, s in scores(doc.first("body"), 0).values()}
    points = 2 + PROSE.count(",") + 1
    # the section is a text block too, so the body gets its points besides
    assert by["i"] == 5 + points and by["o"] == 5 + points / 2 and by["section"] == points / 6 and by["body"] == points / 9 + points


def test_a_common_ancestor_of_good_candidates():
    parts = "".join(f"<div class=part><div>{para(2, f'q{k}x')}</div></div>" for k in range(5))
    top, _ = main_node(parse(f"<body><div id=all>{parts}</div><div>{para(1, 'z')}</div></body>").first("body"), STRIP | WEIGH | CLEAN)
    assert top.attrs.get("id") == "all"


def test_furniture_inside_is_cleaned():
    got = text(f"<body><article>{para(5, 'm')}<div class=share><a href=/>Share</a></div><form><input><input></form><aside>{para(1, 'a')}</aside><ul><li>kept item</li></ul><div><a href=/x>more, more</a> <a href=/y>again</a></div></article></body>")
    assert "m4" in got and "kept item" in got and "Share" not in got and "a0" not in got and "again" not in got


@pytest.mark.parametrize("html", ["", "<body></body>", "<script>x</script>", "<!-- c -->"])
def test_pages_without_text(html):
    assert text(html) is None


def test_divisions_without_blocks_count_as_paragraphs():
    doc = parse(f"<body><div id=a>{PROSE}<br>{PROSE}</div><div id=b><p>{PROSE}</p></div></body>")
    assert [e.tag for e in blocks(doc.first("body"))] == ["div", "p"]
    assert link_share(parse("<body><p>ab<a href=/>cd</a><a href='#x'>efghij</a></p></body>").first("p")) == (2 + 0.3 * 6) / 10


def test_the_fallback_of_a_page_whose_selectors_leave_little():
    html = f"<html><body><div class=header><ul>{LINKS}</ul></div><div class='header'><div class=story>{para(5, 'm')}</div></div></body></html>"
    md = p.scrape(html, "https://x.example/")["markdown"]
    assert "m0" in md and "m4" in md and "headline" not in md
    # an unreadable page gives its whole body
    assert "Another headline" in p.scrape(f"<body><div class=nav><ul>{LINKS}</ul></div></body>", "https://x.example/")["markdown"]


def test_deep_trees_and_long_texts():
    assert "m1" in text("<div>" * 350 + para(5, "m") + "</div>" * 350)
    assert len(text(f"<body><div>{para(3000, 'm')}</div></body>")) > 400_000
