import random

import pytest

from webloom.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h2>Site</h2><p>Slogan of the site</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News {i}</a></ul></nav><!-- <p>hidden</p> -->
<div class="layout"><div class="sidebar"><p>Side text {i} that is rather long for a side bar of any page at all</p></div>
{open}<h1>Title &amp; more {i}</h1>{body}<div class="ad">Buy {i} now</div>{close}
<section id="comments"><h3>Comments</h3><p>Reader {i} says a great many words here, as readers always do on pages</p></section>
<form><label>Name</label><input><textarea>typed</textarea><button>Send</button></form></div>
<footer>&copy; site</footer>{end}"""


def page(i, rng, style):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    blocks = [words(rng.randint(12, 40)) + f" {i}" for _ in range(rng.randint(2, 7))]
    body = "".join(f"<p>{b}" if k % 2 else f"<p><b>{b[:5]}</b>{b[5:]}<br></p>\n" for k, b in enumerate(blocks))
    if i % 3 == 0:
        body += "<ul><li>first point<li>second\n\t point</ul>"
        blocks += ["first point", "second point"]
    around = {"article": ("<article>", "</article>"), "main": ('<main><div class="post-12">', "</div></main>"), "div": ('<div id="content">', "</div>")}[style]
    html = PAGE.format(i=i, body=body, open=around[0], close=around[1], end="</body></html>" if i % 2 else "")
    return html, "\n".join([f"Title & more {i}", *blocks])


@pytest.mark.parametrize("style", ["article", "main", "div"])
def test_main_text(spark, style):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        html, text = page(i, rng, style)
        rows.append((i, f"https://Host{i % 3}.example/{i}", html, "clash"))
        want[i] = text
    got = {r.page_id: r for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_constant_text_in_the_main_group_is_template():
    pages = [f"<body><article><div><a href=/app>Read it on our app, the best of apps</a></div><p>Text {i} {'word ' * (20 + i)}</p></article></body>" for i in range(6)]
    tree = w.fold(w.parse(pages[0]))
    for p in pages[1:]:
        w.merge_into(tree, w.fold(w.parse(p)))
    assert "app" not in w.Reader(tree).main_text(w.parse(pages[2]))
    assert w.regex(tree) == "<#root><body><article><div>text</div><p>#</p></article></body></#root>"


def test_alignment_finds_optional_and_repeated_groups():
    tree = w.fold(w.parse("<body><p>a</p><p>b</p><h1>x</h1></body>"))
    w.merge_into(tree, w.fold(w.parse("<body><div>n</div><p>c</p></body>")))
    assert w.regex(tree) == "<#root><body>(<div>text</div>)?(<p>#</p>)+(<h1>text</h1>)?</body></#root>"


def test_any_split_of_a_host_gives_the_same_main_group():
    rng = random.Random(2)
    trees = [page(i, rng, "div")[0] for i in range(12)]
    whole = w.fold(w.parse(trees[0]))
    for t in trees[1:]:
        w.merge_into(whole, w.fold(w.parse(t)))
    halves = [w.fold(w.parse(trees[0])), w.fold(w.parse(trees[6]))]
    for k, t in enumerate(trees):
        if k not in (0, 6):
            w.merge_into(halves[k // 6], w.fold(w.parse(t)))
    w.merge_into(*halves)
    assert w.main_path(halves[0]) == w.main_path(whole) and halves[0][w.PAGES] == whole[w.PAGES] == 12


def test_odd_rows(spark):
    rows = [(1, None, "<p>no url</p>"), (2, "http://h/", None), (3, "http://h/", ""), (4, "x", "plain text &lt; no tags"), (5, "http://h/", "<p>open <b>bold"), (5, "http://h/", "<p>open <b>bold"),
            (6, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "http://g/", "<p>" + "long " * 200000), (8, "http://q/", "</p></div><<>< & <p>a<p>b &eacute;&#x41;&nbsp;c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in w.extract(df).collect()), key=repr)
    want = [(1, "no url"), (2, ""), (3, ""), (4, "plain text < no tags"), (5, "open bold"), (5, "open bold"), (6, "deep"), (None, ("long " * 200000).strip())]
    assert [g for g in got if g[0] != 8] == sorted(want, key=repr)
    assert next(t for i, t in got if i == 8).endswith("a\nb éA c")
    assert w.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "raw",
    ["<script>for(i=0;i<n;i++){x()}</script>", "<SCRIPT>if(a<b && c>d){y('<p>')}</Script >", "<style>a::after{content:'<b'}</style>", "<textarea><x y='</textarea>", "<title>a <b</title>", "<script><!-- if(a<b) </script>", "<template><script>a<b;'</script></template>"],
)
def test_content_of_raw_elements_is_no_markup(raw):
    assert w.parse(f"{raw}<article><p>Text</p></article>") == ["#root", ["article", ["p", ("Text", 0)]]]
    assert w.parse("<p>a</p><script>b<c") == ["#root", ["p", ("a", 0)]]


def texts(pages):
    """The main texts of one host's pages."""
    tree = w.fold(w.parse(pages[0]))
    for p in pages[1:]:
        w.merge_into(tree, w.fold(w.parse(p)))
    reader = w.Reader(tree)
    return [reader.main_text(w.parse(p)) for p in pages]


def article(i, more="", before=""):
    return f"<body><article>{before}<h1>Title {i}</h1><p>Text {i} {'word ' * (20 + i)}</p>{more}</article></body>"


def test_equal_neighbours_of_one_page_are_kept():
    page = article(1, "<ul>" + "<li>same</li>" * 5 + "</ul><table><tr>" + "<td>7</td>" * 5 + "</tr></table>")
    assert texts([page])[0].split("\n")[2:] == ["same"] * 5 + ["7"] * 5
    pages = [article(i, "<ul>" + "<li>same</li>" * 2 + "</ul>" if i == 1 else "") for i in range(8)]
    assert texts(pages)[1].split("\n")[2:] == ["same"] * 2


def test_texts_of_copies_are_kept():
    copy = article(50, "<blockquote>Quote</blockquote><table><tr><td>cell</td></tr></table>")
    assert all(t.endswith("Quote\ncell") for t in texts([copy] * 5 + [article(i) for i in range(5)])[:5])
    assert all(t.endswith("Quote\ncell") for t in texts([copy] * 5 + [article(1, "<blockquote>Quote</blockquote><table><tr><td>cell</td></tr></table>")]))


def test_a_template_text_is_dropped_in_its_place_only():
    note = "<div><a href=/app>Read it on our app</a></div>"
    got = texts([article(i, note if i == 3 else "<p>Read it on our app</p>" if i == 4 else "", note) for i in range(6)])
    assert [t.count("Read it on our app") for t in got] == [0, 0, 0, 1, 1, 0]
    assert [t.split("\n")[0] for t in got] == [f"Title {i}" for i in range(6)]


def test_empty_pages_do_not_hide_a_template_text(spark):
    note = "<div><a href=/app>Read it on our app</a></div>"
    rows = [(i, "https://h/", article(i, before=note)) for i in range(6)] + [(7, "https://h/", None), (8, "https://h/", ""), (9, "https://g/", None)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == got[8] == got[9] == "" and got[0].startswith("Title 0")


def alone(page):
    return texts([page])[0]


def test_the_wrapper_finds_what_a_page_alone_does_not_show():
    """Without names or article elements, the longest text of a page is its template's; the other pages tell."""
    about = "This site has been telling you all about everything since its very first day, and goes on doing so for all of you. " * 6
    pages = [f"<body><div class=x><div><p>{about}</p></div></div><div class=y><h2>Title {i}</h2><p>Text {i} of {'some ' * (5 + i)}words</p><p>More {i}</p></div></body>" for i in range(3)]
    want = [f"Title {i}\nText {i} of {'some ' * (5 + i)}words\nMore {i}" for i in range(3)]
    assert alone(pages[0]) == about.strip()
    assert texts(pages) == want
    assert texts([pages[0]] * 5)[0] == about.strip()  # copies show nothing
    assert texts([pages[0]] * 5 + [pages[1]])[0] == want[0]


def test_copies_with_other_dates_show_no_template():
    pages = [f"<body><div><h2>Title</h2><p>{'A paragraph of the text. ' * 9}</p><p>{i} March 2024, {i * 7} views</p></div></body>" for i in range(4)]
    assert all(t.startswith("Title\nA paragraph") for t in texts(pages))
    pages = [f"<body><div>{c} news of today</div><article><h2>Title</h2><p>{'A paragraph. ' * 9}</p></article></body>" for c in ("red", "green", "blue")]
    assert all(t.startswith("Title\nA paragraph") for t in texts(pages))


def test_a_page_of_another_shape_is_read_less_the_template():
    about = "<div class=x><p>" + "Words of the template that are on all pages of the site. " * 9 + "</p></div>"
    pages = [f"<body>{about}<div class=y><p>Text of some {c} words</p></div></body>" for c in ("red", "green", "blue", "white")]
    odd = f"<body>{about}<section><p>Quite another shape here</p></section></body>"
    assert texts([*pages, odd])[4] == "Quite another shape here"


def test_constant_titles_and_texts_in_an_article_are_kept():
    for n in (1, 2, 4, 6, 40):
        pages = [f"<article><h1>Daily report</h1><p>unique {i}</p><p>The end.</p></article>" for i in range(n)]
        assert texts(pages) == [f"Daily report\nunique {i}\nThe end." for i in range(n)]


def test_words_that_an_article_shares_with_others_are_kept():
    for n in (1, 2, 3, 8):
        pages = [article(i, "<div>Thank you.</div>", "<div>Dear readers,</div>") for i in range(n)]
        assert all(t.startswith("Dear readers,\nTitle") and t.endswith("\nThank you.") for t in texts(pages))


@pytest.mark.parametrize("name", ['class="notice-of-award"', 'class="related-work"', 'id="social-history"', 'class="login-theory"', 'class="nav-mesh x"'])
def test_names_that_hold_a_word_of_chrome_are_kept(name):
    for n in (1, 3):
        assert [t.split("\n")[2:] for t in texts([article(i, f"<section {name}><p>Part {i}</p></section>") for i in range(n)])] == [[f"Part {i}"] for i in range(n)]


@pytest.mark.parametrize("name", ['class="related-posts"', 'id="share-buttons"', 'class="cookie-notice"', 'class="social_share-box y"', 'class="comments"'])
def test_names_of_chrome_go(name):
    assert "Part" not in alone(article(1, f"<section {name}><p>Part</p></section>"))


def test_lists_of_links_without_an_article_element():
    refs = "<ul><li><a href=/1>First reference</a><li><a href=/2>Second reference</a></ul>"
    menu = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul>"
    page = lambda i: f"<body><div><h1>Title {i}</h1><p>{'Text of the page. ' * 9}{i}</p>{refs.replace('reference', f'reference {i}')}</div></body>"
    assert alone(page(1)).endswith("First reference 1\nSecond reference 1")
    assert [t.split("\n")[-1] for t in texts([page(i) for i in range(4)])] == [f"Second reference {i}" for i in range(4)]
    assert "Home" not in alone(f"<body><div>{menu}<p>{'Text of the page. ' * 9}</p></div></body>")


def test_formulas_are_text():
    assert alone("<article><p>x is</p><math><mi>a</mi><mo>+</mo><mn>1</mn></math><p>here</p></article>").split("\n") == ["x is", "a+1", "here"]


def test_lists_of_links_in_an_article_are_kept():
    refs = "<ul>" + "".join(f"<li><a href=/{k}>Reference number {k}</a>" for k in range(4)) + "</ul>"
    assert alone(article(1, refs)).split("\n")[2:] == [f"Reference number {k}" for k in range(4)]


def test_groups_whose_name_may_mean_chrome():
    legal = [article(i, f'<section class="legal"><p>Clause {i}</p></section>') for i in range(3)]
    assert alone(legal[0]).endswith("Clause 0") and [t[-8:] for t in texts(legal)] == [f"Clause {i}" for i in range(3)]
    same = [article(i, '<section class="legal"><p>All rights reserved</p></section>') for i in range(3)]
    assert not any("rights" in t for t in texts(same))
    assert "Buy" not in alone(article(1, '<div class="ad"><p>Buy</p></div>'))


@pytest.mark.parametrize("tag", ["noscript", "svg", "button", "select", "template", "object", "video", "textarea", "title", "iframe"])
def test_elements_without_an_end_do_not_hide_the_rest(tag):
    assert "rest of page" in alone(f"<body><article><p>start of page</p><{tag}><p>rest of page</p></article></body>")
    assert alone(f"<body><article><p>a</p><{tag}>hidden</{tag}><p>b</p></article></body>") == "a\nb"
    assert len(alone("<article>" + f"<{tag}><p>x</p>" * 5000)) == 9999


def test_nested_elements_end_with_the_outer_one():
    assert alone("<article><p>a</p><svg><svg><text>x</text></svg><text>y</text></svg><p>b</p></article>") == "a\nb"


def test_alignment_of_long_lists_is_longest(monkeypatch):
    rng = random.Random(3)

    def longest(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j], best[j + 1])
        return best[-1]

    for kept in (1 << 24, 64, 1):
        monkeypatch.setattr(w, "KEPT_BYTES", kept)
        for _ in range(60):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(2))
            got = w.pairing([[x] for x in a], [[x] for x in b])
            assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))
            both = [(i, j) for i, j in got if i is not None and j is not None]
            assert all(a[i] == b[j] for i, j in both) and len(both) == longest(a, b)


def test_partial_wrappers_merge_in_a_tree(spark):
    rng = random.Random(5)
    rows = [(i, "https://h/", page(i, rng, "div")) for i in range(30)]
    df = w.with_host(spark.createDataFrame([(i, u, h) for i, u, (h, _) in rows], "page_id long, url string, html string")).repartition(15)
    [got] = w.infer(df, fan=3).collect()
    reader = w.Reader(w.json.loads(got.wrapper))
    assert reader.w[w.PAGES] == 30 and all(reader.main_text(w.parse(h)) == t for _, _, (h, t) in rows)


def test_a_wrapper_beyond_its_bound_keeps_the_text():
    rng = random.Random(6)
    pages = ["<body><article>" + "".join(f"<p class=c{rng.choice('abcdefgh') * rng.randint(1, 9)}>text {i} {k}</p><h2>t</h2>" for k in range(60)) + "</article></body>" for i in range(10)]
    tree = w.fold(w.parse(pages[0]))
    for p in pages[1:]:
        w.merge_into(tree, w.fold(w.parse(p)))
        w.prune(tree, 50)
    assert w.count(tree) <= 400
    assert all(w.Reader(tree).main_text(w.parse(p)).count("text") == 60 for p in pages)
