"""Many selectors in one traversal against each by itself."""

import random
import time

from webloom.html import page as p
from webloom.html.select import Matcher, compile_selector, select
from webloom.html.tree import parse

PARTS = ["div", "p", "a", "*", ".x", ".y", "#i", "#j", "div.x", "p.y#i", "[href]", "[class~=x]", "a[href^='/']", ":first-child", "p:last-of-type", ":not(.x)", "li:nth-child(2n+1)", ":has(> a)", "div:not(:has(p))", ":is(.x, #j)", "span:empty", ":root", "body"]


def page(rng):
    def node(depth):
        tag = rng.choice(["div", "p", "a", "span", "ul", "li"])
        attrs = "".join(rng.choice(["", "", f" {a}"]) for a in ("class=x", "class='x y'", "class=y", "id=i", "id=j", "href=/a"))
        return f"<{tag}{attrs}>" + "".join(node(depth - 1) if rng.random() < 0.7 else "t " for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{tag}>"

    return "<html><body>" + "".join(node(4) for _ in range(4)) + "</body></html>"


def chain(rng):
    out = rng.choice(PARTS)
    for _ in range(rng.randint(0, 3)):
        out += rng.choice([" ", " > ", " + ", " ~ "]) + rng.choice(PARTS)
    return out


def test_equals_each_alone():
    rng = random.Random(4)
    for _ in range(60):
        doc = parse(page(rng))
        selectors = [", ".join(chain(rng) for _ in range(rng.randint(1, 3))) for _ in range(25)]
        found = Matcher(selectors).over(doc)
        scopes = [doc, *rng.sample(list(doc.walk()), 5)]
        for s in selectors:
            for scope in scopes:
                assert list(map(id, found.of(s, scope))) == list(map(id, select(scope, s))), s
                assert list(map(id, found.of(s, scope, 2))) == list(map(id, select(scope, s, 2)))


def test_no_selectors_and_no_elements():
    assert Matcher([]).over(parse("<p>x</p>")).found == {}
    assert compile_selector("p")


def test_schema_rows_are_the_same():
    html = "<base href=/b/><div class=r><h2>A</h2><a href=1>x</a><i>1</i><i>2</i></div><div class=r><h2>B</h2></div><div class=q><a href=9>z</a></div>"
    schema = {"rows": {"selector": "div.r", "all": True, "fields": {"t": "h2", "u": {"selector": "a", "attr": "href"}, "n": {"selector": "i", "all": True}, "up": "div.q a"}}, "first": "a", "bad": "div[", "none": ".no", "deep": {"selector": "body", "fields": {"q": {"selector": "div.q", "fields": {"z": {"selector": "a", "attr": "html"}}}}}}
    got, warnings = p.extract_schema(html, "https://s.example/", schema)
    assert got == {"rows": [{"t": "A", "u": "https://s.example/b/1", "n": ["1", "2"], "up": None}, {"t": "B", "u": None, "n": [], "up": None}], "first": "x", "bad": None, "none": None, "deep": {"q": {"z": "z"}}}
    assert warnings == ["field 'bad': invalid selector 'div['"]


def test_many_fields_cost_about_as_much_as_one():
    doc = parse("<body>" + "<div class=a><ul><li><a href=/x>t</a></li></ul></div>" * 4000 + "</body>")

    def took(selectors):
        m, best = Matcher(selectors), 9.0
        for _ in range(3):
            t = time.perf_counter()
            m.over(doc)
            best = min(best, time.perf_counter() - t)
        return best

    many = [f"div.c{i} > ul li.k{i % 7} a" for i in range(50)]
    assert took(many) < 4 * took(many[:1])
