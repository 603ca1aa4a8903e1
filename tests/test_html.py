import pytest

from webloom.html import page as p
from webloom.html.select import SelectorError, compile_selector, select
from webloom.html.tree import inner, parse

URL = "https://s.example/d/page"


def md(html, **kw):
    return p.scrape(html, URL, only_main=False, **kw)["markdown"]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<h2>A <em>b</em></h2>", "## A _b_"),
        ("<p>a<br>b", "a  \nb"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<pre><code class='lang-js x'>let a;\n</code></pre>", "```js\nlet a;\n```"),
        ("<pre class='hljs rust'>fn</pre>", "```rust\nfn\n```"),
        ("<table><tr><th>h<th>i</tr><tr><td>1|2<td>3</table>", "| h | i |\n| --- | --- |\n| 1\\|2 | 3 |"),
        ("<p><strong> a </strong>b <s></s><del>c</del>", "**a** b ~~c~~"),
        ("<a href='/x'>t</a> <a href='//c.example/y'>u</a> <a href='#f'>v</a>", "[t](https://s.example/x) [u](https://c.example/y) [v](#f)"),
        ("<img alt=i src='data:image/png;base64,AA'>", "![i](<Base64-Image-Removed>)"),
        ("<img srcset='s.png 1x, l.png 3x' src='o.png'>", "![](https://s.example/d/l.png)"),
        ("<p>x</p><a href='#m'>Skip to Content</a><p>y</p>", "x\n\ny"),
        ("<blockquote><p>q</p></blockquote><hr>", "> q\n\n* * *"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><noscript>n</noscript><svg><text>s</text></svg><p>ok", "ok"),
        ("<p><b>bold<br><p>next", "**bold**\n\nnext"),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


def test_main_content_and_fallbacks():
    body = "<nav>menu</nav><div class='sidebar'>side</div><article>" + "<p>word, and more words of the text</p>" * 12 + "</article><footer>f</footer>"
    got = p.scrape(body, URL)["markdown"]
    assert "menu" not in got and "side" not in got and got.count("word,") == 12
    assert p.scrape("<header>only a header</header>", URL)["markdown"] == "only a header"
    assert p.scrape("<header><div id='main'>kept</div></header>", URL)["markdown"] == "kept"


def test_skeletons_and_json():
    got = p.scrape("<p>Loading...</p><p>Please wait</p><h1>loading</h1><p>text</p>", URL, only_main=False)
    assert got["incomplete"] and got["markdown"] == "\n\ntext"  # lines go, and what is left is not trimmed again
    assert p.scrape('{"a":[1]}', URL, content_type="application/ld+json; x")["markdown"] == '{\n  "a": [\n    1\n  ]\n}'
    assert p.scrape(" {bad ", URL, content_type="application/json")["markdown"] == "{bad"
    assert p.scrape(None, None)["markdown"] == ""


def test_metadata():
    html = """<html lang=" en "><head><meta property="og:title" content=" O "><meta name="og:title" content="N"><meta property="og:locale:alternate" content="de"><meta property="og:locale:alternate" content="fr">
    <meta name="x" content="1"><meta name="x" content="2"><meta itemprop="k" content="v"><link rel="shortcut icon" href="/f.ico"><link rel="Canonical" href="/c"></head><base href="/other/"></html>"""
    m = p.scrape(html, URL, 404, "text/html")["metadata"]
    assert m["title"] == m["ogTitle"] == "O" and m["language"] == "en" and m["ogLocaleAlternate"] == ["de", "fr"] and m["x"] == "1" and m["k"] == "v"
    assert m["favicon"] == "https://s.example/f.ico" and m["canonical"] == "https://s.example/c" and m["statusCode"] == 404


def test_links_follow_base_and_are_distinct():
    html = "<base href='/b/'><a href=' x '>1</a><a href='x'>2</a><a href='#a'>3</a><a href='mailto:a@b'>4</a><a href='JavaScript:1'>5</a><a href='y#z'>6</a>"
    assert p.links(parse(html), URL) == ["https://s.example/b/x", "https://s.example/b/y#z"]


def test_tag_filters_keep_selector_order():
    html = "<div id=a><p>1</p></div><p>2</p><b>3</b>"
    assert p.filter_tags(html, ["b", "p", "#a"], ["none["]) == "<b>3</b><p>2</p><div id=\"a\"><p>1</p></div>"
    assert p.filter_tags(html, [], ["p"]) == '<div id="a"></div><b>3</b>'


def test_selector_schema():
    html = "<h1> A  b </h1>" + "".join(f"<div class='card'><i class='n'>{i}</i>" + (f"<a href='/p{i}'>l</a>" if i < 2 else "") + "</div>" for i in range(3))
    schema = {"t": "h1", "cards": {"selector": ".card", "all": True, "fields": {"n": ".n", "u": {"selector": "a", "attr": "href"}}}, "us": {"selector": ".card a", "all": True, "attr": "href"}, "no": "h4", "nos": {"selector": "h4", "all": True}, "bad": "a[", "odd": 3}
    got, warnings = p.extract_schema(html, URL, schema)
    assert got["t"] == "A b" and got["no"] is None and got["nos"] == [] and got["bad"] is None and len(warnings) == 2
    assert got["cards"][2] == {"n": "2", "u": None} and got["us"] == ["https://s.example/p0", "https://s.example/p1"]
    deep: dict = {"selector": "div", "fields": {"x": "p"}}
    for _ in range(7):
        deep = {"selector": "div", "fields": {"x": deep}}
    assert any("deeper" in w for w in p.extract_schema("<div>" * 9, URL, {"d": deep})[1])
    assert p.schema_type(schema).startswith("struct<`t`:string,`cards`:array<struct<`n`:string,`u`:string>>")


def test_embedded_state():
    assert p.embedded_state('<script id="__NEXT_DATA__">{"a":1}</script><script type="application/ld+json">{}</script>') == ("next_data", {"a": 1})
    assert p.embedded_state('<script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{x</script>') == ("json_ld", [{"a": 1}])
    assert p.embedded_state('<script>window.__NUXT__ = {"a": "}\\"{"};x()</script>') == ("nuxt", {"a": '}"{'})
    assert p.embedded_state("<script>window.__NUXT__ = (function(){})()</script>") is None
    assert p.relaxed_json("<!-- {\"a\": [1]} -->") == {"a": [1]}


def test_selectors():
    doc = parse("<div id=x class='a b'><p data-k='v1'>1</p><section><p>2</p></section></div>")
    text = lambda s: [e.text() for e in select(doc, s)]
    assert text("div > p") == ["1"] and text("#x p") == ["1", "2"] and text("div.a.b p[data-k^=v]") == ["1"] and text("p:first-child, section") == ["1", "2", "2"]
    for bad in ("", "a[", ">p", "a,,b", "a::x"):
        with pytest.raises(SelectorError):
            compile_selector(bad)


def test_deep_and_odd_pages():
    assert "deep" in p.scrape("<div>" * 5000 + "deep", URL, only_main=False)["markdown"] + p.scrape("<div>" * 5000 + "deep", URL)["html"]
    assert inner(parse("<p>a<p>b</div>&amp;<").first("body")).startswith("<p>a</p><p>b")


def test_scripts_and_results():
    assert [s[:2] for s in p.scripts("<!--<script>x</script>--><script>a</script><script type=module src=m.js></script><script type='text/template'>t</script>")] == [("classic", None), ("module", "m.js"), ("data", None)]
    from webloom.plans.content import RESULTS

    hits = [h for e, u, html in RESULTS for h in p.parse_results(e, html, u)]
    assert [(h["engine"], h["rank"], h["url"]) for h in hits][:3] == [("duckduckgo", 1, "https://a.example/1"), ("duckduckgo", 3, "https://b.example/"), ("bing", 1, "https://a.example/")]
    assert {h["engine"] for h in hits} == set(p.ENGINES) and hits[0]["description"] == "first" and hits[0]["title"] == "One & two"
