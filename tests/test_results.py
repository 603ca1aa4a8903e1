"""Literal cases of paths, selectors, folds and record columns."""

import pytest
from pyspark.sql import functions as F

from webloom import api
from webloom.functions import records
from webloom.functions.jsonpath import PathError, compile_path, filter_json
from webloom.html import page
from webloom.html.select import SelectorError, compile_selector, select
from webloom.html.tree import parse
from webloom.operators import folds

DATA = {"a": [{"b": 1, "c": "x"}, {"b": 2}, {"c": "yy", "b": None}], "k": {"b": 3}, "it's": True, "n": [1, 1.0, True, "1"]}


@pytest.mark.parametrize(
    "path,want",
    [
        ("$.a[*].b", [1, 2, None]), ("$..b", [1, 2, None, 3]), ("$.a[?@.b>=1].c", ["x"]), ("$['k'][\"b\"]", [3]), ("$['it\\'s']", [True]), ("$.a[-1].c", ["yy"]), ("$.a[::2].b", [1, None]), ("$.a[::-1].b", [None, 2, 1]),
        ("$.a[0,1]['b','c']", [1, "x", 2]), ("$.a[?length(@.c)==2].c", ["yy"]), ("$.a[?match(@.c,'y+')||@.b==1].b", [1, None]), ("$.a[?search(@.c,'y')].c", ["yy"]), ("$.a[?!@.c].b", [2]), ("$.zz", []), ("$.a[9]", []),
        ("$.n[?@==1]", [1, 1.0]), ("$.n[?@!=1]", [True, "1"]), ("$.a[?@.x==@.y].b", [1, 2, None]), ("$.a[?count(@.*)>1].c", ["x", "yy"]), ("$.a[?@.b==$.k.b]", []), ("$.a[?(@.b==1 || @.b==2) && @.c].b", [1]), ("$.a[::0]", []), ("$ .k [ 'b' ]", [3]),
    ],
)
def test_paths(path, want):
    got = compile_path(path)(DATA)
    assert got == want and [type(x) for x in got] == [type(x) for x in want]


@pytest.mark.parametrize("path", ["", "a", "$.", "$[", "$.a]", "$.a[?]", "$.a[?@.b=1]", "$[01]", "$.a[?@..b==1]", "$.a[?1]", "$[?nope(@)]", "$[?length(@.a)]", "$['a]", "$ "[:1] + "x"])
def test_bad_paths_are_refused_on_the_driver(spark, path):
    df = spark.createDataFrame([(1, "{}")], "id long, body string")
    with pytest.raises(PathError, match="invalid JSONPath"):
        filter_json(df, "id", "body", path)


def test_filtered_json(spark):
    rows = [(1, '{"a":[1,{"b":"é"}]}'), (2, '{"a":[7]}'), (3, '{"a":[]}'), (4, None), (5, "{"), (6, "[" * 100_000), (2, '{"a":[null]}')]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("data", F.lit("clash"))
    got = sorted(((r.id, r.data, r.outcome, r.note) for r in filter_json(df, "id", "body", "$.a[*]").collect()), key=repr)
    none = "`$.a[*]` matched no nodes; data set to null"
    assert got == [(1, '[1,{"b":"é"}]', "many", None), (2, "7", "single", None), (2, "null", "single", None), (3, None, "none", none), (4, None, "no_data", None), (5, None, "unreadable", None), (6, None, "unreadable", None)]
    assert filter_json(df.limit(0), "id", "body", "$").count() == 0


DOC = "<div id=a class='x y'><p>1</p><p class=k lang=en-US>2</p><span>s</span><p>3<b>q</b></p></div><ul><li>1<li>2<li>3<li>4<li>5</ul><i></i>"


@pytest.mark.parametrize(
    "selector,want",
    [
        ("p:not(.k)", ["1", "3q"]), ("p + span", ["s"]), ("p ~ p", ["2", "3q"]), ("p + p", ["2"]), ("li:nth-child(2n+1)", ["1", "3", "5"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:nth-child(even)", ["2", "4"]), ("li:nth-last-child(2)", ["4"]), ("p:nth-of-type(3)", ["3q"]),
        ("p:has(b)", ["3q"]), ("div:has(> span)", ["12s3q"]), ("p:not(.k, :has(b))", ["1"]), (":is(span, i)", ["s", ""]), ("i:empty", [""]), ("[LANG='EN-us' i]", ["2"]), ("[lang|=en]", ["2"]), ("div#a.x.y>p:first-child", ["1"]), ("span, b", ["s", "q"]), ("li:last-child", ["5"]), ("span:only-of-type", ["s"]),
    ],
)
def test_selectors(selector, want):
    assert [e.text() for e in select(parse(DOC), selector)] == want


@pytest.mark.parametrize("selector", ["", "a >", "> a", "a,,b", "a[", "p:foo", "p:nth-child(x)", "a,", "p::before", ":not(", "a b)"])
def test_bad_selectors(selector):
    with pytest.raises(SelectorError):
        compile_selector(selector)


def test_only_what_is_asked_for_is_built(monkeypatch):
    def never(*_):
        raise AssertionError("built")

    html = "<title>t</title><article><p>text</p><a href='/x'>l</a></article>"
    every = page.scrape(html, "https://h.example/")
    assert all(every[k] for k in page.FORMATS)
    for name in ("render", "clean_tree"):
        monkeypatch.setattr(page, name, never)
    got = page.scrape(html, "https://h.example/", formats=("metadata", "links"))
    assert got == every | {"markdown": None, "html": None, "incomplete": None}


def test_sessions_restart_their_lifetime(spark):
    """A session is 10 s idle or 25 s old at most; the one that follows an old one counts from its own opening."""
    times = {1: [0, 10, 20, 25, 26, 36, 47, 47], 2: [5]}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in reversed(ts)], "user long, at long")
    got = sorted(map(tuple, folds.fold_segments(df, ["user"], ["at"], [], folds.Sessions.FIELDS, lambda: folds.Sessions(10, 25)).collect()))
    assert got == [(1, 0, 25, 4, "lifetime"), (1, 26, 36, 2, "idle"), (1, 47, 47, 2, "idle"), (2, 5, 5, 1, "idle")]
    assert folds.fold_segments(df.limit(0), ["user"], ["at"], [], folds.Sessions.FIELDS, lambda: folds.Sessions(10, 25)).count() == 0


def test_hard_cap_closes_a_window(spark):
    """Quiet 10, cap 50: requests in flight keep a window open up to the cap, and the next request opens another."""
    rows = [(1, 0, 5, False, True, False), (1, 8, 9, True, False, False), (1, 14, 200, False, False, False), (1, 49, 50, True, True, False), (1, 51, 52, False, False, True), (1, 70, 71, True, False, False), (1, 90, 90, False, False, False)]
    df = spark.createDataFrame([(p, t, i, d, tr, h, x) for i, (p, t, d, tr, h, x) in enumerate(rows)], "page long, at long, seq long, done long, tracker boolean, hit boolean, threw boolean")
    got = sorted(map(tuple, folds.fold_segments(df, ["page"], ["at", "seq"], ["done", "tracker", "hit", "threw"], folds.Captures.FIELDS, lambda: folds.Captures(10, 50, 64)).collect()))
    assert got == [(1, 0, 50, 2, 1, 2, "window_closed"), (1, 51, 62, 1, 0, 0, "threw"), (1, 90, 100, 1, 0, 0, "no_intercepts")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(*items):
    typed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in items))
    return typed.cast("array<struct<name:string,value:string>>")


def test_header_lists(spark):
    merged = lambda h, c: [tuple(x) for x in one(spark, records.merge_cookies(pairs(*h), pairs(*c)))]
    assert merged([("A", "1"), ("cookie", "x=1"), ("B", "2")], [("z", "9"), ("b", "8")]) == [("A", "1"), ("B", "2"), ("Cookie", "x=1; b=8; z=9")]
    assert merged([("COOKIE", " ")], [("z", "9")]) == [("Cookie", "z=9")]
    assert merged([("cookie", "x"), ("A", "1")], []) == [("cookie", "x"), ("A", "1")]
    assert merged([], [("z", "9")]) == [("Cookie", "z=9")]
    raw = F.array(F.struct(F.lit("b").alias("name"), F.lit(b"\xffok").alias("value")), F.struct(F.lit("a").alias("name"), F.lit("é".encode()).alias("value")))
    assert [tuple(x) for x in one(spark, records.header_list(raw))] == [("b", "�ok"), ("a", "é")]


@pytest.mark.parametrize(
    "kind,selector,key,direction,ms,want",
    [("click", "#a", None, None, None, "click #a"), ("type", None, None, None, None, "type <focused>"), ("press", None, "Enter", None, None, "press Enter"), ("scroll", None, None, None, None, "scroll down"), ("scroll", "#s", None, "up", None, "scroll #s"), ("scroll", None, None, "up", None, "scroll up"), ("wait", "#w", None, None, 5, "wait #w"), ("wait", None, None, None, 250, "wait 250ms"), ("wait", None, None, None, None, "wait")],
)
def test_action_labels(spark, kind, selector, key, direction, ms, want):
    text = lambda x: F.lit(x).cast("string")
    assert one(spark, records.action_label(text(kind), text(selector), text(key), text(direction), F.lit(ms).cast("long"))) == want


def test_find_ignoring_case(spark):
    at = lambda text, needle: one(spark, records.find_ignoring_case(F.lit(text).cast("string"), F.lit(needle)))
    assert (at("abCde", "Cd"), at("abc", ""), at("abc", "x"), at("É", "é"), at("", "a"), at(None, "a")) == (2, 0, None, None, None, None)


def test_discover(spark):
    rows = [
        (1, 1, "https://s.example/", "https://s.example/api/items", "get", "application/json", ""), (1, 2, "https://s.example/", "https://s.example/api/cart", "DELETE", "application/json", ""), (1, 0, "https://s.example/", "/app.js", "get", None, None),
        (2, 5, "https://s.example/", "https://www.google-analytics.com/collect", "get", "", ""), (3, 1, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, seq long, target string, url string, method string, accept string, content_type string").withColumn("score", F.lit("clash"))
    got = sorted((r.page_id, r["rank"], r.seq, r.method, r.score, r.replay) for r in api.discover(df).collect())
    assert got[:3] == [(1, 1, 1, "GET", 23, True), (1, 2, 2, "DELETE", 23, False), (1, 3, 0, "GET", -40, False)] and got[3][:3] == (2, 1, 5) and not got[3][5] and got[4][0] == 3
    assert api.discover(df, limit=1).count() == 3 and api.discover(df.limit(0)).count() == 0


def test_render_and_maps(spark):
    rows = [(1, "https://h.example/", "<article><p>one</p><a href='/b'>b</a><a href='/c#x'>c</a></article>"), (2, "https://h.example/b", "<p>two</p>"), (3, "https://h.example/c", ""), (4, "https://other.example/", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = lambda **kw: {r.page_id: r.output for r in api.render(api.scrape(pages, only_main=False), **kw).collect()}
    got = out()
    assert got[2] == "two\n" and got[3].startswith('{"page_id":3')
    assert out(as_json=True)[2].startswith('{"page_id":2,"markdown":"two"') and "\n  " in out(as_json=True, pretty=True)[2].rstrip() and out(formats=("markdown", "html"))[2].startswith("{")
    links = lambda **kw: [r.link for r in api.map_site(pages, "h.example", **kw).collect()]
    sitemap = spark.createDataFrame([("https://h.example/s",), ("https://h.example/b",), ("https://x.example/",)], "url string")
    assert links() == ["https://h.example/b", "https://h.example/c"] and links(sitemap=sitemap, sitemap_only=True) == ["https://h.example/b", "https://h.example/s"]
    assert links(sitemap=sitemap) == ["https://h.example/b", "https://h.example/s", "https://h.example/c"] and links(sitemap=sitemap, ignore_sitemap=True, limit=0) == ["https://h.example/b"]
    with pytest.raises(ValueError, match="mutually exclusive"):
        links(ignore_sitemap=True, sitemap_only=True)
    assert sorted((r.place, r.page_id) for r in api.scrape_mapped(pages, "https://h.example/", limit=2).collect()) == [(0, 1), (1, 2)]


def test_command_line(spark, tmp_path):
    from webloom import __main__ as cli

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "https://h.example/", "<p>one <a href='/b'>b</a></p>", '{"a":[1,2]}')], "page_id long, url string, html string, data string").write.parquet(src)
    read = lambda: [r.value for r in spark.read.text(out).collect()]
    cli.run(spark, cli.arguments().parse_args(["scrape", src, out, "--whole"]))
    assert read()[0].startswith("one ")
    cli.run(spark, cli.arguments().parse_args(["map", src, out, "h.example"]))
    assert read() == ['{"link":"https://h.example/b"}']
    cli.run(spark, cli.arguments().parse_args(["extract", src, out, "$.a[*]"]))
    assert read() == ['{"page_id":1,"data":"[1,2]","outcome":"many"}']
    assert cli.main(["extract", src, out, "$["]) == 1 and cli.main(["nope"]) == 2
