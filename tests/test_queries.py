"""Every registered query against its SQL in DuckDB on the small tables, and literal cases of the semantics."""

import duckdb
import pytest

from webloom.functions import signals, text, urls
from webloom.functions.dialect import DUCK, SPARK
from webloom.plans import catalog
from webloom.plans.base import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal_to_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    r = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=repr)
    theirs = sorted((tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def value(spark, duck, make, *args):
    """The value of an expression in both engines, which have to agree."""
    got = spark.sql("SELECT " + make(SPARK, *[SPARK.lit(a) for a in args]) + " AS x").first().x
    assert duck.sql("SELECT " + make(DUCK, *[DUCK.lit(a) for a in args]) + " AS x").fetchall()[0][0] == got
    return got


@pytest.mark.parametrize(
    "url,want",
    [("https://EX.com:443/a/?utm_source=x&b=1&ref=q#f", "ex.com/a?b=1"), ("http://ex.com:8080/", "ex.com:8080"), ("http://ex.com", "ex.com"), ("Not A Url/#x", "not a url"), ("https://e.com/p?FBCLID=1&q=%20", "e.com/p?q=+"), ("Example.COM/A/?utm_source=q&b=1", "example.com/A?b=1"), (" https://h/a/../b/./c/ ", "h/b/c"), ("https://h/?utm%5Fsource=1&x=%C3%A9*~&y", "h?x=%C3%A9*%7E&y="), ("https://h/a/..", "h")],
)
def test_canonical_key(spark, duck, url, want):
    assert value(spark, duck, urls.canonical_key, url) == want


@pytest.mark.parametrize(
    "ref,want",
    [("/x", "https://s.example/x"), ("y", "https://s.example/a/y"), ("?q", "https://s.example/a/b?q"), ("#f", "#f"), ("//c/z", "https://c/z"), ("../x", "https://s.example/x"), ("./c/../d?e=/../f#../g", "https://s.example/a/d?e=/../f#../g"), ("/p/./q/..", "https://s.example/p/"), ("../../../z", "https://s.example/z"), ("mailto:a", "mailto:a")],
)
def test_resolve(spark, duck, ref, want):
    assert value(spark, duck, urls.resolve, "https://s.example/a/b", ref) == want


def test_text_functions(spark, duck):
    assert value(spark, duck, text.collapse, " a\u00a0\u2003 b\n") == "a b"
    assert value(spark, duck, text.solid_length, "a \u3000é\t") == 2
    assert value(spark, duck, text.is_skeleton, "> **Loading...**") is True
    assert value(spark, duck, text.is_skeleton, "loading dock") is False
    assert value(spark, duck, text.drop_base64_images, "![a](data:x) ![b](c)") == "![a](<Base64-Image-Removed>) ![b](c)"
    assert value(spark, duck, text.code_language, "hljs rust") == "language-rust"
    assert value(spark, duck, urls.redact_credentials, "socks5h://u:p@h/x") == "socks5h://***@h/x"


def test_scores(spark, duck):
    score = lambda *a: value(spark, duck, signals.score, *a)
    assert score("https://x.example/api/items", "https://x.example/", "application/json", "") == 23
    assert score("/v1/items", "https://x.example/", "", "") == 18
    assert score("https://x.example/app.js", "https://x.example/", "", "") == -40
    assert score("https://o.example/graphql", "https://x.example/", "", "application/json") == 13
    assert score("https://www.google-analytics.com/collect", "https://x.example/", "", "") == -100
    post = lambda url, ct: value(spark, duck, lambda d, u, c: signals.is_replayable(d, "'POST'", u, "''", c), url, ct)
    assert post("https://x.example/api/cart/add", "application/json") is True and post("https://x.example/api/cart/add", "") is False
    assert post("wss://x.example/graphql", "application/json") is False


def test_entry_imports_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
    assert e._optional("webloom.no_such_part") is None
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize(
    "body,want",
    [("<div id=cf-chl-x>", True), ("cf-turnstile", True), ("just a moment", True), ("x datadome y", True), ("geo.captcha-delivery", True), ("verify you are human", True), ("checking your browser", True), ("captcha", False), ("access denied", False), ("", False)],
)
def test_wall_markers(spark, duck, body, want):
    assert value(spark, duck, lambda d, x: signals.any_of(d, x, signals.WALL_MARKERS), body) is want


def test_assets_end_with_their_extension(spark, duck):
    assert value(spark, duck, signals.is_asset, "/a/B.JS") is True
    assert value(spark, duck, signals.is_asset, "/a/b.js/c") is False and value(spark, duck, signals.is_asset, "/ajs") is False


@pytest.mark.parametrize(
    "rule,path,want",
    [
        ("/a", "/abc", True), ("/a", "/b", False), ("/a$", "/a", True), ("/a$", "/ab", False), ("/*.php$", "/x.php", True), ("/*.php$", "/a.php.php", False), ("/*.php", "/a.php.php", True), ("/*b*d", "/abcd", True), ("/*d*b", "/abcd", False),
        ("*", "/x", True), ("/a*$", "/abc", True), ("/a**c$", "/abc", True), ("*x", "/y", False), ("/100%_", "/100%_a", True), ("/100%_", "/100ab", False), ("$", "/", False), ("/\u00e9*f", "/\u00e9ef", True),
    ],
)
def test_rule_fits(spark, duck, rule, path, want):
    assert value(spark, duck, signals.rule_fits, rule, path) is want
