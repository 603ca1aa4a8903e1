"""The token stream's operators against those of the tree, on odd pages and on the given ones."""

import json

import pytest

from webloom.functions.dialect import SPARK as S
from webloom.functions.markup import TOKEN, decoded
from webloom.html import page as p
from webloom.html.tree import parse
from webloom.operators import markup
from webloom.operators import pages as tree

URL = "https://s.example/dir/page?q=1"
ODD = [
    None, "", "plain < text > only", "<a href=/x>1</a><A HREF='/x'>2</A><a\nhref = \"/y?a=1&amp;b=2\">3</a><a name=z>4</a><a href>5</a><a href=''>6</a>",
    "<!-- <a href=/no> --><a href=/yes><!----><a href=/also><!--> <a href=/third>", "<script>var s = '<a href=/no>';</script><a href=/yes></a><style>a{content:'<a href=/no>'}</style>",
    "<a title='a > b' href=\"/q\">x</a><a title=\"'\" href='/r\"s'>y</a>", "<base href='/other/'><base href='/never/'><a href=rel>x</a><a href='../up'>y</a>", "<a href=x>first</a><base href='https://b.example/c/d'>",
    "<base><base target=_top href='  //t.example/z/ '><a href=' w '>", "<base href='//bad host/'><a href=k>", "<a href='#top'><a href='JavaScript:x()'><a href=mailto:a@b><a href='tel:1'><a href='data:text/plain,x y'><a href='HTTPS://E.com:443/%7e'>",
    "<a href=/1 href=/2><a HREF=/3 Href=/4>", "<a/href=/5><a / href=/6 /><abbr href=/no><area href=/no><a\thref=/7>", "<a href=/x&copy;y><a href='/&lt;&#60;&#x3c;&#128;&#0;&nbsp;&unknown;&amp'>",
    "<a href=/é?ü=ß#ñ>x</a><a href='/a b'>", "<title> A &amp; B\n <b>c</b> </title><title>second</title>", "<html lang=' en '><head><meta name=description content=' d '><meta name=description content=later><meta property=og:title content=O></head>",
    "<meta property='og:title' content='P'><meta name='og:title' content='N'><meta name=twitter:title content=T>", "<meta name=twitter:title content=T>", "<title></title><meta name=title content=own><meta property=og:title content=o>",
    "<meta name='' property=p content=1><meta property=p content=2><meta itemprop=i content=3><meta name=k content=''><meta name=k content=v><meta content=none>", "<meta property=og:locale:alternate content=fr><meta property=og:locale:alternate content=de>",
    "<link rel=canonical href=/c?a=1><link rel='CANONICAL' href=/d><link rel='shortcut icon' href=fav.ico><link rel=apple-touch-icon href=t.png>", "<link rel='apple-touch-icon' href=t.png><link rel=icon href=''>", "<meta name=canonical content=x><link rel=canonical href=' '>",
    "<meta name='article:tag' content='x'><meta property='article:tag' content='y'><meta name=viewport content='w=1'>", "<script src=a.js></script><script type=' Module '>1<2</script><script type=application/json>{\"a\":\"</b>\"}</script><SCRIPT>x</SCRIPT >",
    "<script>a<!--b</script><p><script src='é&amp;.js' async></script>", "<textarea><x></textarea>", "<!DOCTYPE html><?php x ?><a href=/ok></ a><//><a href=/ok2>", "<p>" * 3000 + "<a href=/deep>", "<a " + " ".join(f"x{i}='{i}'" for i in range(3000)) + " href=/many>", "<a href=/long>" + "x" * 300000 + "</a><a href=/end>",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, URL, h, 0) for i, h in enumerate(ODD)] + [(1000 + i, u, "<base href=/b/><a href=c><a href=https://d.example>") for i, u in enumerate((None, "", "nope", "mailto:x@y", "http://H.example"))]
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def by_page(rows, *fields):
    out = {}
    for r in rows:
        out.setdefault(r.page_id, []).append(tuple(r[f] for f in fields))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_links(pages):
    want = {r.page_id: sorted(enumerate(p.links(parse(r.html or ""), r.url or "")), key=str) for r in pages.collect()}
    got = by_page(markup.links(pages).collect(), "pos", "link")
    assert got == {k: v for k, v in want.items() if v}


def test_references_in_attributes_end_where_a_browser_ends_them(spark):
    page = spark.createDataFrame([(1, URL, "<a href='?a=1&copy=2&lt3&reg;&amp'>")], "page_id long, url string, html string")
    assert [r.link for r in markup.links(page).collect()] == ["https://s.example/dir/page?a=1&copy=2&lt3%C2%AE&"]


def test_scripts(pages):
    assert by_page(markup.scripts(pages).collect(), "pos", "kind", "src", "chars") == by_page(tree.page_scripts(pages).collect(), "pos", "kind", "src", "chars")


def metas(url, html):
    made = p.metadata(parse(html or ""), url or "", 200, "text/html")
    return sorted(((k, ",".join(v) if isinstance(v, list) else v) for k, v in made.items() if k not in ("sourceURL", "url", "statusCode", "contentType")), key=str)


def test_metadata(pages):
    want = {r.page_id: metas(r.url, r.html) for r in pages.collect()}
    assert by_page(markup.metadata(pages).collect(), "key", "value") == {k: v for k, v in want.items() if v}


def test_given_pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert sorted(map(tuple, markup.links(given).collect())) == sorted(map(tuple, tree.tree_links(given).collect()))
    assert sorted(map(tuple, markup.scripts(given).collect()), key=str) == sorted(map(tuple, tree.page_scripts(given).collect()), key=str)
    made = {r.page_id: json.loads(r.metadata) for r in tree.scrape_pages(given, formats=("metadata",)).collect()}
    assert {(r.page_id, r.key, r.value) for r in markup.metadata(given).collect()} == {(i, k, ",".join(v) if isinstance(v, list) else v) for i, m in made.items() for k, v in m.items() if k not in ("sourceURL", "url", "statusCode", "contentType")}


def test_tokens_are_the_whole_page(spark):
    got = spark.createDataFrame([(h,) for h in ODD if h], "html string").selectExpr("html", f"array_join(regexp_extract_all(html, {S.lit(TOKEN)}, 0), '') AS joined").collect()
    assert all(r.html == r.joined for r in got)


def test_references(spark):
    cases = {"&amp;&lt;&copy": "&<©", "&#65;&#x42;&#X43&#68": "ABCD", "&#128;&#150;": "€–", "&#0;&#xD800;&#x110000;": "�" * 3, "&nope;&;&": "&nope;&;&", "&#x1F600;": "\U0001f600", "&copy=1&eacute;": "&copy=1é", "a&b": "a&b"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").selectExpr("x", f"{decoded('x')} AS y").collect()
    assert {r.x: r.y for r in rows} == cases


@pytest.mark.parametrize("name", ["links", "metadata", "scripts"])
def test_no_python_in_the_plan(pages, name):
    plan = getattr(markup, name)(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in (plan if name != "metadata" else "")
