"""The URL parser: literal cases of the standard, and the native form against the tree operators' form on odd references."""

import random

import pytest

from webloom.functions import urlparse, urls
from webloom.functions.dialect import SPARK
from webloom.html import page, weburl

BASE = "http://EX.com:80/a/b c/d?q#f"
JOINS = [("  y ","http://ex.com/a/b%20c/y"),("a b","http://ex.com/a/b%20c/a%20b"),("..\\x","http://ex.com/a/x"),("//X.com/../z","http://x.com/z"),("//bücher.example/ü?ä'#`","http://xn--bcher-kva.example/%C3%BC?%C3%A4%27#%60"),
("/./a/%2E%2e/b","http://ex.com/b"),("?x","http://ex.com/a/b%20c/d?x"),("#z","http://ex.com/a/b%20c/d?q#z"),("","http://ex.com/a/b%20c/d?q"),("//0x7F.1/","http://127.0.0.1/"),("//[2001:DB8:0:0:1:0:0:1]:080/","http://[2001:db8::1:0:0:1]/"),
("//u:p@h.example:0443/a","http://u:p@h.example:443/a"),("//exa mple/",None),("https:x","https://x/"),("http:x","http://ex.com/a/b%20c/x"),("http:/x","http://ex.com/x"),("https://a.b/../../c/./d/..","https://a.b/c/"),
("//a:b/",None),("//a:99999/",None),("mailto:x@y","mailto:x@y"),("Data:a b?c d#é\x01x","data:a b?c%20d#%C3%A9%01x"),("ftp://x:21/","ftp://x/"),("\\\\h\\p\\..\\q","http://h/q"),("///h2/x","http://h2/x"),("/a\tb\nc","http://ex.com/abc"),("//1.2.3/","http://1.2.0.3/"),("//256.1.1.1/",None),("//1.2.3.4.5/",None),("//4294967295/","http://255.255.255.255/"),("//4294967296/",None),
("//[::1]/","http://[::1]/"),("//[::]/","http://[::]/"),("//[1:2:3:4:5:6:7:8]/","http://[1:2:3:4:5:6:7:8]/"),("//[::ffff:1.2.3.4]/","http://[::ffff:102:304]/"),("//[1::2::3]/",None),("//[1:0:0:0:2:0:0:0]/","http://[1::2:0:0:0]/"),("//[0:0:1:0:0:0:0:0]/","http://[0:0:1::]/"),("//[1:2]/",None),("//[10:0:0:1:0:0:10:0]/","http://[10::1:0:0:10:0]/"),
("//ＥＸ.com/","http://ex.com/"),("//a%41b.com/","http://aab.com/"),("//a%00b/",None),("//@h/","http://h/"),("//u@h/","http://u@h/"),("//u%:p:q@x@h/","http://u%:p%3Aq%40x@h/"),("//münchen-ost.example。de/","http://xn--mnchen-ost-9db.example.de/"),("//例え.テスト/","http://xn--r8jz45g.xn--zckzah/"),("//правда.рф/","http://xn--80aafi6cg.xn--p1ai/"),("//ñandú.cl/","http://xn--and-6ma2c.cl/"),("//😀.la/","http://xn--e28h.la/"),("//straße.de/","http://xn--strae-oqa.de/"),
("a/../b/./c","http://ex.com/a/b%20c/b/c"),("/..","http://ex.com/"),("/a//../b","http://ex.com/a/b"),(".","http://ex.com/a/b%20c/"),("x{y}|z^","http://ex.com/a/b%20c/x%7By%7D|z^"),("foo://H/../x","foo://H/x"),("/ok/path?x=1#y","http://ex.com/ok/path?x=1#y"),("//h:0/","http://h:0/"),("//h:/","http://h/"),("//h.",'http://h./'),("/a?b?c#d#e","http://ex.com/a?b?c#d#e")]
KEYS = [("http://Example.com/","example.com"),("https://example.com","example.com"),("example.com/?utm_source=x","example.com"),("https://EXAMPLE.com:443/path/?q=rust&utm_medium=cpc&ref=x#part","example.com/path?q=rust"),("http://example.com:8080/path?fbclid=x&keep=yes","example.com:8080/path?keep=yes"),
("example.com:8080/x/","example.com:8080/x"),("  ",""),("mailto:A@b.c","mailto:a@b.c"),("Not a url/#frag/","not a url"),("https://bücher.example/ä","xn--bcher-kva.example/%C3%A4"),("https:e.com/x","e.com/x"),("http://a b/","http//a%20b"),("//x.com/y","x.com/y"),("https://e.com/?a=%zz&b=%E4&c=x+y~&d","e.com?a=%25zz&b=%EF%BF%BD&c=x+y%7E&d="),("foo://Host/A/","host/A"),("HTTP://0300.1/","192.0.0.1"),("https://e.com/a?%75tm_x=1&REF=2&q=%26","e.com/a?q=%26")]


def test_joined(spark):
    got = spark.createDataFrame([(BASE, r) for r, _ in JOINS], "b string, r string").selectExpr("r", f"{urlparse.joined('b', 'r')} AS j").collect()
    assert [(r.r, r.j) for r in got] == JOINS
    assert [(r, weburl.joined(BASE, r)) for r, _ in JOINS] == JOINS


def test_canonical_key(spark):
    got = spark.createDataFrame(KEYS, "r string, w string").selectExpr("r", f"{urlparse.canonical_key('r', urls.is_tracking(SPARK, 'n'))} AS k").collect()
    assert [(r.r, r.k) for r in got] == KEYS


def test_references_that_stay(spark):
    refs = ["", "  ", "#x", " #x ", "mailto:a@b", "javascript:void(0)", "data:,x", "TEL:1", "HTTPS://E.com:443", "//exa mple/", "//[::1"]
    got = spark.createDataFrame([(r,) for r in refs], "r string").selectExpr(f"{urlparse.resolve(SPARK.lit(BASE), 'r')} AS j").collect()
    assert [r.j for r in got] == refs == [page.resolve(BASE, r) for r in refs]
    none = spark.createDataFrame([(None, "/x"), ("", "/x"), ("nope", "/x"), ("mailto:a", "/x"), ("http://h/", None)], "b string, r string")
    assert [r.j for r in none.selectExpr(f"{urlparse.resolve('b', 'r')} AS j").collect()] == ["/x", "/x", "/x", "/x", None]


def test_nulls_and_long_texts(spark):
    long = "/" + "a/../" * 3000 + "é" * 3000
    got = spark.createDataFrame([(None,), (long,)], "r string").selectExpr(f"{urlparse.joined(SPARK.lit(BASE), 'r')} AS j", f"{urlparse.canonical_key('r', 'false')} AS k").collect()
    assert got[0].j is None and got[0].k is None and got[1].j == "http://ex.com/" + "%C3%A9" * 3000 == weburl.joined(BASE, long)


PARTS = ["http:", "https:", "ftp:", "foo:", "ws:", "mailto:", "/", "//", "\\", "///", ".", "..", "%2e", "%2E%2e", "?", "#", "@", ":", ":80", ":443", ":0", ":99999", "[", "]", "[::1]", "[1:0:0:0:0:0:0:1]", "[::ffff:1.2.3.4]", "[1::2:3]", "a", "B.c", "x.example", "bücher", "例え", "😀", "ＥＸ", "。", "1", "0x1f", "010", "256", "1.2.3", "4294967296", " ", "\t", "\n", "%", "%41", "%zz", "%00", "é", "'", '"', "<", ">", "`", "{", "|", "^", "&", "=", "+", "*", "~", "xn--a", "-", "_", "\u2028", "\x85", "\xa0"]
BASES = ["http://h.example/", "https://u:p@Host.Example:8443/a/b/../c?q=1#f", "ftp://x/y", "foo://Bar/baz/q", "http://1.2/ü", "https://h.example"]


def test_native_form_equals_that_of_the_tree_operators(spark):
    rng = random.Random(5)
    rows = [(rng.choice(BASES), "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 7)))) for _ in range(6000)]
    rows += [(b, r) for b in BASES for r, _ in JOINS]
    got = spark.createDataFrame(rows, "b string, r string").repartition(4).selectExpr("b", "r", f"{urlparse.joined('b', 'r')} AS j").collect()
    wrong = [(r.b, r.r, r.j, weburl.joined(r.b, r.r)) for r in got if r.j != weburl.joined(r.b, r.r)]
    assert wrong == []
    assert sum(r.j is not None for r in got) > 1500


def test_what_was_joined_joins_to_itself(spark):
    got = spark.createDataFrame([(b, r) for b in BASES for r, _ in JOINS], "b string, r string").selectExpr(f"{urlparse.joined('b', 'r')} AS j").where("j is not null")
    assert got.selectExpr("j", f"{urlparse.joined('j', 'j')} AS k").where("j <> k").collect() == []


@pytest.mark.parametrize("name", ["canonical_urls", "page_links", "url_cases", "url_spellings", "rank_fusion"])
def test_no_python_in_the_plan(spark, name):
    from webloom.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
