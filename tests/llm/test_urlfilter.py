import duckdb
import pandas as pd

from webloom.llm import urlfilter as u

URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q#f", "http://example.net/en", "http://x.example.net/en/", "http://net/", "http://net", "http://a.net?x=/", "https://example.com/de/1",
        "https://sub.EXAMPLE.com/de/", "https://org/fr/z", "https://w.org/fr", "https://badexample.com/de/", "a://b://c/d?e", "http://ÄB.org/ä/ö#x", "https://x.org/" + "a" * 20000, "https://ads.banner.example/click", "https://blog.example.org/en/751",
        "https://blog.example.org/en/751", "http://h\nost/p\nq"]


def expected(url, weights, bias):
    host, path = u.split_url(url)
    best = max(((r, v) for r, v in u.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])), key=lambda x: len(x[0]), default=(None, None))
    m = sum(weights[b] + bias for b in u.buckets(host, 0) + u.buckets(path, 1))
    return host, path, best[0], best[1] or ("block" if m > 0 else "allow"), m


def test_against_plain_python_and_sql(spark):
    weights, bias = u.train()
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in u.judge(df).collect()}
    assert got == {i: expected(x, weights, bias) for i, x in enumerate(URLS)}
    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": pd.Series(URLS, dtype="object")})  # noqa: F841
    said = {r[0]: r[1:] for r in duckdb.sql(u.sql()).fetchall()}
    assert said == got
    assert u.judge(df.limit(0)).collect() == []


def test_training_fits_and_generalises():
    weights, bias = u.train()
    judge = lambda x: expected(x, weights, bias)[3]
    wrong = sum(judge(x) != ("block" if y else "allow") for x, y in u.LABELLED if expected(x, weights, bias)[2] is None)
    assert wrong == 0
    assert judge("https://ads.other.example/click/banner") == "block" and judge("https://blog.example.org/en/99") == "allow"


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    plan = u.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
