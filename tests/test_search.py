"""Answers of searches: fusion, limits, failures, pages that were scraped."""

import json

import pytest

from webloom.operators import search

HIT = "search string, engine string, rank int, title string, description string, url string"
OUT = "search string, place int, engine string, timed_out boolean, code int, message string, hits long"


@pytest.fixture(scope="module")
def tables(spark):
    hits = [("q", "a", 1, "One", "", "https://X.example/1/"), ("q", "a", 2, "Two", None, "https://x.example/2"), ("q", "b", 1, "two", "longer text", "http://x.example/2/?utm_source=b"), ("q", "b", 3, "Two again", "", "https://x.example/2#f"), ("q", "b", 2, None, "d", "not a url"), ("q", "b", 4, "t", "d", None), ("lost", "a", 1, "t", "d", "https://y.example/")]
    outcomes = [("q", 2, "b", False, 200, None, 4), ("q", 1, "a", False, 200, None, 2), ("q", 3, "c", True, None, None, 0), ("lost", 1, "a", False, 503, None, 0), ("lost", 2, "b", False, 200, "bad", 0), ("none", 1, "a", False, 200, None, 0), ("bare", 1, "a", False, 200, None, 3)]
    return spark.createDataFrame(outcomes, OUT), spark.createDataFrame(hits, HIT)


def test_answers(tables):
    got = {r.search: r for r in search.answered(*tables).collect()}
    q = got["q"]
    # both engines have the second page, so it comes first, as its best ranked hit says
    assert [(r.title, r.description, r.url) for r in q.results] == [("two", "longer text", "http://x.example/2/?utm_source=b"), ("One", "", "https://X.example/1/"), ("", "d", "not a url")]
    assert [json.loads(e) for e in q.engines] == [{"engine": "a", "status": "ok", "results": 2}, {"engine": "b", "status": "ok", "results": 4}, {"engine": "c", "status": "timeout"}]
    assert q.success and q.error is None
    assert not got["lost"].success and got["lost"].error == search.FAILED and got["lost"].results == [] and not got["none"].success
    assert got["bare"].success and got["bare"].results == []


def test_limits_and_scraped_pages(spark, tables):
    one = search.answered(*tables, limit=0, scraped=spark.createDataFrame([("http://x.example/2/?utm_source=b", "# Two"), ("other", "x")], "url string, content string"))
    assert [(r.title, r.content) for r in one.where("search = 'q'").first().results] == [("two", "# Two")]
    assert search.answered(tables[0].limit(0), tables[1]).collect() == []
