"""The staged ladder on small tables, branch by branch."""

import pytest

from webloom.operators import ladder

PAGE = "page_id long, url string, html string, data string"
ANSWER = "method string, url string, status int, body string, seq long"
REQUEST = "page_id long, seq long, url string, method string, accept string, content_type string, score string"
NUXT = '<script>window.__NUXT__ = {"a":1};</script>'
BUILD = '<script src="/_next/static/ID-1/_buildManifest.js"></script>'
PAGES = [
    (1, "https://h.example/a", NUXT),
    (2, "https://h.example/b/?q=x y&e=%C3%A9#f", BUILD),
    (3, "https://h.example/", BUILD),
    (4, "https://h.example/c", BUILD + "__next_f"),
    (5, "https://h.example/d", "<p>x</p>"),
    (6, "https://h.example/e", None),
    (7, None, ""),
    (8, "https://h.example/g", "<script id='__NEXT_DATA__'>{broken</script><script>__BUILD_ID = 'ok.1'</script>"),
]
ANSWERS = [
    ("GET", "https://h.example/_next/data/ID-1/b.json?q=x%20y&e=%C3%A9", 200, '{"b":1}', 5), ("get", "https://h.example/_next/data/ID-1/b.json?q=x%20y&e=%C3%A9", 500, "later", 9),
    ("GET", "https://h.example/_next/data/ID-1/index.json", 200, "<html>", 1), ("GET", "https://h.example/_next/data/ok.1/g.json", 204, None, 1),
    ("GET", "https://h.example/api/one", 200, "oops", 1), ("GET", "https://h.example/api/two", 200, "[2]", 1), ("DELETE", "https://h.example/api/three", 200, "3", 1), (None, None, 200, "1", 1),
]
REQUESTS = [
    (3, 1, "/api/one", "GET", "application/json", None), (3, 2, "/api/two", " get ", None, None), (4, 1, "/api/three", "DELETE", None, None), (5, 1, "https://px-cloud.net/x", "GET", None, None), (5, 2, "/api/two", "GET", None, None),
    (6, 1, "/logo.png", "GET", None, None), (8, 1, "/api/none", "GET", None, None), (8, 2, None, None, None, None), (2, 1, "/api/two", "GET", None, None), (99, 1, "/api/two", "GET", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame([(*p, "x") for p in PAGES], PAGE),
        spark.createDataFrame(ANSWERS, ANSWER),
        spark.createDataFrame([(*r, "x") for r in REQUESTS], REQUEST),
    )


def run(tables, **kw):
    return {r.page_id: r for r in ladder.data_of_pages(*tables, **kw).collect()}


def test_every_branch(tables):
    got = run(tables)
    assert {i: (r.status, r.tier) for i, r in got.items()} == {
        1: ("success", "static"), 2: ("success", "heuristic_api_replay"), 3: ("unsupported", None), 4: ("unsupported", None), 5: ("needs_browser", None), 6: ("unsupported", None), 7: ("unsupported", None), 8: ("error", None),
    }
    assert (got[1].detail, got[1].data) == ("nuxt", '{"a": 1}')
    assert (got[2].detail, got[2].data) == ("https://h.example/_next/data/ID-1/b.json?q=x%20y&e=%C3%A9", '{"b":1}')
    assert got[3].trace == ["static.scan missed", "tier1.parse failed", "runtime.capture matched: 2", f"runtime.rank missed: {ladder.NO_VIABLE}"]
    assert got[4].trace[1:] == ["tier1.build_id skipped", "runtime.capture matched: 1", f"runtime.rank missed: {ladder.UNSAFE}"]
    assert got[5].trace[-1] == "core.challenge matched: network:perimeterx" and got[6].trace[-1].endswith(ladder.NO_VIABLE)
    assert got[7].trace == ["static.scan missed", "tier1.build_id missed", "runtime.capture missed", f"runtime.rank missed: {ladder.NO_VIABLE}"]
    assert got[8].trace[1:] == ["tier1.parse failed", "runtime.capture matched: 2", "runtime.replay failed"]


def test_options(tables):
    assert {r.status for i, r in run(tables, tier_max=0).items() if i > 1} == {"unsupported"}
    one = run(tables, tier_max=1)
    assert one[2].status == "success" and len(one[3].trace) == 2
    more = run(tables, tries=2, allow_unsafe=True)
    assert (more[3].status, more[3].detail, more[3].data) == ("success", "GET https://h.example/api/two (score 18)", "[2]")
    assert (more[4].status, more[4].data) == ("success", "3")


def test_a_challenge_counts_where_little_was_rendered(spark, tables):
    full = "<p>" + "word " * 300 + "</p>"
    assert run(tables, rendered=spark.createDataFrame([(5, full)], "page_id long, rendered_html string"))[5].status == "success"
    shown = [(1, full), (2, "<p>" + "word " * 200 + "</p>"), (3, None), (4, full.replace("p>", "script>"))]
    assert {r.page_id for r in ladder.walls(spark.createDataFrame(shown, "page_id long, rendered_html string")).where("wall").collect()} == {2, 3, 4}


def test_discovery(tables):
    pages, answers, requests = tables
    got = {r.page_id: tuple(r)[1:] for r in ladder.discovered(pages, requests, answers).collect()}
    assert got[3] == ("success", 2, 2, None, None) and got[2] == ("success", 1, 1, "GET https://h.example/api/two (score 18)", "[2]")
    assert got[4] == ("success", 1, 0, None, None) and got[5] == ("needs_browser", 0, 0, None, None) and got[7] == ("success", 0, 0, None, None)


def test_empty_and_repeated(spark, tables):
    pages, answers, requests = tables
    assert ladder.data_of_pages(pages.limit(0), answers, requests).collect() == []
    assert {r.status for r in ladder.data_of_pages(pages.where("page_id <> 1"), answers.limit(0), requests.limit(0)).collect()} == {"unsupported"}
    twice = pages.where("page_id = 2").union(pages.where("page_id = 2"))
    assert [r.status for r in ladder.data_of_pages(twice, answers, requests).collect()] == ["success"] * 2
