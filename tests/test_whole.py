"""Queries over all of their rows, where the SQL they are compared with covers fewer."""

import duckdb
import pytest

from webloom.plans import catalog
from webloom.plans.base import TABLES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def collected(spark, name, folder=DIR):
    return [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]


def test_slot_gate_counts_all_events(spark, duck):
    rows = "(select event_id, epoch_us(ts) tm, epoch_us(ts) + cast(floor(value * 20000000) as bigint) until from events)"
    want = duck.sql(f"select a.event_id, count(b.event_id) n from {rows} a left join {rows} b on b.tm < a.tm and b.until > a.tm group by 1").fetchall()
    assert sorted(collected(spark, "slot_gate")) == sorted((i, n, n >= 8, max(8 - n, 0)) for i, n in want)


def test_slot_gate_on_ties_and_empty_spans(spark, tmp_path):
    at = ["00:00:10", "00:00:10", "00:00:30", "00:00:50", "00:00:50", "00:01:00", "00:02:00"]
    took = [1.0, 0.0, 1.0, 0.5, 5.0, 3.0, 1.0]  # in units of 20 s
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 {t}', {v}D)" for i, (t, v) in enumerate(zip(at, took, strict=True)))
    spark.sql(f"SELECT * FROM VALUES {rows} AS e(event_id, ts, value)").write.parquet(f"{tmp_path}/events.parquet")
    begin = [int(t[3:5]) * 60 + int(t[6:]) for t in at]
    busy = [sum(b < a < b + 20 * v for b, v in zip(begin, took, strict=True)) for a in begin]
    assert sorted((r[0], r[1]) for r in collected(spark, "slot_gate", tmp_path)) == list(enumerate(busy))


def test_site_map_takes_all_pages_and_sites(spark, tmp_path):
    hosts = ["example.net", "a.example.net", "other.test", "localhost", "10.0.0.1", "11.0.0.1"]
    rows = [(100 + i, f"https://{h}/", f'<a href="/x#f">x</a><a href="/p/{i}">y</a><a href="https://elsewhere.test/">z</a>') for i, h in enumerate(hosts)] + [(200, "no url", '<a href="/q">q</a>')]
    rows += [(1000 + i, "https://many.test/", "".join(f'<a href="/{i}/{k}">t</a>' for k in range(30))) for i in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [r for r in spark.createDataFrame(collected(spark, "site_map", tmp_path), "site string, link string, source long, place long").collect() if r.source == 1]
    by = {}
    for r in sorted(got, key=lambda r: r.place):
        by.setdefault(r.site, []).append(r.link)
    many = by.pop("many.test")
    assert many == [f"https://many.test/{i}/{k}" for i in range(20) for k in range(30)][:500]
    assert by == {
        "example.net": ["https://example.net/x", "https://example.net/p/0", "https://a.example.net/x", "https://a.example.net/p/1"],
        "other.test": ["https://other.test/x", "https://other.test/p/2"],
        "localhost": ["https://localhost/x", "https://localhost/p/3"],
        "10.0.0.1": ["https://10.0.0.1/x", "https://10.0.0.1/p/4"],
        "11.0.0.1": ["https://11.0.0.1/x", "https://11.0.0.1/p/5"],
    }
    assert {(r[0], r[1]) for r in collected(spark, "site_map_counts", tmp_path)} >= {("many.test", 500), ("example.net", 4), ("localhost", 2)}


def test_site_map_on_the_tables(spark, duck):
    sql = catalog.ORACLE_SQL["site_map"].replace("WHERE page_id < 60", "").replace("site IN ('example.org', 'example.com')", "site <> ''")
    mine = spark.createDataFrame(collected(spark, "site_map"), "site string, link string, source long, place long").select("site", "link", "source", "place").collect()
    assert sorted(map(tuple, mine)) == sorted(duck.sql(f"select site, link, source, place from ({sql})").fetchall())
    assert {r.site for r in mine} >= {"example.org", "example.com", "example.net"}


def test_webhooks_of_all_configured_events(spark, duck):
    kind = "case when event_type = 'signup' then case when event_id % 40 = 0 then 'failed' end when event_type <> 'error' then 'page' end"
    want = {}
    for i, kind, at in duck.sql(f"select event_id, {kind} k, epoch_us(ts) from events where k is not null").fetchall():
        for n, after in enumerate((0, 60, 360, 1260)):
            if n == 0 or i % 100 == 0:
                want[i, n] = (kind, at + after * 1_000_000, kind == "page")
    df = catalog.QUERIES["webhook_attempts"](spark, DIR)
    got = [((r.pos, r.attempt), (r.type.split(".")[1], r.due, r.success)) for r in df.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_rank_fusion_merges_hits_of_any_rank(spark, tmp_path):
    """u/0 is first in one engine and beyond rank 200 in the other; ids are odd and no multiple of 5, so urls stay plain."""
    ids = [i for i in range(1, 2000, 2) if i % 5]
    rows = [(ids[k], 0 if k == 0 else 1000 + k, "view", 1000.0 - k) for k in range(10)]
    rows += [(ids[20 + k], 0 if k == 249 else 2000 + k, "click", 1000.0 - k) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    first = {r.canonical: r for r in catalog.QUERIES["rank_fusion"](spark, tmp_path).collect()}
    r = first["s.example/u/0"]
    assert (r.n_engines, r.engines, r.best_rank, r.score, r.position) == (2, "click,view", 1, round(1 + 1 / 250, 9), 1)
    assert len(first) == 100


def test_hits_enriched_keeps_all_hits(spark, duck):
    df = catalog.QUERIES["hits_enriched"](spark, DIR)
    got = df.groupBy("engine").count().collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql("select event_type, count(*) from events group by 1").fetchall())
    title = dict(duck.sql("select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) from pages where page_id % 4 <> 0").fetchall())
    for r in df.where("rank > 100").collect():
        user = int(r.url.split("/u/")[1].split("/")[0])
        assert (r.title, r.status) == ((title[user], "success") if user in title else (f"title {user}", "missing"))
