"""Page archives and request logs: round trips, pushdown, commits."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from webloom.sources import archive

PAGES = [(1, "https://A.example/x", "<p>é</p>\r\n\r\nWARC/1.0\r\n", 200, "text/html"), (2, "https://a.example:8080/y?q#f", "", 404, None), (3, None, None, None, None), (4, "http://b.example/\r\nz", "x" * 200000, 301, "text/plain; charset=utf-8"), (5, "mailto:q", "\x00 ", 200, "a")]
SCHEMA = "page_id long, url string, html string, status int, content_type string"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("page_id", "url", "html", "status", "content_type").collect()), key=str)


def test_round_trip(spark, pages, tmp_path):
    at = f"file://{tmp_path}/a"
    archive.write_archive(pages.repartition(3), at)
    got = archive.read_archive(spark, at)
    want = sorted([(i, u and u.replace("\r\n", "%0D%0A"), h, s, c) for i, u, h, s, c in PAGES], key=str)
    assert rows(got) == want and {r.host for r in got.collect()} == {"a.example", "b.example", ""}
    archive.write_archive(pages.where("page_id = 1"), at)
    assert got.count() == 5 and archive.read_archive(spark, at).count() == 6
    archive.write_archive(pages.where("page_id > 3"), at, mode="overwrite")
    assert {r.page_id for r in archive.read_archive(spark, at).collect()} == {4, 5}
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".warc.gz")]) <= 2
    archive.write_archive(pages.limit(0), at, mode="overwrite")
    assert archive.read_archive(spark, at).count() == 0


def test_many_small_shards_and_ranges(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    df = spark.range(500).selectExpr("id AS page_id", "concat('https://h', id % 7, '.example/', id) AS url", "repeat(concat('w', id, ' '), 100) AS html", "'z' AS other")
    archive.write_archive(df.repartition(2), at, shardBytes="5000")
    got = archive.read_archive(spark, at, splitBytes="1000")
    assert got.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, got.select("page_id", "url", "html").collect())) == sorted(map(tuple, df.select("page_id", "url", "html").collect()))


def test_hosts_are_pushed_down(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    df = spark.range(300).selectExpr("id AS page_id", "concat('https://h', id div 100, '.example/', id) AS url", "'x' AS html")
    archive.write_archive(df.repartitionByRange(3, "page_id"), at)
    every, one = archive.read_archive(spark, at), archive.read_archive(spark, at).where("host = 'h1.example' AND page_id > 150")
    assert one.rdd.getNumPartitions() < every.rdd.getNumPartitions()
    assert "PushedFilters: [EqualTo(host,h1.example)]" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert one.count() == 49
    assert archive.read_archive(spark, at).where(F.col("host").isin("h0.example", "h2.example", "none")).count() == 200
    assert archive.read_archive(spark, at).where("host = 'none'").count() == 0


def test_a_failed_write_leaves_nothing_to_read(spark, pages, tmp_path):
    at = f"file://{tmp_path}/a"
    archive.write_archive(pages.limit(2), at)
    broken = pages.repartition(2).withColumn("html", F.expr("CASE WHEN page_id = 5 THEN raise_error('no') ELSE html END"))
    with pytest.raises(Exception):
        archive.write_archive(broken, at)
    assert archive.read_archive(spark, at).count() == 2


def test_archives_of_other_tools(spark, tmp_path):
    (tmp_path / "a").mkdir()
    part = lambda kind, url, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:{url}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    body = part("warcinfo", "x", b"software: y") + part("request", "http://c.example/", b"GET / HTTP/1.1\r\n\r\n") + part("response", "<http://c.example/>", b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>\xff</p>")
    (tmp_path / "a" / "one.warc.gz").write_bytes(gzip.compress(body))
    (tmp_path / "a" / "two.warc.gz").write_bytes(b"".join(gzip.compress(part("response", f"http://d.example/{i}", b"HTTP/1.1 503 No\r\n\r\nbusy")) for i in range(3)))
    got = archive.read_archive(spark, f"file://{tmp_path}/a")
    assert sorted((r.url, r.status, r.content_type, r.html) for r in got.collect()) == [("http://c.example/", 200, "text/html", "<p>�</p>")] + [(f"http://d.example/{i}", 503, None, "busy") for i in range(3)]
    assert got.where("host = 'd.example'").count() == 3


def test_request_logs(spark, tmp_path):
    at = f"{tmp_path}/har"
    data = [(1, "https://s.example/", s, "GET", f"/api/{s}", "application/json" if s % 2 else None, None, 200, f'{{"s":"{s}"}}') for s in range(25)] + [(2, None, 0, "POST", "https://o.example/", None, "text/x", None, None)]
    df = spark.createDataFrame(data, "page_id long, target string, seq long, method string, url string, accept string, content_type string, status int, answer string")
    archive.write_har(df, at, part=10)
    got = archive.read_har(spark, at)
    assert sorted((r.page_id, r.target, r.method, r.url, r.accept, r.content_type, r.status, r.answer) for r in got.collect() if r.page_id == 1) == sorted((d[0], d[1], *d[3:]) for d in data[:25])
    assert [r.url for r in got.where("page_id = 1").orderBy(F.substring("url", 6, 9).cast("int")).collect()] == [f"/api/{s}" for s in range(25)]
    two = got.where("page_id = 2").first()
    assert (two.method, two.content_type, two.status, two.answer, two.target) == ("POST", "text/x", None, None, None)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.har").write_text('not json\n{"log": {"entries": [{"request": {"method": "GET", "url": "u", "headers": [{"name": "ACCEPT", "value": "a"}, {"name": "accept", "value": "b"}]}}]}}\n{}\n')
    assert [(r.method, r.url, r.accept, r.page_id) for r in archive.read_har(spark, f"{tmp_path}/odd").collect()] == [("GET", "u", "a", None)]
