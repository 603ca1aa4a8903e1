import random
import time

import pytest

from webloom.operators.components import connected_components
from webloom.operators.crawl import crawl
from webloom.sources import pages as source
from webloom.streaming import sessions

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = sorted((x, find(x)) for x in parent)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, connected_components(df).collect())) == want
    assert connected_components(df.limit(0)).collect() == []


def model(links, seed, depth, limit):
    """The queue, one page at a time."""
    out, seen, queue = [(seed, 0)], {seed}, [(seed, 0)]
    while queue:
        url, d = queue.pop(0)
        for link in links.get(url, []) if d < depth else []:
            link = link.split("#")[0]
            if link.startswith("https://h/") and link not in seen and len(seen) < limit:
                seen.add(link)
                out.append((link, d + 1))
                queue.append((link, d + 1))
    return out


@pytest.mark.parametrize("depth,limit", [(0, 10), (1, 5), (2, 12), (3, 40)])
def test_crawl_follows_the_queue(spark, depth, limit):
    rng = random.Random(depth)
    urls = [f"https://h/{i}" for i in range(30)]
    links = {u: [rng.choice([*urls, "https://other/x", "mailto:a"]) + rng.choice(["", "#f"]) for _ in range(6)] for u in urls}
    rows = [(u, i, v) for u, vs in links.items() for i, v in enumerate(vs)]
    got = crawl(spark.createDataFrame(rows, "url string, pos int, link string"), urls[0], depth, limit).orderBy("place").collect()
    assert [(r.url, r.depth) for r in got] == model(links, urls[0], depth, limit)
    assert [r.place for r in got] == list(range(len(got)))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.where("user_id < 40").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("s", sessions.session_counts(stream), "complete"), ("j", sessions.job_progress(stream), "complete")):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
        want = (sessions.session_counts if name == "s" else sessions.job_progress)(batch)
        assert sorted(map(str, spark.table(f"out_{name}").collect())) == sorted(map(str, want.collect()))
    log = str(tmp_path / "sent")

    def deliver(payloads):
        with open(log, "a") as f:
            f.writelines(x + "\n" for x in payloads)

    q = sessions.webhook_sink(stream, deliver, ("view",), str(tmp_path / "ck"))
    q.awaitTermination(120)
    with open(log) as f:
        assert len(f.readlines()) == batch.where("event_type = 'view'").count()


def test_sources(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"<p>ok</p>")
    row = source.read_files(spark, str(tmp_path / "raw"), "https://h").first()
    assert row.url == "https://h/a.html" and row.html == "<p>ok</p>"
    pages = source.read_pages(spark, f"{DIR}/pages.parquet")
    source.write_by_host(pages, str(tmp_path / "out"), 4)
    back = source.read_pages(spark, str(tmp_path / "out"))
    assert back.count() == pages.count() and "host" in back.columns
    assert "PushedFilters: [IsNotNull(host), EqualTo(host" in back.where("host = 'x'")._jdf.queryExecution().executedPlan().toString()
    source.write_results(pages.selectExpr("page_id", "nullif(url, url) AS gone"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first().value.startswith('{"page_id":')


def test_session_store(spark, tmp_path):
    first = [(1, "2024-01-01 00:00:00", "open"), (1, "2024-01-01 00:00:30", "click"), (1, "2024-01-01 00:02:00", "open"), (2, "2024-01-01 00:00:00", "open"), (2, "2024-01-01 00:00:05", "close")]
    later = [(3, "2024-01-01 01:00:00", "open")]
    for i, rows in enumerate((first, later, [(3, "2024-01-01 01:00:10", "click")])):
        spark.createDataFrame(rows, "session_id long, ts string, type string").selectExpr("session_id", "cast(ts AS timestamp) ts", "type").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        time.sleep(0.05)
    stream = spark.readStream.schema("session_id long, ts timestamp, type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = sessions.session_store(stream).writeStream.format("memory").queryName("store").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.session_id, r.n, r.state) for r in spark.table("store").collect())
    # the silent second session of 1 expires by the clock of the others' events
    assert got == [(1, 1, "expired"), (1, 1, "open"), (1, 2, "expired"), (2, 2, "closed"), (3, 1, "open"), (3, 2, "open")]


def test_bad_patterns_are_named(spark):
    links = spark.createDataFrame([("https://h/", 0, "https://h/a"), ("https://h/", 1, "https://h/b"), ("https://h/", 2, "https://h/c/a")], "url string, pos int, link string")
    with pytest.raises(ValueError, match=r"invalid excludePaths pattern '\(x'"):
        crawl(links, "https://h/", exclude=["ok", "(x"])
    with pytest.raises(ValueError, match="invalid includePaths pattern"):
        crawl(links, "https://h/", include="[")
    assert sorted(r.url for r in crawl(links, "https://h/", include=["^/a", "^/b", "^/c"], exclude=["^/c/"]).collect()) == ["https://h/", "https://h/a", "https://h/b"]


def test_verbs(spark):
    from webloom import api
    from webloom.functions.values import describe

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    assert api.scrape(pages, only_main=False).where("length(markdown) > 100").count() == pages.count()
    with pytest.raises(ValueError):
        api.scrape(pages, formats=["bogus"])
    site = pages.selectExpr("regexp_extract(url, '://([^/]*)', 1) h").first().h
    assert 0 < api.map_site(pages, site, limit=3).count() <= 3
    assert api.batch(pages, pages.limit(2)).count() == pages.join(pages.limit(2).select("url"), "url", "left_semi").count()
    assert api.Options().over({"only_main": False, "nope": 1, "include": ["a"]}) == api.Options(only_main=False, include=("a",))
    assert describe({"a": list(range(2000))})["a"][-1] == 999 and describe("x" * 99, budget=10)["truncated"] == "str"
    assert describe([[[[[[[1]]]]]]]) == [[[[[[{"truncated": "array", "size": 1}]]]]]]


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "b.html").write_bytes(b"<p>a\xff\xfeb\xc3</p>")
    row = source.read_files(spark, str(tmp_path / "raw"), "https://h/").first()
    assert (row.url, row.html) == ("https://h/b.html", "<p>a\ufffd\ufffdb\ufffd</p>")
