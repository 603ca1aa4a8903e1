"""Queries of the page engine, which SQL cannot express, and relational ones on the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.dialect import DUCK
from webloom.operators import crawl as c
from webloom.operators import markup
from webloom.operators import pages as p
from webloom.plans.base import both, only, table
from webloom.plans.markup import LANGUAGE, TITLE
from webloom.plans.web import _links
from webloom.streaming import sessions

SCHEMA = {"title": "h1", "paragraphs": {"selector": "article p", "all": True}, "menu": {"selector": "nav li", "all": True, "fields": {"text": "a", "href": {"selector": "a", "attr": "href"}}}, "none": ".missing"}
RESULTS = (
    ("duckduckgo", "https://html.duckduckgo.com/", '<a class="result__a" href="/l/?uddg=https%3A%2F%2Fa.example%2F1">One &amp; two</a><a class="result__snippet">first</a><a class="result__a">no link</a><a class="result__a" href="https://b.example">B</a>'),
    ("bing", "https://www.bing.com/", '<ol><li class="b_algo"><h2><a href="https://a.example/">A</a></h2><div class="b_caption"><p>text a</p></div></li><li class="b_algo"><p>none</p></li></ol>'),
    ("brave", "https://search.brave.com/", '<div class="snippet" data-type="web"><a class="l1" href="https://c.example/">x<div class="title">C</div></a><div class="content">text c</div></div>'),
    ("baidu", "https://www.baidu.com/", '<div class="result c-container"><h3><a href="http://d.example/">D</a></h3><span class="content-right_x">text d</span></div>'),
    ("zapmeta", "https://z.example/", "<article><h2><a href='https://e.example/'>E</a></h2><p>text e</p></article>"),
    ("yandex", "https://yandex.example/", '<li class="serp-item"><h2><a href="https://f.example/">F</a></h2><div class="TextContainer">text f</div></li>'),
    ("mojeek", "https://m.example/", '<ul class="results-standard"><li><a class="title" href="https://g.example/">G</a><p>text g</p></li></ul>'),
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(RESULTS)]
    return p.search_hits(spark.createDataFrame(rows, "id long, engine string, url string, html string"))


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first page: its site's links, two levels deep, every page of the site being linked from it."""
    pages = _pages(spark, sf_dir)
    seed = pages.agg(F.min_by("url", "page_id")).first()[0]
    links = p.tree_links(pages).join(pages.select("page_id", "url"), "page_id").select("url", "pos", "link")
    site = pages.select(F.lit(seed).alias("url"), (F.col("page_id") + 1000).alias("pos"), F.col("url").alias("link"))
    return c.crawl(links.unionByName(site), seed, limit=100)


def _site_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links of all pages, every page of a host being linked from the host's first one too; and those first ones."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1))
    pages = _pages(spark, sf_dir).where("url IS NOT NULL")
    firsts = pages.groupBy(host.alias("host")).agg(F.min_by("url", "page_id").alias("seed"))
    links = markup.links(pages).join(pages.select("page_id", "url"), "page_id").select("url", "pos", "link")
    site = pages.select(host.alias("host"), "page_id", F.col("url").alias("link")).join(firsts, "host").select(F.col("seed").alias("url"), (F.col("page_id") + 1000).alias("pos"), "link")
    return links.unionByName(site), firsts.select("seed")


def _crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawls of all hosts in one run."""
    return c.crawl_all(*_site_links(spark, sf_dir), limit=20, exclude="/the$")


_HOST = "lower(regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1))"


def _two_levels(seeds: str, site: str, limit: int, kept: str) -> str:
    """Common tables of crawls two levels deep, the last one d2: seeds (seed), site: links besides the pages' own, kept: what a link must meet."""
    level = """f{1} AS MATERIALIZED (SELECT l.seed, e.url, min(l.place * 100000000 + e.pos) AS o FROM e JOIN {0} l ON l.url = e.parent WHERE e.host = {2} AND NOT EXISTS (SELECT 1 FROM d{3} d WHERE d.seed = l.seed AND d.url = e.url) GROUP BY l.seed, e.url),
        l{1} AS MATERIALIZED (SELECT seed, url, {1} AS depth, have + n - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY o, url) AS n FROM f{1}) JOIN (SELECT seed, count(*) AS have FROM d{3} GROUP BY seed) USING (seed) WHERE have + n <= {4}),
        d{1} AS MATERIALIZED (SELECT * FROM d{3} UNION ALL SELECT * FROM l{1})"""
    return f"""WITH p AS (SELECT *, {_HOST.format("url")} AS host FROM pages WHERE url IS NOT NULL), s AS MATERIALIZED ({seeds}),
        raw AS (SELECT p.url AS parent, l.pos, l.link AS url FROM ({_links(DUCK)}) l JOIN p ON p.page_id = l.page_id UNION ALL {site}),
        e AS MATERIALIZED (SELECT *, {_HOST.format("url")} AS host FROM (SELECT regexp_replace(parent, '#.*$', '') AS parent, pos, regexp_replace(url, '#.*$', '') AS url FROM raw) WHERE regexp_matches(url, '^https?://[^/]') AND {kept}),
        d0 AS MATERIALIZED (SELECT DISTINCT regexp_replace(seed, '#.*$', '') AS seed, regexp_replace(seed, '#.*$', '') AS url, 0 AS depth, 0 AS place FROM s),
        {level.format("d0", 1, _HOST.format("l.seed"), 0, limit)}, {level.format("l1", 2, _HOST.format("l.seed"), 1, limit)}"""


def _crawls_plain() -> str:
    kept = "NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/the$')"
    tables = _two_levels("SELECT host, arg_min(url, page_id) AS seed FROM p GROUP BY host", "SELECT s.seed, p.page_id + 1000, p.url FROM p JOIN s ON s.host = p.host", 20, kept)
    return f"{tables} SELECT seed, url, CAST(depth AS INT) AS depth, CAST(place AS INT) AS place FROM d2"


def _crawl_plain() -> str:
    tables = _two_levels("SELECT arg_min(url, page_id) AS seed FROM p", "SELECT s.seed, p.page_id + 1000, p.url FROM p, s", 100, "true")
    return f"{tables} SELECT url, CAST(depth AS INT) AS depth, CAST(place AS INT) AS place FROM d2"


# What the given pages hold, which have plain markup: for the comparison with the tree.
_METADATA = f"""WITH t AS (SELECT page_id, url, {TITLE} AS title, {LANGUAGE} AS lang FROM pages)
    SELECT page_id, '{{' || CASE WHEN title = '' THEN '' ELSE '"title": ' || CAST(to_json(title) AS VARCHAR) || ', ' END || CASE WHEN lang = '' THEN '' ELSE '"language": "' || lang || '", ' END
    || '"sourceURL": ' || CAST(to_json(url) AS VARCHAR) || ', "url": ' || CAST(to_json(url) AS VARCHAR) || ', "statusCode": 200, "contentType": "text/html"}}' AS metadata FROM t"""
_TREE_LINKS = f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, link FROM ({_links(DUCK)})"
_SCRIPTS = """SELECT page_id, pos - 1 AS pos, 'classic' AS kind, CAST(NULL AS VARCHAR) AS src, length(body) AS chars
    FROM (SELECT page_id, unnest(s) AS body, generate_subscripts(s, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS s FROM pages))"""
_STATE = """SELECT page_id, 'nuxt' AS origin, '{"a": "}"}' AS data FROM pages WHERE page_id % 2 = 0"""


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("rendered_html", F.when(F.col("page_id") % 3 == 0, F.lit("<p>Loading</p>")).when(F.col("page_id") % 3 == 1, F.concat("html", F.lit("<p>more</p>"))))
    return p.with_rendered(pages)


only("markdown_pages", "C01 C02 C03 C04 C05 C07 C10 C14 C15 C16 C19 C30 C31 A03", lambda s, d: p.scrape_pages(_pages(s, d), formats=("markdown",)).select("page_id", "markdown", "incomplete", "error"))
only("page_metadata", "C22 C23 C24 C25 C26 C27", lambda s, d: p.scrape_pages(_pages(s, d), formats=("metadata",)).select("page_id", "metadata"), _METADATA)
only("cleaned_html", "C12 C09 F03", lambda s, d: p.scrape_pages(_pages(s, d), formats=("html",)).select("page_id", "html"))
only("filtered_html", "C13 K05 K06 M10 G09 G10", lambda s, d: p.scrape_pages(_pages(s, d), formats=("html",), include=("article", "h1"), exclude=("b", ".ad")).select("page_id", "html"))
only("schema_rows", "D17 D18 D19 D20 D21 L09", lambda s, d: p.schema_rows(_pages(s, d), SCHEMA))
only("page_state", "D04 D07 D08 D09 D10", lambda s, d: p.page_state(_pages(s, d).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit('<script>window.__NUXT__ = {"a": "}"};</script>'))).otherwise(F.col("html")))), _STATE)
only("script_inventory", "D22 D23", lambda s, d: p.page_scripts(_pages(s, d)), _SCRIPTS)
only("tree_links", "D01 C09 C10", lambda s, d: p.tree_links(_pages(s, d)), _TREE_LINKS)
only("search_results", "D26 D27 D28 D29 D30 D31 D32 D33 D34 D36 F08 F16 F17 L04", _results)
only("readable_pages", "C14", lambda s, d: p.main_content(_pages(s, d)).select("page_id", "text", F.length("text").alias("chars")))
only("crawl", "K02 E30 E31 L16 G03", _crawl, _crawl_plain())
only("crawl_sites", "K02 K03 G03 E30", _crawls, _crawls_plain())
only("rendered_choice", "M04 C28 E18 E13", _rendered)
only(
    "session_windows",
    "H06",
    lambda s, d: sessions.session_counts(table(s, d, "events")).select("user_id", "n", F.unix_micros(F.col("opened").cast("timestamp")).alias("opened")),
    """SELECT user_id, n, opened FROM (SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS opened FROM (
         SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
         FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g)""",
)

# Plumbing on the other tables: joins, aggregates and windows that Catalyst brings along.
both("orders_by_nation", "plumbing", lambda d: "SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
both("pricing_summary", "plumbing", lambda d: "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
