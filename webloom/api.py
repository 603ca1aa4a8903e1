"""The engine's verbs over tables of acquired pages: scrape, map, crawl, discover, search and batch.

``python -m webloom scrape PAGES.parquet OUT`` and the like run them from a shell.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import records, signals
from webloom.functions.dialect import SPARK
from webloom.operators import crawl as _crawl
from webloom.operators import pages as _pages


@dataclass(frozen=True)
class Options:
    """What a verb does unless told otherwise."""

    formats: tuple[str, ...] = ("markdown",)
    only_main: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def over(self, given: dict) -> Options:
        """These options with the given ones in their place; names that are not options are ignored."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in self.__dataclass_fields__ and v is not None})


class PageSource(Protocol):
    """Where pages come from: anything that gives a DataFrame (page_id, url, html[, status, content_type])."""

    def pages(self, spark: SparkSession) -> DataFrame: ...


class TableSource:
    def __init__(self, path: str):
        self.path = path

    def pages(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def scrape(pages: DataFrame, options: Options = Options(), **given) -> DataFrame:
    o = options.over(given)
    unknown = set(o.formats) - set(_pages.FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    return _pages.scrape_pages(pages, formats=o.formats or ("markdown",), only_main=o.only_main, include=o.include, exclude=o.exclude)


def render(results: DataFrame, key: str = "page_id", formats: tuple[str, ...] = ("markdown",), as_json: bool = False, pretty: bool = False) -> DataFrame:
    """(key, output): bare Markdown where it alone was asked for and is there, else the row as JSON without nulls."""
    row = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "true", "pretty": str(pretty).lower()})
    markdown = F.col("markdown") if "markdown" in results.columns else F.lit(None).cast("string")
    return results.select(key, records.rendered(markdown, row, F.lit(as_json), F.lit(tuple(formats) == ("markdown",))).alias("output"))


def map_site(pages: DataFrame, site: str, limit: int = 5000, search: str | None = None, sitemap: DataFrame | None = None, ignore_sitemap: bool = False, sitemap_only: bool = False) -> DataFrame:
    """Distinct links to a site or what is below it, first seen first, limit within 1 and 100,000: those of the
    sitemap (url), then those of the pages. A site's map cannot both leave out its sitemap and be it alone."""
    if ignore_sitemap and sitemap_only:
        raise ValueError("ignore_sitemap and sitemap_only are mutually exclusive")
    host = F.lower(F.regexp_extract("link", "^https?://([^/?#:]*)", 1))
    found = _pages.tree_links(pages).select("link", F.struct(F.lit(1).alias("source"), F.col("page_id").cast("long").alias("page"), F.col("pos").cast("long").alias("pos")).alias("at"))
    if sitemap is not None and not ignore_sitemap:
        listed = sitemap.select(F.col("url").alias("link"), F.struct(F.lit(0).alias("source"), F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("pos")).alias("at"))
        found = listed if sitemap_only else listed.unionByName(found)
    elif sitemap_only:
        found = found.limit(0)
    links = found.withColumn("link", F.regexp_replace("link", "#.*$", "")).where((host == site.lower()) | F.endswith(host, F.lit("." + site.lower())))
    if search:
        links = links.where(F.contains(F.lower("link"), F.lit(search.lower())))
    first = links.groupBy("link").agg(F.min("at").alias("seen"))
    return first.orderBy("seen", "link").limit(min(max(limit, 1), 100_000)).select("link")


def scrape_mapped(pages: DataFrame, seed: str, limit: int = 10, options: Options = Options(), **given) -> DataFrame:
    """scrape() of the seed and of the mapped links of its site that are in the table, limit pages in all, with
    their place: the seed is the first. At most limit URLs are joined."""
    limit = min(max(limit, 1), 100)
    site = pages.sparkSession.sql("SELECT lower(regexp_extract(:u, '^https?://([^/?#:]*)', 1))", {"u": seed}).first()[0]
    plain = F.regexp_replace("url", "#.*$", "")
    rows = [seed.split("#")[0]] + [r.link for r in map_site(pages, site, limit=limit + 1).collect()]
    listed = list(dict.fromkeys(rows))
    order = pages.sparkSession.createDataFrame(list(enumerate(listed)), "place int, wanted string")
    there = pages.join(F.broadcast(order), plain == F.col("wanted")).orderBy("place", "page_id").limit(limit)
    places = there.select("page_id", "place")
    return scrape(there.drop("place", "wanted"), options, **given).join(F.broadcast(places), "page_id")


def discover(intercepts: DataFrame, limit: int = 20) -> DataFrame:
    """The ranked requests of every page, its best first, at most limit; replay marks the one to be run again: the
    first that is worth it and safe. intercepts: (page_id, seq, target, url, method, accept, content_type)."""
    name = f"intercepts_{uuid.uuid4().hex}"
    plain = intercepts.select("page_id", "seq", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("target", "url", "method", "accept", "content_type")))
    plain.createOrReplaceTempView(name)
    try:
        scored = intercepts.sparkSession.sql(signals.scored(SPARK, f"SELECT * FROM {name}"))
    finally:
        intercepts.sparkSession.catalog.dropTempView(name)
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "seq")
    fit = F.col("replayable") & (F.col("score") >= signals.MIN_VIABLE)
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).withColumn("first_fit", F.min(F.when(fit, F.col("rank"))).over(Window.partitionBy("page_id")))
    return ranked.select("page_id", "rank", "seq", F.upper(F.trim("method")).alias("method"), "url", "score", "replayable", F.coalesce(F.col("rank") == F.col("first_fit"), F.lit(False)).alias("replay"))


def crawl(pages: DataFrame, seed: str, limit: int = 10, **given) -> DataFrame:
    links = _pages.tree_links(pages).join(pages.select("page_id", "url"), "page_id").select("url", "pos", "link")
    return _crawl.crawl(links, seed, limit=min(max(limit, 1), 100), **given)


def search(results: DataFrame) -> DataFrame:
    """Hits of result pages (id, engine, url, html)."""
    return _pages.search_hits(results)


def batch(pages: DataFrame, urls: DataFrame, **given) -> DataFrame:
    """scrape() of the pages whose url is listed."""
    return scrape(pages.join(urls.select("url").distinct(), "url", "left_semi"), **given)
