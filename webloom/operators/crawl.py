"""Bounded breadth-first crawl over a table of pages."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.storage import materialise

MAX_DEPTH, LIMIT = 2, 10


def checked_patterns(spark: SparkSession, patterns: str | Sequence[str] | None, field: str) -> list[str]:
    """The patterns, each tried by the engine that will run it; ValueError names the field and the first bad one."""
    out = [patterns] if isinstance(patterns, str) else list(patterns or ())
    for p in out:
        try:
            spark.range(1).select(F.lit("").rlike(p)).collect()
        except Exception as e:
            raise ValueError(f"invalid {field} pattern {p!r}: {str(e).splitlines()[0]}") from e
    return out


def crawl(links: DataFrame, seed: str, max_depth: int = MAX_DEPTH, limit: int = LIMIT, include: str | Sequence[str] | None = None, exclude: str | Sequence[str] | None = None, same_host: bool = True) -> DataFrame:
    """(url, depth, place) in the order of a queue that starts with seed. ``links`` has (url, pos, link): a page's
    links in order; a link without such rows is a leaf. A level is one join, one dedupe and one ordered limit,
    and places are given by (parent's place, position), so the order is the queue's own. A path is followed when one
    of the include patterns is found in it, or there are none, and none of the exclude patterns; a pattern that is not
    one raises ValueError.

    At most ``limit`` pages are ever admitted, so the frontier that is joined is bounded by it."""
    spark = links.sparkSession
    plain = lambda c: F.regexp_replace(c, "#.*$", "")
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    edges = links.select(plain(F.col("url")).alias("parent"), "pos", plain(F.col("link")).alias("url")).where(F.col("url").rlike("^https?://[^/]"))
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    if same_host:
        edges = edges.where(host(F.col("url")) == host(F.lit(seed)))
    for pattern in checked_patterns(spark, exclude, "excludePaths"):
        edges = edges.where(~path.rlike(pattern))
    if wanted := checked_patterns(spark, include, "includePaths"):
        edges = edges.where(functools.reduce(operator.or_, (path.rlike(p) for p in wanted)))
    done = spark.createDataFrame([(seed.split("#")[0], 0, 0)], "url string, depth int, place int")
    level, n = done, 1
    for depth in range(1, max_depth + 1):
        if n >= limit:
            break
        found = edges.join(F.broadcast(level.select(F.col("url").alias("parent"), F.col("place").alias("p"))), "parent")
        fresh = found.groupBy("url").agg(F.min(F.struct("p", "pos")).alias("o")).join(F.broadcast(done.select("url")), "url", "left_anti")
        # the ordered limit comes first, so that the numbering sees few rows
        kept = fresh.orderBy("o", "url").limit(limit - n)
        level = materialise(kept.select("url", F.lit(depth).alias("depth"), (F.row_number().over(Window.orderBy("o", "url")) + n - 1).cast("int").alias("place")), "crawl")
        n += level.count()
        done = done.union(level)
    return done


def crawl_all(links: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, limit: int = LIMIT, include: str | Sequence[str] | None = None, exclude: str | Sequence[str] | None = None, same_host: bool = True) -> DataFrame:
    """(seed, url, depth, place): the crawls of all ``seeds`` (seed) at once, each with the rows that ``crawl`` gives for it alone.

    One round a level, however many seeds there are: the frontier of all crawls meets the links by an equi-join, so neither side is broadcast
    unless it is known to be small; links found by several parents are one row before they are compared with what is visited; and
    the first of each crawl are ranked with a limit, so at most ``limit`` rows a crawl leave a task. Only new pages are joined in the next round. The visited set is at most
    ``limit`` rows a seed, laid out by (seed, url) as the round needs it.

    Defined results: null seeds are left out, repeated ones and those that differ in their fragment are one; a seed without links is a crawl of one page; an empty table gives an empty one."""
    spark = links.sparkSession
    plain = lambda c: F.regexp_replace(c, "#.*$", "")
    host = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    edges = links.select(plain(F.col("url")).alias("parent"), "pos", plain(F.col("link")).alias("url")).where(F.col("url").rlike("^https?://[^/]"))
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    for pattern in checked_patterns(spark, exclude, "excludePaths"):
        edges = edges.where(~path.rlike(pattern))
    if wanted := checked_patterns(spark, include, "includePaths"):
        edges = edges.where(functools.reduce(operator.or_, (path.rlike(p) for p in wanted)))
    if same_host:
        edges = edges.withColumn("host", host(F.col("url")))
    edges = materialise(edges, "crawl-edges")
    done = materialise(seeds.where("seed is not null").select(plain(F.col("seed")).alias("seed")).distinct().select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("place")), "crawl-all")
    level = done
    for depth in range(1, max_depth + 1):
        found = edges.join(level.select("seed", F.col("url").alias("parent"), F.col("place").alias("p")), "parent")
        if same_host:
            found = found.where(F.col("host") == host(F.col("seed")))
        fresh = found.groupBy("seed", "url").agg(F.min(F.struct("p", "pos")).alias("o")).join(done.select("seed", "url"), ["seed", "url"], "left_anti")
        # the limit is the same for every crawl here, so tasks can apply it before the shuffle; what a crawl has left of it follows
        first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("o", "url"))).where(F.col("n") <= limit)
        have = done.groupBy("seed").agg(F.count("*").alias("have"))
        kept = first.join(have, "seed").where(F.col("have") + F.col("n") <= limit)
        level = materialise(kept.select("seed", "url", F.lit(depth).alias("depth"), (F.col("have") + F.col("n") - 1).cast("int").alias("place")), "crawl-all")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done
