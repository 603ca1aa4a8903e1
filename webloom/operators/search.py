"""Metasearch answers as results: fused hits of every search, diagnostics of its engines, and failure where all of them failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import records, urlparse, urls
from webloom.functions.dialect import SPARK as S

#: How many results there are unless told otherwise, and what is said when no engine answered.
LIMIT, MOST = 5, 100
FAILED = "all search engines failed"


def fused(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(search, position, title, description, url, score) of hits (search, engine, rank, title, description, url): the best of each search by the sum of its engines'
    reciprocal ranks. A key's hits are combined by aggregates before they move; of a search only ``limit`` rows leave a task."""
    named = hits.where("url IS NOT NULL AND rank > 0").select("search", "engine", "rank", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), "url")
    keyed = named.select("*", F.explode(F.array(F.expr(urlparse.canonical_key("url", urls.is_tracking(S, "n"))))).alias("k"))
    rich = F.octet_length(F.trim("title")) + F.octet_length(F.trim("description"))
    first = F.min(F.struct("rank", (-rich).alias("poor"), "url", "title", "engine", "description"))
    per = keyed.groupBy("search", "k", "engine").agg(F.min("rank").alias("best"), first.alias("o"))
    one = per.groupBy("search", "k").agg(F.round(F.sum(1.0 / F.col("best")), 9).alias("score"), F.min("best").alias("best"), F.min("o").alias("o"))
    order = Window.partitionBy("search").orderBy(F.desc("score"), "best", "o.url", "o.title", "o.engine")
    return one.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("search", "position", "o.title", "o.description", "o.url", "score")


def answered(outcomes: DataFrame, hits: DataFrame, limit: int | None = None, scraped: DataFrame | None = None) -> DataFrame:
    """(search, success, error, results, engines) of every search: outcomes (search, place, engine, timed_out, code, message, hits) say how its engines did; a search that no engine answered
    has failed, any other gives what the rest found. results are structs (title, description, url, and content where
    ``scraped`` (url, content) has the page), engines are JSON texts in their order; limit lies within 1 and 100, 5 unless given."""
    limit = min(max(limit if limit is not None else LIMIT, 1), MOST)
    said = records.engine_outcome(*map(F.col, ("engine", "timed_out", "code", "message", "hits")))
    fine = ~F.col("timed_out") & F.col("message").isNull() & F.col("code").between(200, 299) & (F.col("hits") > 0)
    per = outcomes.groupBy("search").agg(F.bool_or(F.coalesce(fine, F.lit(False))).alias("success"), F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("e"))
    found = fused(hits, limit)
    if scraped is not None:
        once = scraped.groupBy("url").agg(F.min("content").alias("content"))
        found = found.join(once, "url", "left")
    else:
        found = found.withColumn("content", F.lit(None).cast("string"))
    lists = found.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("position", "title", "description", "url", "content"))).alias("r"))
    out = per.join(lists, "search", "left")
    none = F.array().cast("array<struct<title:string,description:string,url:string,content:string>>")
    results = F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), x["url"].alias("url"), x["content"].alias("content")))
    return out.select(
        "search", "success", F.when(~F.col("success"), F.lit(FAILED)).alias("error"), F.when(F.col("success") & F.col("r").isNotNull(), results).otherwise(none).alias("results"), F.transform("e", lambda x: x["said"]).alias("engines")
    )
