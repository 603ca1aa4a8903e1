"""Registered queries over the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans import archive, content, jobs, ladder, markup, requests, results, searches, site, streams, web  # noqa: F401
from webloom.plans.base import OPERATORS, ORACLE_SQL, QUERIES, table


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        OPERATORS.setdefault(name, "D01 F01 E34 J08")
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "site_links",
    r"""
    WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
                      regexp_extract(url, '^(https?)://', 1) AS scheme,
                      unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
         r AS (SELECT page_id, host, CASE WHEN href LIKE '/%' THEN scheme || '://' || host || href ELSE href END AS link FROM l),
         g AS (SELECT host, link, count(DISTINCT page_id) AS n_pages FROM r
               WHERE regexp_extract(link, '^https?://([^/?#]+)', 1) = host GROUP BY 1, 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_pages DESC, link) AS rank FROM g)
    SELECT host, link, n_pages, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 10
    """,
)
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten distinct same-site links of every site, by linking pages."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    links = table(spark, sf_dir, "pages").select(
        "page_id",
        host(F.col("url")).alias("host"),
        F.regexp_extract("url", r"^(https?)://", 1).alias("scheme"),
        F.explode(F.expr("""regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)""")).alias("href"),
    )
    resolved = links.select(
        "page_id", "host", F.when(F.col("href").startswith("/"), F.concat("scheme", F.lit("://"), "host", "href")).otherwise(F.col("href")).alias("link")
    ).where(host(F.col("link")) == F.col("host"))
    counted = resolved.groupBy("host", "link").agg(F.countDistinct("page_id").alias("n_pages"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n_pages"), "link"))
    return counted.withColumn("rank", rank.cast("long")).where("rank <= 10")
