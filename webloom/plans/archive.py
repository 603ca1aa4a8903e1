"""Queries that write pages and requests to archives and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.storage import shared_dir
from webloom.plans.base import only, run_sql, table
from webloom.plans.ladder import REQUESTS
from webloom.sources import archive

HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
ANSWERED = f"SELECT page_id, 'page ' || CAST(page_id AS VARCHAR(20)) AS target, seq, method, url, accept, content_type, CASE WHEN seq % 6 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN seq % 5 > 0 THEN '{{\"seq\":' || CAST(seq AS VARCHAR(20)) || '}}' END AS answer FROM ({REQUESTS})"
ANSWERED = ANSWERED.replace("{{", "{").replace("}}", "}")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), at)
    return archive.read_archive(spark, at)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive."""
    return _archived(spark, sf_dir).select("page_id", "url", "host", "status", "content_type", F.md5("html").alias("html"))


def _of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the host that has most, by a filter that the archive takes over."""
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").selectExpr(f"{HOST} AS host")
    most = pages.groupBy("host").count().orderBy(F.desc("count"), "host").first()
    return _archived(spark, sf_dir).where(F.col("host") == (most.host if most else "")).select("page_id", "url", "host")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of all pages through request logs."""
    at = _place(spark, "requests")
    archive.write_har(run_sql(spark, sf_dir, ANSWERED), at)
    return archive.read_har(spark, at).select("page_id", "target", "method", "url", "accept", "content_type", F.col("status").cast("int").alias("status"), "answer")


only("archive_pages", "A03 B01 L05 L06", _round_trip, f"SELECT page_id, url, {HOST} AS host, 200 AS status, 'text/html; charset=utf-8' AS content_type, md5(html) AS html FROM pages")
only("archive_host", "A13 L05", _of_host, f"SELECT page_id, url, host FROM (SELECT *, {HOST} AS host FROM pages) WHERE host = (SELECT {HOST} AS h FROM pages GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)")
only("request_logs", "L07 M21", _requests, f"SELECT page_id, target, method, url, accept, content_type, status, answer FROM ({ANSWERED})")
