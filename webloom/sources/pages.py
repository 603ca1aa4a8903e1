"""Sources and sinks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of pages."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Raw HTML files as pages: the path below base_url is the URL; bytes that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.xxhash64("path").alias("page_id"), F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html")
    )


def write_by_host(pages: DataFrame, path: str, files: int = 64) -> None:
    """Pages clustered by host, with the host as a column that Parquet statistics can prune by."""
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))
    # a range over (host, id) splits a host that holds many pages over several files
    pages.withColumn("host", host).repartitionByRange(files, "host", "page_id").sortWithinPartitions("host").write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines, absent fields left out."""
    results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)
