"""Registry of queries that are written once for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.functions.dialect import DUCK, SPARK, Spark

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables that it names. A plan holds its tables from when it is analysed, so views of the
    same names may be replaced for another folder."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def both(name: str, operators: str, text: Callable[[Spark], str], compared: Callable[[Spark], str] | None = None) -> None:
    """Register a query whose SQL text both engines understand; operators: ids of the survey's inventory;
    compared: another text for the same rows, where a plainer one is at hand."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text(SPARK))
    ORACLE_SQL[name] = (compared or text)(DUCK)
    OPERATORS[name] = operators


def only(name: str, operators: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    OPERATORS[name] = operators
    if sql:
        ORACLE_SQL[name] = sql
