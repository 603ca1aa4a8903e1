"""Row numbers by ranges against a window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.operators.ranks import numbered


@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
def test_equals_a_window(spark, keys):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE CAST(id % 40 AS STRING) END AS k", "id % 2 AS g", "CASE WHEN id % 17 = 0 THEN NULL ELSE (id * 7919) % 100 END AS v", "'x' AS _n")
    order = [F.desc("v"), F.asc("id")]
    got = numbered(df, keys, order)
    assert got.columns == [*df.columns, "rank"]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_lies_in_many_ranges(spark):
    df = spark.range(20_000).selectExpr("id", "'one' AS k")
    got = numbered(df, ["k"], [F.asc("id")])
    assert got.where("rank <> id + 1").count() == 0
    sizes = df.repartitionByRange(4, "k", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 10_000


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "k string, v int"), ["k"], [F.asc("v")]).collect() == []
