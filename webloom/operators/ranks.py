"""Row numbers within keys without a task that sorts a whole key.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows lies in many partitions, one after the other. Each partition numbers the rows
of its keys; a key's counts in earlier partitions are added to those of a later one. Only the first key of a partition can have begun in an
earlier one, so there are no more such offsets than partitions, and they are broadcast. The ranges are written to the shared folder, as both passes must see the same ones.

Equal order values share one range boundary and may be numbered in any order, so ``order`` should end with what tells rows apart; rows that are equal in all of it
are numbered in any order, as by a window. Null keys are one key. An empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.storage import materialise


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with ``name`` (long), the row number within its keys, from 1."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.sum("_n").over(before).alias("_before")).where("_before > 0")
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    local = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    met = local.join(F.broadcast(offsets.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & same, "left")
    return met.select(*df.columns, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
