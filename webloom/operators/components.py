"""Connected components over an edge table, with the smallest vertex id as component id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component_id) for every vertex of ``edges`` (a, b: comparable ids).

    Alternating large-star and small-star steps; each step is one shuffle of at most as many rows as
    there are edges, minima are combined before the shuffle, and a hot vertex is met only as a key of
    partial aggregates and of a join that adaptive execution may split. Every round is written to the
    shared folder. Null ends and loops are ignored; repeated edges are harmless; an empty edge table
    gives an empty result. Raises RuntimeError when ``max_rounds`` do not converge (rounds grow with the
    logarithm of the longest path).
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = materialise(e, "cc-edges")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a vertex is tied to the vertex's smallest neighbour
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        big = (
            both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: a vertex and its smaller neighbours are tied to the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = materialise(small, "cc-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
