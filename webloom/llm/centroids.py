"""Centroid clustering in whole numbers: float32 products screen the centroids, exact integers decide.

A vector's component x is the integer floor(1024 * x). For each vector a float32 matrix product gives its
squared distance to every centroid, less its own square, within an interval that holds the exact value: the error of a
product of 64 terms is at most gamma(66) times the product of the norms, in whatever order it is added up. A centroid whose
interval lies apart below all others is the nearest; where intervals overlap, the centroids among them are
compared by exact integers, ties to the smaller number. Tasks hand on exact sums per cluster (at most 8 x 66 numbers a task, split
into 40-bit parts that sum in longs), so vectors never move, and results do not depend on how rows fall into tasks.

Components beyond 2^27 are computed in Python's unbounded integers; a distance or inertia beyond the range of long is
given as the largest long. Rounds end early when no centroid moves, as further ones would change nothing.

Defined results: vectors that are null, of another length, or with a component that is null, not finite or not finite times 1024 are left out;
vectors with null ids are assigned, but start no centroid unless others are too few; repeated rows are vectors of their own; equal hashes (repeated ids) are
ordered by their components; with fewer than 8 vectors there are as many centroids; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table

DIM = 64
CENTROIDS = 8
ROUNDS = 10
SALT = "3"
SCALE = 1024
#: Components up to here have distances that fit in 64 bits.
SAFE = 1 << 27
LONG_MAX = (1 << 63) - 1
#: Bound of the relative error of a float32 product of DIM terms whose factors are rounded too.
GAMMA = (DIM + 2) * 2.0**-24 / (1 - (DIM + 2) * 2.0**-24)
LIMB, LIMBS = 40, 5
COUNT, DISTANCE = DIM, DIM + 1


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that are clustered, x as doubles."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") == DIM) & fine)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k kept vectors with the smallest hashes, in their order."""
    name = F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "x").limit(k).collect()
    return [[int(c) for c in np.floor(np.array(r["x"]) * SCALE).tolist()] for r in rows]


def screen(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be a vector's nearest: those whose interval reaches below every other's upper end.
    v, c: whole numbers up to SAFE as float64."""
    dot = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(axis=1)
    norms = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt(square)[None]
    # the second term covers the rounding of the norms and of this float64 difference
    error = 2 * GAMMA * norms * (1 + 1e-9) + 2.0**-48 * (square[None] + norms)
    about = square[None] - 2 * dot
    return about - error <= (about + error).min(axis=1)[:, None]


def assign(v: np.ndarray, centroids: list[list[int]], distances: bool = False) -> tuple[np.ndarray, list[int] | np.ndarray | None]:
    """The nearest centroid of each row of v (whole numbers as float64), and the exact squared distances if asked for."""
    small = np.abs(v).max(axis=1, initial=0) <= SAFE
    if max(abs(x) for c in centroids for x in c) > SAFE:
        small[:] = False
    cluster = np.zeros(len(v), np.int64)
    far: dict[int, int] = {}
    for i in np.flatnonzero(~small):
        row = [int(x) for x in v[i].tolist()]
        d = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
        far[int(i)] = min(d)
        cluster[i] = d.index(min(d))
    if small.any():
        at = np.flatnonzero(small)
        x, c = v[at], np.array(centroids, np.float64)
        may = screen(x, c)
        best = may.argmax(axis=1)
        unsure = np.flatnonzero(may.sum(axis=1) > 1)
        xi, ci = x.astype(np.int64), np.array(centroids, np.int64)
        if len(unsure):
            exact = np.stack([((xi[unsure] - m) ** 2).sum(axis=1) for m in ci], axis=1)
            best[unsure] = np.where(may[unsure], exact, LONG_MAX).argmin(axis=1)
        cluster[at] = best
        if distances:
            near = ((xi - ci[best]) ** 2).sum(axis=1)
            if not far:
                return cluster, near
            far |= dict(zip(at.tolist(), near.tolist(), strict=True))
    return cluster, [far[i] for i in range(len(v))] if distances else None


def limbs(x: int) -> list[int]:
    """x as LIMBS numbers that add up part by part; the last carries the sign."""
    return [(x >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [x >> (LIMB * (LIMBS - 1))]


def whole(parts: list[int]) -> int:
    return sum(int(p) << (LIMB * i) for i, p in enumerate(parts))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.floor(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM) * SCALE)


def _sums(centroids: list[list[int]], distances: bool):
    """mapInArrow: the task's exact sums of components, counts and, if asked for, distances by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                v = _rows(b.slice(at, 8192))
                cluster, d = assign(v, centroids, distances)
                for j in np.unique(cluster).tolist():
                    m = cluster == j
                    mine = v[m]
                    if np.abs(mine).max() <= SAFE:
                        part = mine.astype(np.int64).sum(axis=0).tolist()
                    else:
                        part = [sum(map(int, c)) for c in mine.T.tolist()]
                    part += [int(m.sum()), sum(int(d[i]) for i in np.flatnonzero(m)) if distances else 0]
                    total[j] = [x + y for x, y in zip(total[j], part, strict=True)] if j in total else part
        if total:
            rows = [(j, what, *limbs(x)) for j, t in total.items() for what, x in enumerate(t)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in columns[:2]] + [pa.array(c, pa.int64()) for c in columns[2:]],
                names=["cluster", "what"] + [f"p{i}" for i in range(LIMBS)],
            )

    return run


def sums(vectors: DataFrame, centroids: list[list[int]], distances: bool = False) -> dict[int, dict[int, int]]:
    """Exact sums by cluster: components by their number, COUNT and DISTANCE."""
    schema = "cluster int, what int, " + ", ".join(f"p{i} long" for i in range(LIMBS))
    rows = vectors.select("x").mapInArrow(_sums(centroids, distances), schema).groupBy("cluster", "what").agg(*[F.sum(f"p{i}") for i in range(LIMBS)]).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], {})[r["what"]] = whole(list(r[2:]))
    return out


def moved(centroids: list[list[int]], found: dict[int, dict[int, int]]) -> list[list[int]]:
    """Each centroid that has vectors becomes their componentwise floored mean."""
    return [[found[j][i] // found[j][COUNT] for i in range(DIM)] if j in found else c for j, c in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    use = kept(vectors)
    at = first_centroids(use, k)
    if not at:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        then = moved(at, sums(use, at))
        if then == at:
            break
        at = then
    found = sums(use, at, distances=True)
    own = [min(LONG_MAX, found.get(j, {}).get(DISTANCE, 0)) for j in range(len(at))]
    every = min(LONG_MAX, sum(x.get(DISTANCE, 0) for x in found.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, d = assign(_rows(b), at, distances=True)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").cast(pa.int64()),
                    pa.array(c.astype(np.int32)),
                    pa.array([min(LONG_MAX, int(x)) for x in d], pa.int64()),
                    pa.array([own[j] for j in c.tolist()], pa.int64()),
                    pa.array([every] * len(c), pa.int64()),
                    pa.array([names[j] for j in c.tolist()]),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return use.mapInArrow(run, schema)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def sql() -> str:
    """The same by plain joins of all vectors with the centroids, a round after another."""
    parts = [
        f"""v AS MATERIALIZED (
       SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
       WHERE len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
     l AS MATERIALIZED (SELECT r, i, e[i] AS x FROM v, range(1, {DIM + 1}) AS d(i)),
     s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), e) - 1 AS c FROM v QUALIFY c < {CENTROIDS}),
     c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN l USING (r))"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""d{n} AS MATERIALIZED (SELECT l.r, k.c, sum((l.x - k.x) * (l.x - k.x)) AS d FROM l JOIN c{n} k ON k.i = l.i GROUP BY l.r, k.c),
     a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""m{n} AS MATERIALIZED (SELECT a.c, l.i, sum(l.x) AS s, count(*) AS n FROM a{n} a JOIN l ON l.r = a.r GROUP BY a.c, l.i),
     c{n + 1} AS MATERIALIZED (SELECT k.c, k.i, CASE WHEN m.n IS NULL THEN k.x ELSE (m.s - (((m.s % m.n) + m.n) % m.n)) // m.n END AS x FROM c{n} k LEFT JOIN m{n} m ON m.c = k.c AND m.i = k.i)"""
            )
    return f"""WITH {", ".join(parts)},
     h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN h ON h.c = a.c
"""
