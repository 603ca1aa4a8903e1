import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import centroids as c


def brute(rows, k=8, rounds=10):
    """By Python integers alone: (vec_id, cluster, distance, cluster_inertia, inertia, sha) of every kept row."""
    kept = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    at = [v for _, _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in at]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        got = [near(v)[0] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), g in zip(kept, got, strict=True) if g == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [near(v) for _, v in kept]
    own = [sum(d for j, d in got if j == k) for k in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in at]
    cut = lambda x: min(x, c.LONG_MAX)
    return sorted((str(i), j, cut(d), cut(own[j]), cut(sum(own)), sha[j]) for (i, _), (j, d) in zip(kept, got, strict=True))


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, e, 1, 9) for i, e in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(parts)
    return sorted((str(r.vec_id), *list(r)[1:]) for r in c.cluster(df).collect())


def vectors(n, seed, scale=0.2):
    return [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(0, scale, (n, 64)))]


@pytest.mark.parametrize("n", [1, 5, 9, 200])
def test_equals_brute_force(spark, n):
    rows = vectors(n, n)
    assert run(spark, rows) == brute(rows)


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 64) / 1024).tolist()) for i in range(60)]
    rows += [(3, rows[3][1])] * 40 + [(5, rows[6][1]), (None, rows[7][1]), (None, None), (90, None), (91, [1.0] * 63), (92, []), (93, [float("nan")] + [0.0] * 63), (94, [None] + [0.0] * 63), (95, [float("inf")] * 64), (96, [0.0] * 64), (97, [0.0] * 64)]
    assert run(spark, rows, 1) == run(spark, rows, 5) == brute(rows)


def test_null_ids_start_only_where_others_are_too_few(spark):
    rows = [(None, v) for _, v in vectors(12, 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows + vectors(3, 5)) == brute(rows + vectors(3, 5))


def test_huge_components(spark):
    rows = vectors(20, 6) + [(100 + i, [x * 10.0 ** (i * 2) for x in v]) for i, v in vectors(12, 7)]
    assert run(spark, rows) == brute(rows)
    assert max(r[2] for r in run(spark, rows)) <= c.LONG_MAX


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [1.0])]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 1000, 10**6, c.SAFE]), st.integers(0, 3))
def test_screen_never_loses_the_nearest(seed, most, apart):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-most, most + 1, 64)
    # centroids that differ by next to nothing, which float32 cannot tell apart
    at = np.clip(centre + rng.integers(-apart, apart + 1, (8, 64)), -most, most)
    v = np.clip(np.vstack([rng.integers(-most, most + 1, (20, 64)), at + rng.integers(-1, 2, (8, 64))]), -c.SAFE, c.SAFE).astype(float)
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, m, strict=True)) for m in at] for x in v]
    may = c.screen(v, at.astype(float))
    for row, mine in zip(d, may, strict=True):
        assert all(mine[j] for j in range(8) if row[j] == min(row))
    cluster, near = c.assign(v, at.tolist(), distances=True)
    assert cluster.tolist() == [row.index(min(row)) for row in d] and list(map(int, near)) == [min(row) for row in d]


def test_screen_decides_most_rows():
    v = np.floor(np.random.default_rng(1).normal(0, 128, (2000, 64)))
    assert (c.screen(v, v[:8]).sum(axis=1) == 1).mean() > 0.99


@given(st.integers(-(1 << 190), 1 << 190))
def test_limbs(x):
    assert c.whole(c.limbs(x)) == x and all(0 <= p < 1 << c.LIMB for p in c.limbs(x)[:-1])
