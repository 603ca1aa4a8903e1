"""State machines over segments against one pass over each key."""

import random

import pytest

from webloom.operators import folds


def alone(rows, machine):
    """By one machine a key, over its sorted rows."""
    out, by = [], {}
    for k, *rest in rows:
        by.setdefault(k, []).append(tuple(rest))
    for k, values in by.items():
        m = machine()
        for v in sorted(values, key=lambda v: v[:2]):
            out += [(k, *r.values()) for r in m.add(*v)]
        out += [(k, *r.values()) for r in m.end()]
    return sorted(out, key=str)


def data(n, gap, seed=1):
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.randint(0, gap)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), at, i))
    return rows


@pytest.mark.parametrize("segments, gap", [(1, 40), (7, 4), (40, 40), (7, 400)])
def test_sessions(spark, segments, gap):
    rows = data(600, gap)
    machine = lambda: folds.Sessions(100, 900)
    got = folds.fold_segments(spark.createDataFrame(rows, "k long, tm long, seq long"), ["k"], ["tm", "seq"], [], folds.Sessions.FIELDS, machine, segments)
    assert sorted(map(tuple, got.collect()), key=str) == alone(rows, machine)


@pytest.mark.parametrize("segments", [1, 9])
def test_captures(spark, segments):
    rng = random.Random(2)
    rows = [(k, at, i, at + rng.randint(0, 60), rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.1) for k, at, i in data(500, 30)]
    machine = lambda: folds.Captures(25, 300, 6)
    df = spark.createDataFrame(rows, "k long, tm long, seq long, done long, tracker boolean, hit boolean, threw boolean")
    got = folds.fold_segments(df, ["k"], ["tm", "seq"], ["done", "tracker", "hit", "threw"], folds.Captures.FIELDS, machine, segments)
    assert sorted(map(tuple, got.collect()), key=str) == alone(rows, machine)


def test_a_machine_that_never_forgets(spark):
    """A window that no gap closes: each segment's state depends on all before it."""
    rows = [(1, i, i) for i in range(200)]
    machine = lambda: folds.Sessions(10**9, 10**9)
    got = folds.fold_segments(spark.createDataFrame(rows, "k long, tm long, seq long"), ["k"], ["tm", "seq"], [], folds.Sessions.FIELDS, machine, 6)
    assert list(map(tuple, got.collect())) == [(1, 0, 199, 200, "idle")]


def test_one_key_is_many_segments(spark):
    df = spark.range(4000).selectExpr("1 AS k", "id * 10 AS tm", "id AS seq")
    got = folds.fold_segments(df, ["k"], ["tm", "seq"], [], folds.Sessions.FIELDS, lambda: folds.Sessions(5, 100), 8)
    assert got.count() == 4000 and got.agg({"n": "sum"}).first()[0] == 4000


def test_empty(spark):
    assert folds.fold_segments(spark.createDataFrame([], "k long, tm long, seq long"), ["k"], ["tm", "seq"], [], folds.Sessions.FIELDS, lambda: folds.Sessions(5, 100)).collect() == []
