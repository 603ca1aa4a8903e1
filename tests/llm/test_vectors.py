import duckdb
import numpy as np
import pandas as pd
import pytest

from webloom.llm import vectors as v

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cell string"


def rows(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        base = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 1.0])
        if out and rng.random() < 0.25:
            base = np.array(out[rng.integers(len(out))][1]) * rng.choice([1.0, 1.0, 2.0])
        out.append((i, np.float32(base).astype(float).tolist(), int(rng.integers(3))))
    return out


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1),
       (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [1.0] * 4, 1), (909, [2.0] * 4, 1), (910, [1e30] * 16, 2), (911, [2e30] * 16, 2), (912, [1e-30] * 16, 2), (913, [1.0], 1), (914, [3.0], 1)]


def good(e):
    return e is not None and len(e) > 0 and all(c is not None and np.isfinite(c) for c in e) and any(e)


def links(data):
    n = len(data)
    parent, count = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = data[i], data[j]
            if la is None or la != lb or not good(a) or not good(b) or len(a) != len(b):
                continue
            x, y = np.array(a), np.array(b)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                count[i] += 1
                count[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(data[i][0])
    return sorted((d, count[i], min(least[find(i)]), d == min(least[find(i)])) for i, (d, *_) in enumerate(data))


def frame(spark, data):
    return spark.createDataFrame([(*r, 7, "c") for r in data], SCHEMA)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(v, "TILE", 7)
    data = rows(seed) + ODD
    got = sorted(map(tuple, v.near_duplicates(frame(spark, data)).collect()))
    assert got == links(data)


def test_near_duplicate_sql():
    data = rows(3, 150)
    embeddings = pd.DataFrame(data, columns=["vec_id", "embedding", "label"])  # noqa: F841
    assert sorted(duckdb.sql(v.SQL3).fetchall()) == links(data)


def test_traversal_reaches_every_cell_that_can_hold_a_partner():
    rng = np.random.default_rng(5)
    x = v.unit(rng.normal(size=(400, 10)))
    y = v.unit(x + rng.normal(size=x.shape) * 0.03)
    books = v.kmeans(x[:, :5], 9), v.kmeans(x[:, 5:], 9)
    r2 = 2 - 2 * 0.98
    ma, mb = v.margins(x[:, :5], books[0])[1], v.margins(x[:, 5:], books[1])[1]
    ya, yb = v.margins(y[:, :5], books[0])[0], v.margins(y[:, 5:], books[1])[0]
    near = np.flatnonzero((x * y).sum(1) >= 0.98)
    assert len(near) > 300
    for i in near:
        assert (int(ya[i]), int(yb[i])) in set(v.traverse(ma[i], mb[i], r2))


def test_empty_and_repeated_rows(spark):
    assert v.near_duplicates(frame(spark, ODD).limit(0)).collect() == []
    got = sorted(map(tuple, v.near_duplicates(frame(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (None, [0.0, 1.0], 1)])).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (5, 1, 5, True), (None, 1, 5, False)], key=repr)
    assert v.neighbours(frame(spark, ODD).limit(0)).collect() == []


def test_neighbours_recall(spark):
    data = rows(7, 900) + [(1000 + i, [1.0] * 16, 1) for i in range(30)] + ODD[:6] + ODD[10:12]
    ok = [(d, np.array(e)) for d, e, _ in data if good(e)]
    got = {}
    for r in v.neighbours(frame(spark, data), "vec_id % 20 = 0", shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [(d, e) for d, e in ok if d % 20 == 0]
    assert set(got) == {d for d, _ in queries}
    hits = total = 0
    for d, e in queries:
        true = sorted((float(np.sqrt(((e - x) ** 2).sum())), i) for i, x in ok if i != d)[:10]
        mine = sorted(got[d])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        by = {i: s for s, i in ((float(np.sqrt(((e - x) ** 2).sum())), i) for i, x in ok)}
        assert all(abs(s - by[i]) <= 1e-12 * max(1, by[i]) for _, i, s in mine)
        hits += len({i for _, i in true} & {i for _, i, _ in mine})
        total += 10
    assert hits / total >= 0.97


def test_few_candidates(spark):
    got = sorted(map(tuple, v.neighbours(frame(spark, [(0, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 2)])).collect()))
    assert got == [(0, 1, 3, 2**0.5), (0, 2, 4, 2**0.5)]


def recall(spark, x, shard_rows, every=20):
    data = [(i, e.tolist(), 0) for i, e in enumerate(x.astype(np.float32))]
    x = np.array([e for _, e, _ in data])
    found = {}
    for r in v.neighbours(frame(spark, data), f"vec_id % {every} = 0", shard_rows=shard_rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), every):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & found[i])
    return hits / (10 * len(range(0, len(x), every)))


def test_recall_over_many_shards(spark):
    """At the tables' dimension: without any clusters, and with some of very different sizes."""
    rng = np.random.default_rng(3)
    assert recall(spark, v.unit(rng.normal(size=(6000, 64))), 600) >= 0.95
    sizes = [2500, 1200, 600, 300, 200, 100, 60, 40]
    assert recall(spark, np.concatenate([rng.normal(size=64) * 3 + rng.normal(size=(n, 64)) * 0.3 for n in sizes]), 500) >= 0.95


def test_only_shards_that_can_hold_no_nearer_row_are_left_out():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=6) * 4 + rng.normal(size=(n, 6)) for n in (300, 200, 80, 20)])
    book = v.kmeans(x, 12)
    own = v._squares(x, book).argmin(axis=1)
    far = np.sqrt(v._squares(x, book)[np.arange(len(x)), own])
    radius = np.array([far[own == c].max() if (own == c).any() else -1.0 for c in range(len(book))])
    asked = range(0, len(x), 7)
    d = [np.sqrt(((x - x[i]) ** 2).sum(axis=1)) for i in asked]
    got = v._others({6: book}, {6: radius})(list(asked), [x[i].tolist() for i in asked], [int(own[i]) for i in asked], [float(np.sort(e)[11]) for e in d])
    pairs = set(zip(got["query_id"], got["cell"], strict=True))
    for i, e in zip(asked, d, strict=True):
        assert {int(own[j]) for j in np.argsort(e)[:11]} <= {own[i]} | {c for q, c in pairs if q == i}
    assert len(pairs) < 0.7 * len(asked) * 11


def test_neighbours_with_a_repeated_id_and_ties(spark):
    data = [(100, [0.0, 1.0], 1), (100, [5.0, 5.0], 1), (3, [0.0, 2.0], 1), (2, [1.0, 1.0], 1), (7, [0.0, 0.5], 1), (7, [9.0, 9.0], 2), (8, [9.0, 9.0], 2)]
    got = sorted(map(tuple, v.neighbours(frame(spark, data), k=3).collect()))
    assert got == [(100, 1, 7, 0.5), (100, 2, 2, 1.0), (100, 3, 3, 1.0)]
