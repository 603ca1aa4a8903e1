import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from webloom.llm import ngramjoin as nj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed=0, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                if w:
                    i = rng.randrange(len(w))
                    what = rng.random()
                    if what < 0.4:
                        w[i] = rng.choice(vocab)
                    elif what < 0.7:
                        del w[i]
                    else:
                        w.insert(i, rng.choice(vocab))
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 30))]))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 100, 400]))))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "ONE two"), (1004, "one\tTWO"), (1005, "é é é É é é"), (1006, "a b c d e"), (1007, "long " + "word " * 30000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    assert sorted(map(tuple, nj.join(df).collect())) == brute(rows)


def test_large_group_of_near_copies_with_odd_ones(spark, monkeypatch):
    """Large tiles with members that are not linked to the smallest one."""
    monkeypatch.setattr(nj, "BLOCK", 20)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"z{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df).collect())) == brute(rows)


def possible(a, b):
    return bool(nj.could_link(np.int64(len(a)), np.int64(len(b)), nj.differing_bits(nj.bitmap(a), nj.bitmap(b))))


def shares_tile(a, b):
    return bool(set(nj.tile_keys(a).tolist()) & set(nj.tile_keys(b).tolist()))


def test_every_linked_pair_shares_a_tile():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a = np.unique(np.r_[common, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        b = np.unique(np.r_[common, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        i = len(np.intersect1d(a, b))
        if 100 * i >= 80 * (len(a) + len(b) - i):
            assert nj.linked(a, b) and possible(a, b)
            assert np.array_equal(a, b) or shares_tile(a, b)
        else:
            assert not nj.linked(a, b)


def test_large_sets_share_a_tile():
    """Pairs at the least similarity and above, of sizes up to the longest texts and beyond."""
    rng = np.random.default_rng(4)
    for n in (300, 700, 1500, 6000, 30_000):
        for share in (0.8, 0.85, 0.95):
            for _ in range(40 if n < 6000 else 8):
                x = rng.integers(0, 1 << 63, n).astype(np.uint64)
                common, rest = x[: int(share * n)], x[int(share * n) :]
                cut = int(rng.integers(0, len(rest) + 1))
                a, b = np.unique(np.r_[common, rest[:cut]]), np.unique(np.r_[common, rest[cut:]])
                if 100 * len(common) >= 80 * n:
                    assert shares_tile(a, b) and nj.linked(a, b) and possible(a, b)


def test_no_choice_of_differences_hides_a_pair():
    """Differences put where they hurt most, one in each of the highest segments that the other set would share."""
    rng = np.random.default_rng(6)
    for n in (9, 20, 45, 100, 400, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = nj.most_differing(len(a), len(a))
            m = nj.segments(int(nj.BANDS[np.searchsorted(nj.BANDS, max(1, most))]))
            at = (((a >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)
            ranked = sorted(set(at.tolist()), key=lambda k: -(at == k).sum())
            gone = [int(np.flatnonzero(at == k)[0]) for k in ranked[: len(a) - -(-len(a) * 80 // 100)]]
            b = np.delete(a, gone)
            assert nj.linked(a, b) and shares_tile(a, b)


def test_large_strangers_are_excluded_by_bits():
    rng = np.random.default_rng(8)
    for n in (100, 1000, 3000, 20_000):
        a, b, c = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, n, 9 * n // 10))
        assert not possible(a, b) and not possible(a, c) and not possible(c, a) and possible(a, a)


def test_sets_that_share_half_of_their_name(spark):
    """With very few bits in the first half, many different sets have the same."""
    rows = list(enumerate(corpus(11, 120)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df, id_bits=4).collect())) == brute(rows)


def test_a_set_of_many_pairs_meets_them_in_several_places(spark, monkeypatch):
    monkeypatch.setattr(nj, "HOT_PAIRS", 3)
    rows = list(enumerate(corpus(12, 150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df).collect())) == brute(rows)


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, "x"), (2, "a b c d e f", 1, 2, 3, "y"), (3, "q", 4, 5, 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, key int, _won_id int, _Won_Key string")
    assert sorted(map(tuple, nj.deduplicate(df).collect())) == [rows[0], rows[2]]


def test_small_and_repeated_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, ""), (7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nj.join(df).collect()), key=repr)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (7, 1, 7)], key=repr)
    assert nj.join(df.limit(0)).collect() == []
    kept = sorted(map(tuple, nj.deduplicate(df).collect()), key=repr)
    assert kept == sorted([(3, "a b c d e f"), (7, "q"), (None, "")], key=repr)


def test_sql(spark):
    rows = list(enumerate(corpus(5, 120)))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(duckdb.sql(nj.SQL).fetchall()) == brute(rows)
