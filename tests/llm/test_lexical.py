import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from webloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(text):
    return TERM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_terms(text):
    assert lexical.terms(text) == plain(text)


def test_terms_of_odd_texts():
    assert lexical.terms(None) == lexical.terms("") == lexical.terms("\x00 -_[]") == []
    assert lexical.terms("ÀB c1 D e") == ["Àb", "c1 d e"]


def brute(docs, items, k):
    found = [(i, Counter(plain(t))) for i, t in docs]
    found = [(i, tf, sum(tf.values())) for i, tf in found if tf]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        terms = {t for i, x in items if i == item for t in plain(x)}
        scored = []
        for i, tf, n in found:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def tables(spark, docs, items, parts=3):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, terms string").repartition(parts),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string"),
    )


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(150)]
    share = 1 / np.arange(1, 151)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)] + [(2000, None), (2001, ""), (2002, "-- !"), (None, docs[7][1]), (None, docs[8][1]), (7, docs[7][1]), (2003, "w3 " * 30000), (2004, "W1\tw1.É"), (-5, docs[7][1])]
    items = [(i, text(12)) for i in range(12)] + [(20, docs[7][1]), (21, None), (22, ""), (23, "absent words"), (24, "É w1"), (3, "w140 w141"), (3, "w140 w141"), (None, "w1"), (-1, "w149")]
    return docs, items


@pytest.mark.parametrize("postings, block", [(10**6, 10**6), (60, 25), (1, 1)])
def test_equals_brute_force(spark, data, postings, block):
    docs, items = data
    if postings == 1:
        docs, items = docs[::9], items[:3]
    got = lexical.search(*tables(spark, docs, items), k=10, shard_postings=postings, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items, 10))


def test_empty_tables(spark, data):
    docs, items = tables(spark, *data)
    assert lexical.search(docs.limit(0), items).collect() == [] == lexical.search(docs, items.limit(0)).collect()
    assert lexical.search(docs.where("text is null"), items).collect() == []


def test_reading_stops_at_the_threshold(data):
    rng = np.random.default_rng(1)
    n = 5000
    impact = np.sort(rng.pareto(1.0, 2 * n) * 1000).astype(np.int64)
    shard = lexical.Shard(np.full(n, 2), np.tile([0, 1], n), impact)
    docs, scores, looked = shard.best(np.array([0, 1]), np.ones(2, bool), 5)
    assert docs.tolist() == [n - 1, n - 2, n - 3, n - 4, n - 5] and looked < n / 10
    # as long as the threshold equals the last score, a smaller document may tie
    even = lexical.Shard(np.ones(n, int), np.zeros(n, int), np.full(n, 9))
    assert even.best(np.array([0]), np.ones(1, bool), 5)[0].tolist() == [0, 1, 2, 3, 4]
