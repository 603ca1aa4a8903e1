import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import quality

SYL = ["ka", "lo", "mi", "tu", "ren", "os"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYL, 2)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for i in range(600):
        text = "\n".join(sentence(rng, int(rng.integers(3, 14))) for _ in range(int(rng.integers(1, 8))))
        if i % 3 == 0:
            text = [" ".join(w + "$$" for w in text.split()), " ".join(w.upper() + "!!" for w in text.split()), " | ".join(text.split()), " ".join(text.split()[:1] * 60)][i // 3 % 4]
        out.append((i, text, int(i % 3 != 0)))
    return out


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = [(i, t, 0.5) for i, t, _ in rows] + [(5000, None, 0.5), (5001, "", 0.5), (5002, " \n ", 0.5), (5003, "kalo mitu. " * 60000, 0.5), (None, rows[1][1], 0.5), (4, rows[4][1], 0.5)]
    labels = [(i, q, 0) for i, _, q in rows if i % 5] + [(None, 0, 0), (1, None, 0), (2, 7, 0), (7, 1, 0), (7, 0, 0), (9999, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, stats int")


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


def test_statistics_of_odd_texts():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n\t ") == [0] * 16
    named = dict(zip(quality.NAMES, quality.statistics("Aa b!! b!! |\nAa 12"), strict=True))
    unit = quality.UNIT
    assert named["distinct_words"] == round(4 / 6 * unit) and named["repeated_next"] == round(unit / 5)
    assert named["words_without_letters"] == round(2 / 6 * unit) and named["digit_share"] == round(2 / 13 * unit)
    assert named["upper_share"] == round(2 / 6 * unit) and named["symbol_runs"] == round(2 / 6 * unit)
    for odd in ("a", "\U0010ffff", "é" * 9, "\n\na\n", "\x00 \x00", "１２ ３"):
        assert len(quality.statistics(odd)) == 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), min_size=1, max_size=12))
def test_isotonic_is_the_least_squares_fit(pairs):
    n = np.array([m for _, m in pairs], float)
    good = np.array([min(g, m) for g, m in pairs], float)
    x = np.arange(len(pairs), dtype=float)
    got = np.interp(x, *quality.isotonic(x, good, n))
    # max over starts of the min over ends of the mean between
    want = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]
    assert np.allclose(got, want)


def test_sums_of_tasks_are_the_normal_equations(spark, rows):
    stats = np.array([quality.statistics(t) for _, t, _ in rows])
    data = [(1 + i % 4, 1 + i % 2, i % 2, stats[i].tolist()) for i in range(len(rows))]
    df = spark.createDataFrame(data, "fold int, n long, good long, stats array<int>")
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1
    found = []
    for parts in (1, 7):
        summed = df.repartition(parts).mapInArrow(quality._normal_equations(mean, scale), quality.SUMS).groupBy("fold", "width", "part").sum(*[f"s{i}" for i in range(quality.WIDE)])
        found.append(quality.unpack(summed.collect()))
    assert all((x == y).all() for x, y in zip(*found, strict=True))
    a, b = found[0]
    fold, n, good = (np.array([r[k] for r in data]) for k in range(3))
    z = quality.cosines(stats.astype(float), mean, scale, quality.WIDTHS[1])
    m = fold == 3
    assert (a[2, 1] == (z[m] * n[m, None]).T @ z[m]).all() and (b[2, 1] == good[m] @ z[m]).all()


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))
    z = quality.cosines(x, np.zeros(16), np.ones(16), 1.0)[:, :-1] / quality.COS_UNIT
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 16))
    assert np.abs(z @ z.T * 2 / quality.FEATURES - kernel).mean() < 0.08


def test_held_out_scores(tables, rows):
    docs, labels = tables
    stats = quality.described(docs)
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(got) == 606 and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    want = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert len(held) > 80 and np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id) == 0)
    assert len({r.score for r in got if r.doc_id in (5000, 5001, 5002)}) == 1
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_the_model_does_not_depend_on_tasks(tables):
    docs, labels = tables
    a, b = (quality.score(s, quality.fit(s, labels)).collect() for s in (quality.described(docs.repartition(1)), quality.described(docs.repartition(9))))
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_never_learns_from_held_out_labels(spark, tables):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "case when crc32(binary(string(doc_id))) % 5 = 0 then 1 - quality else quality end quality")
    stats = quality.described(docs)
    a, b = quality.fit(stats, labels), quality.fit(stats, turned)
    assert (a.weights == b.weights).all() and (a.steps_y == b.steps_y).all()


def test_nothing_to_learn_from(tables):
    docs, labels = tables
    stats = quality.described(docs)
    assert quality.fit(stats, labels.limit(0)) is None and quality.fit(stats, labels.where("quality is null")) is None
    assert {r.score for r in quality.score(stats, None).collect()} == {0.5}
    none = quality.described(docs.limit(0))
    assert quality.score(none, quality.fit(none, labels)).collect() == []
    one = quality.fit(stats, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score(stats, one).collect()} == {1}
