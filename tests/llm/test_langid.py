import zlib

import numpy as np
import pytest

from webloom.llm import langid

SYL = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ßen", "sch", "äu", "ung"], "cc": ["ción", "ñez", "ado", "ía"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        lang = list(SYL)[i % 3]
        text = " ".join("".join(rng.choice(SYL[lang], 2)) for _ in range(int(rng.integers(2, 60))))
        rows.append((i, text, lang if i % 10 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 + 3 ½ ²", "aa", "x"), (1003, "kalo " * 40000, None, "x"), (None, "schung", "bb", "x"), (5, rows[5][1], rows[5][2], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(docs):
    got = langid.identify(docs, langid.fit(docs))
    rows = got.collect()
    assert len(rows) == 406
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa"
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == list(SYL)[r.doc_id % 3] for r in held]) >= 0.97
    assert sum(r.rejected for r in held) == 0


def test_never_learns_from_held_out_or_unlabelled_rows(docs, spark):
    wrong = docs.selectExpr("doc_id", "case when crc32(binary(string(doc_id))) % 3 = 1 then 'zzz qqq' else text end text", "case when crc32(binary(string(doc_id))) % 3 = 1 then 'zz' else lang end lang")
    assert "zz" not in langid.fit(wrong).langs


def test_nothing_to_learn_from(spark, docs):
    none = docs.selectExpr("doc_id", "text", "string(null) lang")
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(none, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), None).collect() == []


def test_accepted_keeps_clean_rows_and_columns(docs):
    model = langid.fit(docs)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_accepted_keeps_columns_of_any_name(docs):
    odd = docs.selectExpr("*", "doc_id + 1 AS `a.b`", "'x' AS `c d-e`")
    kept = langid.accepted(odd, langid.fit(docs))
    assert kept.columns == odd.columns and all(r["a.b"] == r.doc_id + 1 for r in kept.where("doc_id is not null").collect())


@pytest.mark.parametrize("learnt", [["aa"], ["aa", "bb"], ["aa", "bb", "cc"]])
def test_text_of_a_language_that_is_not_learnt_is_rejected(spark, docs, learnt):
    rng = np.random.default_rng(4)
    other = ["wre", "oqu", "xib", "fyd"]
    odd = [(2000 + i, " ".join("".join(rng.choice(other, 2)) for _ in range(12)), None, "x") for i in range(20)]
    odd += [(3000 + i, " ".join("".join(rng.choice(list("qwxzvjkpfg"), 7)) for _ in range(12)), None, "x") for i in range(20)]
    known = docs.where(f"doc_id < 1000 and element_at(array('aa', 'bb', 'cc'), int(doc_id % 3 + 1)) in ('{"','".join(learnt)}')")
    model = langid.fit(known)
    assert model.langs == learnt
    every = known.unionByName(spark.createDataFrame(odd, docs.schema))
    assert sorted(r.doc_id for r in langid.accepted(every, model).collect()) == sorted(r.doc_id for r in known.collect())


@pytest.mark.parametrize("per_lang", [1, 40, 70, 1000])
def test_sample_follows_one_rule_at_every_size(docs, per_lang):
    def sample(of, n):
        return sorted((r.lang, bytes(r.at), bytes(r.n), bytes(r.mixed_at), bytes(r.mixed_n)) for r in langid.labelled_sample(of, n).collect())

    may = docs.where("doc_id is not null and text is not null and lang is not null and crc32(binary(string(doc_id))) % 3 <> 1").distinct()
    got = sample(docs, per_lang)
    assert {k: sum(r[0] == k for r in got) for k in SYL} == {r.lang: min(per_lang, r["count"]) for r in may.groupBy("lang").count().collect()}
    # every text is shuffled too, however many there are
    assert all(r[3] for r in got if r[1])
    assert sample(docs.union(docs).repartition(7), per_lang) == got
    assert set(got) <= set(sample(docs, per_lang + 1))
