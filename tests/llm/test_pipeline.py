import re

import corpus_pipeline
from tests.llm.test_ngramjoin import brute as classes
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as personal
from webloom.llm import langid


def masked(text):
    spans, at, out = sorted((s, e, k) for k, s, e in personal(text)), 0, ""
    for s, e, k in spans:
        if s < at:
            at = max(at, e)
            continue
        out, at = out + text[at:s] + f"<{k.upper()}>", e
    return out + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    syl = {"aa": ["kalo", "mitu", "tuka"], "bb": ["sch", "ung", "heit"]}
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        words = [syl[lang][(i * 7 + j * j) % 3] + syl[lang][(i + j * 3 + j // 5) % 3] + str(i * (j % 9 == 0) or "") for j in range(8 + i % 40)]
        rows.append((i, " ".join(words) + (f" a{i}@b.cd" if i % 5 == 0 else ""), lang, "s", 1))
    rows += [(200, rows[3][1], "bb", "s", 1), (201, rows[40][1] + " extra", "aa", "s", 1), (202, "12 34 -- 5", "aa", "s", 1), (203, None, None, "s", 0), (204, "", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rejected = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).collect() if r.rejected}
    assert rejected == {202, 203, 204}
    kept = [(i, t) for i, t, *_ in rows if i not in rejected]
    firsts = {i for i, _, c in classes(kept) if i == c}
    assert 200 not in firsts
    want = [(i, masked(t)) for i, t in kept if i in firsts]
    assert any("<EMAIL>" in t for _, t in want) and not any(re.search(r"\w@\w", t) for _, t in want)
    assert {r.doc_id for r in got} == firsts
    check(got, want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
