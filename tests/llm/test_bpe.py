import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import bpe
from webloom.llm.common import tokenizer_path

PATH = tokenizer_path(bpe.FILE)
OWN, THEIRS = bpe.load(PATH), Tokenizer.from_file(PATH)
CASES = ["", " ", "Hello, it's John's 2nd té st!!", "a" * 3000, "ΑΣ ΣΑΣ", "İstanbul", "x<|endoftext|>y <|startoftext|>", "é   z\x1c\x85",
         "ab​cd 漢字かな🙂🙂 ½ ٣", "don't we'll I'D 'S''s", "\n\n--==\t\t__", "<|endoftext", "th" * 500 + "Q" * 77]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    e = THEIRS.encode(text, add_special_tokens=False)
    assert OWN.encode(text) == e.ids
    assert OWN.decode(e.ids) == THEIRS.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theanior s'éß.,1", max_size=200))
def test_common_letters(text):
    assert OWN.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_frame(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (3, ""), (None, "x")]
    df = spark.createDataFrame([(a, b, "extra") for a, b in rows], "doc_id long, text string, ids_sha256 string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()}
    want = set()
    for i, t in rows:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.digests(df.limit(0)).collect() == []
    back = bpe.decode(bpe.encode(df.where("doc_id = 1"))).first().decoded
    assert back == THEIRS.decode(THEIRS.encode("Hello there", add_special_tokens=False).ids)
