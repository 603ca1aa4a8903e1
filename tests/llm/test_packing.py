import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import packing
from webloom.llm.common import tokenizer_path

PATH = tokenizer_path(packing.FILE)
THEIRS, OURS = Tokenizer.from_file(PATH), packing.encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_ids_are_the_librarys(text):
    assert OURS(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_special_and_white_space():
    for t in ("a<|endoftext|>b", "  x \n\n y  ", "<|", "\t\t\tz " * 50, "'s 'S it's"):
        assert OURS(t) == THEIRS.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5) == [(0, 5)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_never_exceeds_the_optimum(sizes):
    def fits(k, left, rest):
        if not left:
            return True
        seen = set()
        for i in range(k):
            if rest[i] >= left[0] and rest[i] not in seen:
                seen.add(rest[i])
                if fits(k, left[1:], rest[:i] + (rest[i] - left[0],) + rest[i + 1 :]):
                    return True
        return False

    sizes = sorted(sizes, reverse=True)
    best = next(k for k in range(len(sizes) + 1) if fits(k, sizes, (20,) * k))
    x = np.array(sizes, np.int64)
    assert packing.bin_bound(x, 20) <= best
    if sizes:
        bins, offset, free = packing.best_fit_decreasing(x, 20)
        assert best <= len(free) and (free >= 0).all()


def check(rows, texts, capacity=2048):
    ids = {i: THEIRS.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    at = defaultdict(list)
    seen = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
    for x in at.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= capacity
    for i, x in ids.items():
        got = sorted(seen[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == packing.cut(len(x)) and [r.piece for r in got] == list(range(len(got)))
    return len(at)


def test_frame(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(["word"] * int(rng.integers(0, 3000)))) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 50000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, piece int")
    rows = packing.pack_documents(df).collect()
    n = check(rows, texts)
    assert n <= sum(r.length for r in rows) / 2048 * 1.02 + 1
    assert packing.pack_documents(df.limit(0)).collect() == []
    assert len(packing.pack(packing.tokenise(df), partition_pieces=50).select("sequence_id").distinct().collect()) <= 1.03 * n


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 7 + [(None, "x")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 8 and len({(r.sequence_id, r.offset) for r in rows}) == 8
