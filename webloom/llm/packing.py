"""Best-fit packing with bound-certified repacking.

Documents are tokenised once; pieces of the full capacity need no packing. The rest are dealt evenly to
partitions, each packed by best-fit decreasing. Dual-feasible functions give a lower bound on each
partition's bins: where the count meets it, the partition is certified and done. Partitions with a gap keep
their full bins and hand the documents of the others to a common pool, which is dealt out again and packed
by best-fit decreasing, until no gap is left or the rounds are over. Only (id, length) rows move.

Defined results: null or empty text is the end id alone (one piece of length 1); repeated rows are packed
as often as they occur; very long texts are cut into as many pieces as they need; ties: of equal lengths the one that is read first is placed first, into the bin opened or
filled last among those of equal room; an empty table gives an empty one; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.bpe import byte_names
from webloom.llm.common import map_rows, table, tokenizer_path
from webloom.operators.storage import materialise

FILE = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Pieces that one task packs; twice as many in each further round, as pooled documents fit better.
PARTITION_PIECES = 50_000
ROUNDS = 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, open boolean"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Text to ids, as the tokenizers library gives them for this byte-level file (special tokens included):
    the file's vocabulary in the tiktoken library, which runs several times as fast."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_names())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        found = re.compile("|".join(map(re.escape, special))).search

        def ids(text: str) -> list[int]:
            return enc.encode(text, allowed_special="all") if "<|" in text and found(text) else enc.encode_ordinary(text)

        _ENCODERS[path] = ids
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(folder: str | None, capacity: int):
    ids_of = encoder(tokenizer_path(FILE, folder))

    def run(doc_id, text):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for i, t in zip(doc_id, text, strict=True):
            ids = array("I", ids_of(t or ""))
            ids.append(END)
            data = memoryview(ids.tobytes() if np.little_endian else ids[:].byteswap().tobytes())
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                out["doc_id"].append(i)
                out["piece"].append(k)
                out["start"].append(s)
                out["length"].append(n)
                out["ids_crc32"].append(zlib.crc32(data[4 * s : 4 * (s + n)]))
        return out

    return run


def tokenise(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document."""
    return map_rows(docs, ["doc_id", "text"], PIECE, _pieces, folder=folder, capacity=capacity)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and each bin's free space. The open bins are kept by free space, and
    the bits of one integer tell which free spaces there are."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        left = mask >> size
        if left:
            f = size + (left & -left).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                mask &= ~(1 << f)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bin_of[i], offset[i] = b, capacity - f
        free[b] = rest = f - size
        if rest:
            by_free[rest].append(b)
            mask |= 1 << rest
    return bin_of, offset, np.array(free, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins: the best over a family of dual-feasible functions. For a threshold t,
    lengths over capacity - t count as whole bins, those under t as nothing, the others as themselves; for a
    whole k, a length counts as floor((k + 1) length / capacity) / k, or as itself where that is whole."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in sizes[sizes <= capacity // 2].tolist():
        whole, mid = sizes > capacity - t, (sizes >= t) & (sizes <= capacity - t)
        best = max(best, int(counts[whole].sum()) - (-int((sizes[mid] * counts[mid]).sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # all in units of 1 / (k capacity)
        value = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        lengths = t["length"].to_numpy()
        bins, offset, free = best_fit_decreasing(lengths, capacity)
        gap = len(free) > bin_bound(lengths, capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        again = (free[bins] > 0) if gap and not last else np.zeros(len(bins), bool)
        for name, x in (("sequence_id", bins + base), ("offset", offset), ("open", again)):
            t = t.append_column(name, pa.array(x))
        yield from t.to_batches(max_chunksize=20_000)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most capacity."""
    pieces = materialise(pieces, "pieces")
    names, done, todo = pieces.columns, [], pieces
    for level in range(1, rounds + 1):
        n = todo.count()
        if not n:
            break
        parts = -(-n // (partition_pieces << (level - 1)))
        last = level == rounds
        # round robin, so that no key is hot; Spark sorts before it, and so a rerun deals alike
        packed = materialise(todo.repartition(parts).mapInArrow(_pack(capacity, level, last), PACKED), "packed")
        done.append(packed.where("not open").drop("open"))
        todo = packed.where("open").select(*names)
    if not done:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenise(docs, folder, capacity), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
