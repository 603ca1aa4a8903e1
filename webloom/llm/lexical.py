"""Ranked lexical search by the threshold algorithm over shards of a forward index.

The items' terms are the vocabulary. One pass over the documents keeps, of each whole text, its number of terms and the
counts of the vocabulary's terms in it: the forward index, written to the shared folder. Document counts of terms are summed from
it. A task takes index rows until a shard holds ``SHARD_POSTINGS`` postings and inverts it into lists by term,
highest impact first. For each item the lists are read in turn, as many entries of every list a round; a document met for the first time
is scored at once by looking all the item's terms up in its index row. The threshold is the sum of the impacts reached in the lists:
no document not yet met can score more. Reading ends when it falls strictly below the score of the last of the best k,
so that ties by smaller doc_id are found, or when the lists are at their ends. The best k of all shards are ranked
once more, first within hashed parts, then over them.

Items are taken in blocks of about ``BLOCK_TERMS`` (item, term) rows, one pass over the documents each, so neither the driver nor a task
holds more of the query side, however many items there are.

Defined results: null and empty texts have no terms and are in no result, nor in N; an item without terms, or whose terms no document
holds, gives no row; rows that repeat an item_id are one item with the terms of all; null item ids are left out; rows that repeat a doc_id are documents of their own,
and tie; a null doc_id comes after all others in ties; very long texts are one index row each, at most as long as the vocabulary; empty
tables give an empty one; only doc_id, text and item_id are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table
from webloom.operators.storage import materialise

BEST = 50
SHARD_POSTINGS = 2_000_000
BLOCK_TERMS = 500_000
#: Entries of each list in the first round; twice as many in each further one.
FIRST_ROUND = 32
PARTS = 64
#: Lower-cases A-Z and puts a space in place of every ASCII character that is in no term; the bytes of others stay.
TERM_BYTES = bytes(b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[str]:
    return [t.decode() for t in term_bytes(text)]


def term_bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


def _item_terms():
    def run(item_id, text):
        rows = [(i, t) for i, x in zip(item_id, text, strict=True) for t in set(term_bytes(x))]
        return {"item_id": [i for i, _ in rows], "term": [t for _, t in rows]}

    return run


def _index(vocabulary: dict[bytes, int]):
    """(doc_id, n, terms, counts): counts of the vocabulary's terms by their number."""

    def run(doc_id, text):
        out = {"doc_id": doc_id, "n": [], "terms": [], "counts": []}
        for t in text:
            found = term_bytes(t)
            mine = sorted((vocabulary[w], k) for w, k in Counter(found).items() if w in vocabulary)
            out["n"].append(len(found))
            out["terms"].append([i for i, _ in mine])
            out["counts"].append([k for _, k in mine])
        return out

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What a term adds to a document's score; all in 64-bit integers."""
    m = 100 - 50 + (50 * n * n_docs) // length
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """Postings of some documents, by document and, highest impact first, by term. Documents are numbered in tie order."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.term, self.impact = term, impact
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.ids, begin = np.unique(term[order], return_index=True)
        self.bounds = np.append(begin, len(order))

    def lookup(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of documents that each have at least one posting: the impacts of wanted terms in their index rows."""
        sizes = self.start[docs + 1] - self.start[docs]
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.start[docs] - first, sizes)
        return np.add.reduceat(np.where(wanted[self.term[at]], self.impact[at], 0), first)

    def best(self, item: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents of an item (its terms' numbers, and the same as marks), their scores, and how many were looked up."""
        at = np.searchsorted(self.ids, item)
        at = at[(at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == item)]
        lists = [(int(b), int(e)) for b, e in zip(self.bounds[at], self.bounds[at + 1], strict=True)]
        met = np.zeros(len(self.start) - 1, bool)
        docs, scores, depth, step, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_ROUND, 0
        while lists:
            read = np.concatenate([self.list_doc[b + depth : min(b + depth + step, e)] for b, e in lists])
            new = np.unique(read[~met[read]])
            if len(new):
                met[new] = True
                looked += len(new)
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.lookup(new, wanted)])
                keep = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            depth += step
            step *= 2
            threshold = sum(int(self.list_impact[b + depth - 1]) for b, e in lists if b + depth < e)
            if len(docs) == k and threshold < scores[-1]:
                break
            lists = [(b, e) for b, e in lists if b + depth < e]
        good = scores > 0
        return docs[good], scores[good], looked


FOUND = "item_id long, doc_id long, score long"


def _search(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, length: int, k: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        marks = np.zeros(len(weights), bool)

        def search():
            null = np.concatenate([h[0] for h in held])
            ids, n, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            term, tf = (np.concatenate([h[i] for h in held]) for i in (4, 5))
            order = np.lexsort((ids, null))
            begin = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(begin[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order])
            term, tf, ids, null, n, sizes = term[at], tf[at], ids[order], null[order], n[order], sizes[order]
            shard = Shard(sizes, term, impacts(tf, np.repeat(n, sizes), weights[term], n_docs, length))
            found = []
            for item, numbers in items:
                marks[numbers] = True
                docs, scores, _ = shard.best(numbers, marks, k)
                marks[numbers] = False
                if len(docs):
                    found.append((np.full(len(docs), item), docs, scores))
            if found:
                item, docs, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids[docs], pa.int64(), mask=null[docs]), pa.array(scores)], names=["item_id", "doc_id", "score"])

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                ids, lists, counts = b.column("doc_id"), b.column("terms"), b.column("counts")
                sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                held.append((
                    ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), b.column("n").to_numpy(), sizes,
                    lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                ))
                size += int(sizes.sum())
                if size >= most:
                    yield from search()
                    held, size = [], 0
        if held:
            yield from search()

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their ranks: within hashed parts first, so no task sorts all rows of an item."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = Window.partitionBy("item_id", "_part").orderBy(*order)
    some = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all documents for every item."""
    spark = docs.sparkSession
    wanted = materialise(map_rows(items.where("item_id is not null"), ["item_id", "text"], "item_id long, term binary", _item_terms).distinct(), "search-items")
    blocks = -(-wanted.count() // block_terms)
    out = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        index = materialise(map_rows(docs, ["doc_id", "text"], "doc_id long, n long, terms array<int>, counts array<int>", _index, vocabulary=vocabulary).where("n > 0"), "search-index")
        n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weights[r["t"]] = weight(n_docs, r["count"])
        by: dict[int, list[int]] = {}
        for r in rows:
            if weights[i := vocabulary[bytes(r["term"])]] > 0:
                by.setdefault(r["item_id"], []).append(i)
        numbers = [(i, np.array(sorted(x), np.int64)) for i, x in sorted(by.items())]
        found = index.where(F.size("terms") > 0).mapInArrow(_search(numbers, weights, n_docs, length, k, shard_postings), FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return top(out, k)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS MATERIALIZED (
       SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
     q AS MATERIALIZED (
       SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
       FROM benchmark WHERE item_id IS NOT NULL),
     p AS MATERIALIZED (
       SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
     w AS MATERIALIZED (
       SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
       FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
     i AS MATERIALIZED (
       SELECT p.r, p.term, w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * len(d.w) * g.n_docs) // g.length))) AS impact
       FROM p JOIN w USING (term) JOIN d USING (r), g),
     s AS (SELECT q.item_id, i.r, CAST(sum(i.impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.r)
SELECT s.item_id, CAST(row_number() OVER o AS INTEGER) AS rank, d.doc_id, s.score FROM s JOIN d USING (r)
WHERE s.score > 0
WINDOW o AS (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) QUALIFY row_number() OVER o <= 50
"""
