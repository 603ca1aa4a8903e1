"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document becomes 16 statistics of its whole text, in fixed point. Standardised, they are mapped to cosines of
random projections, whose products approximate a Gaussian kernel. Every task adds up the normal equations of its
labelled rows for each of four folds (by the id's crc32) and each kernel width; Spark adds up the tasks. As a fold's equations
can be taken off the whole, width and ridge are chosen by the error on left-out folds without another pass, and
the scores that isotonic regression is fitted on come from models that have not seen their row. All sums are
of whole numbers, so a model does not depend on how rows fall into tasks or on tasks that run again.

The labels of all rows that may be learnt from are used; no sample is drawn. The driver holds the sums (a few hundred kB)
and at most ``BINS`` counts of scores.

Defined results: null text counts as empty, whose statistics are zero; a null doc_id is neither learnt from nor held out;
a doc_id with several labels counts with each of them, other labels than 0 and 1 and null do not count; repeated rows
get the same score, and each of them counts in learning; without any label to learn from every score is 0.5; ties: a score on a step gets the step's value; very long
texts cost time in proportion; empty tables give empty ones; only doc_id, text and quality are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table
from webloom.operators.storage import materialise

FOLDS = 4
FEATURES = 128
SEED = 11
#: Kernel widths: factors of 1 / (2 x statistics), at which two rows of mean distance have a kernel of 1 / e.
WIDTHS = (0.25, 1.0, 4.0)
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
BINS = 1 << 14
KEEP_FROM = 0.3
#: Fixed point of statistics and of cosines.
UNIT, COS_UNIT = 1 << 16, 1 << 12
#: Fixed point of weights: a score's products and their sum are below 2^53 and so exact.
WEIGHT_UNIT = 1 << 36
#: Columns of sums in one row that a task hands on.
WIDE = 16
NAMES = (
    "characters", "words", "word_length", "upper_share", "digit_share", "punctuation_share", "symbol_share", "symbol_runs",
    "distinct_words", "repeated_next", "commonest_word", "words_without_letters", "distinct_pairs", "distinct_lines", "line_length", "lines_ended",
)

LOWER, UPPER, DIGIT, POINT, SPACE, SYMBOL = range(6)
#: Code points from here on count as letters.
TABLE_END = 0x3000


def _kind(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isdigit():
        return DIGIT
    return POINT if c in ".,;:?!'\"()-" else SYMBOL


KINDS = np.array([_kind(chr(i)) for i in range(TABLE_END)] + [LOWER], np.uint8)


def statistics(text: str | None) -> list[int]:
    """The statistics of NAMES in fixed point; zero for a text without words."""
    words = (text or "").split()
    if not words:
        return [0] * len(NAMES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = KINDS[np.minimum(codes, TABLE_END)]
    n = np.bincount(kinds, minlength=6)
    inked = len(codes) - n[SPACE]
    marks = (kinds == SYMBOL) | (kinds == POINT)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(words) - 1
    shares = (
        np.log1p(len(codes)), np.log1p(len(words)), np.log1p(inked / len(words)), n[UPPER] / max(1, n[UPPER] + n[LOWER]),
        n[DIGIT] / inked, n[POINT] / inked, n[SYMBOL] / inked, (marks[1:] & marks[:-1]).sum() / len(words),
        len(counts) / len(words), sum(map(str.__eq__, words, words[1:])) / max(1, pairs), max(counts.values()) / len(words),
        sum(k for w, k in counts.items() if not any(map(str.isalpha, w))) / len(words), len(set(zip(words, words[1:]))) / pairs if pairs else 1.0,
        len(set(lines)) / len(lines), np.log1p(inked / len(lines)), sum(x.rstrip().endswith((".", "!", "?", "\"", ":")) for x in lines) / len(lines),
    )
    return [round(float(x) * UNIT) for x in shares]


def _statistics():
    return lambda doc_id, text: {"doc_id": doc_id, "stats": [statistics(t) for t in text]}


def remainder() -> F.Column:
    """The id's crc32 modulo 5; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written to the shared folder: the text is read once."""
    return materialise(map_rows(docs, ["doc_id", "text"], "doc_id long, stats array<int>", _statistics), "quality-stats")


def projections() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(len(NAMES), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def cosines(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, width: float) -> np.ndarray:
    """Features in fixed point, with a constant last."""
    w, phase = projections()
    x = np.clip((stats - mean) / scale, -8, 8)
    w = w * np.sqrt(width / len(NAMES))
    # added up in one order, whatever the batch: a matrix product's order depends on its shape
    angle = np.tile(phase, (len(x), 1))
    for j in range(len(NAMES)):
        angle += x[:, j : j + 1] * w[j]
    z = np.rint(np.cos(angle) * COS_UNIT)
    return np.hstack([z, np.full((len(z), 1), float(COS_UNIT))])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


SUMS = "fold int, width int, part int, " + ", ".join(f"s{i} long" for i in range(WIDE))


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    """mapInArrow: the task's sums of n z z' (upper triangle) and of positives z, per fold and width, WIDE at a time."""
    upper = np.triu_indices(FEATURES + 1)
    length = len(upper[0]) + FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, len(WIDTHS), -(-length // WIDE) * WIDE), np.int64)
        some = False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                some = True
                stats, fold = _stats(part), part.column("fold").to_numpy()
                n, good = (part.column(c).to_numpy().astype(np.float64) for c in ("n", "good"))
                for k, width in enumerate(WIDTHS):
                    z = cosines(stats, mean, scale, width)
                    for f in range(FOLDS):
                        m = fold == f + 1
                        # products of whole numbers below 2^53: exact in any order
                        a = (z[m] * n[m, None]).T @ z[m]
                        total[f, k, :length] += np.concatenate([a[upper], good[m] @ z[m]]).astype(np.int64)
        if some:
            rows = total.reshape(-1, WIDE)
            parts = total.shape[2] // WIDE
            f, k, p = np.unravel_index(np.arange(len(rows)), (FOLDS, len(WIDTHS), parts))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (f, k, p)] + [pa.array(rows[:, i].copy()) for i in range(WIDE)], names=["fold", "width", "part"] + [f"s{i}" for i in range(WIDE)])

    return run


@dataclass
class Model:
    """A kernel width, the weights of the whole and of each left-out fold, and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    width: float
    weights: np.ndarray  # FOLDS + 1 rows of whole numbers, in units of 1 / WEIGHT_UNIT, the last from all folds
    steps_x: np.ndarray
    steps_y: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return cosines(stats, self.mean, self.scale, self.width) @ self.weights.T / WEIGHT_UNIT

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats)[:, -1], self.steps_x, self.steps_y), 0.0, 1.0)


def solve(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of ridge regression from normal equations; the constant is not shrunk."""
    n = max(1.0, a[-1, -1] / COS_UNIT**2)
    penalty = np.full(len(a), ridge * n * COS_UNIT**2 * FEATURES)
    penalty[-1] = 1e-9 * COS_UNIT**2
    return np.linalg.solve(a + np.diag(penalty), b)


def unpack(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Matrices and right sides by fold and width out of the collected sums."""
    upper = np.triu_indices(FEATURES + 1)
    length = len(upper[0]) + FEATURES + 1
    flat = np.zeros((FOLDS, len(WIDTHS), -(-length // WIDE) * WIDE))
    for r in rows:
        flat[r["fold"], r["width"], r["part"] * WIDE : (r["part"] + 1) * WIDE] = r[3:]
    a = np.zeros((FOLDS, len(WIDTHS), FEATURES + 1, FEATURES + 1))
    a[..., upper[0], upper[1]] = a[..., upper[1], upper[0]] = flat[..., : len(upper[0])]
    return a, flat[..., len(upper[0]) : length]


def choose(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """The width and ridge of the least squared error on left-out folds, and the weights of each fold's model and of the whole's."""
    best = None
    for k in range(a.shape[1]):
        for ridge in RIDGES:
            w = [solve(a[:, k].sum(axis=0) - a[f, k], b[:, k].sum(axis=0) - b[f, k], ridge) for f in range(len(a))]
            error = sum(w[f] @ a[f, k] @ w[f] - 2 * w[f] @ b[f, k] for f in range(len(a)))
            if best is None or error < best[0]:
                best = error, k, np.stack([*w, solve(a[:, k].sum(axis=0), b[:, k].sum(axis=0), ridge)])
    return best[1], best[2]


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising x: the ends of each block, and its share of positives at both."""
    blocks: list[list] = []
    for i in range(len(x)):
        blocks.append([good[i], n[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, m, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + m, blocks[-1][2], end]
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def _bins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(_stats(b))[np.arange(b.num_rows), b.column("fold").to_numpy() - 1]
            at = np.floor((np.clip(raw, -0.5, 1.4999) + 0.5) / 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("n"), b.column("good")], names=["bin", "n", "good"])

    return run


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """The model of ``described`` rows and (doc_id, quality) labels; None where there is nothing to learn from."""
    per = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))
    rows = stats.where("doc_id is not null").withColumn("fold", remainder().cast("int")).where("fold <> 0").join(per, "doc_id").select("fold", "n", "good", "stats")
    rows = materialise(rows, "quality-train")
    exact = [F.col("stats")[i].cast("decimal(12,0)") for i in range(len(NAMES))]
    weight = F.col("n").cast("decimal(10,0)")
    sums = rows.agg(F.sum("n"), *[F.sum(weight * x) for x in exact], *[F.sum((weight * x * x).cast("decimal(38,0)")) for x in exact]).first()
    if not sums[0]:
        return None
    n, first, second = int(sums[0]), [int(x) for x in sums[1 : 1 + len(NAMES)]], [int(x) for x in sums[1 + len(NAMES) :]]
    mean = np.array([s / n for s in first])
    # n times the sum of squares less the square of the sum, in whole numbers
    scale = np.array([max(UNIT / 1000, ((n * q - s * s) ** 0.5) / n) for s, q in zip(first, second, strict=True)])
    summed = rows.mapInArrow(_normal_equations(mean, scale), SUMS).groupBy("fold", "width", "part").agg(*[F.sum(f"s{i}") for i in range(WIDE)])
    k, weights = choose(*unpack(summed.collect()))
    model = Model(mean, scale, WIDTHS[k], np.rint(weights * WEIGHT_UNIT), np.zeros(1), np.zeros(1))
    bins = rows.mapInArrow(_bins(model), "bin int, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    x = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in bins])
    model.steps_x, model.steps_y = isotonic(x, np.array([r["good"] for r in bins], float), np.array([r["n"] for r in bins], float))
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``described`` rows."""
    named = stats.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_stats(b)) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= KEEP_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return named.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = described(table(spark, sf_dir, "documents"))
    return score(stats, fit(stats, table(spark, sf_dir, "labels")))
