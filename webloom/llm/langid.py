"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its distinct words' hashed character n-grams; a linear layer and softmax
give the languages' probabilities. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled texts; a temperature fitted on a part that training does not see calibrates the
probabilities. As the layers are linear, every word's contribution to the logits is added up once per Python
worker and reused.

Probabilities add up to 1 whatever the text, so they do not show that it is in no learnt language. A text is
rejected by how typical it is instead: the mean, over its subwords, of the log ratio of their frequency in the
language that fits best to that in shuffled text. The bound is fitted on the part that training does not see, between
its own texts and shuffled ones.

Defined results: null text and text without a letter give ``und`` with score 0 and are rejected; a null
doc_id is never learnt from and is not held out; of languages of equal probability the first by name is given; very long texts are read whole; without any labelled text all rows give ``und``; repeated
rows give repeated results; an empty table gives an empty one; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table

BUCKETS = 1 << 12
DIM = 16
#: Sample bound: labelled texts per language, those with the smallest hashes of all rows.
SAMPLE_PER_LANG = 800
GRAMS = (2, 3, 4, 5)
MEMO_WORDS = 300_000
#: Share of rightly labelled validation texts, and of shuffled ones, that may be beyond the ends between which a
#: text is rejected or not; and so many subwords of no weight are added to a text, as few say little.
REJECT_SHARE, SHUFFLED_SHARE = 0.001, 0.01
PRIOR_SUBWORDS = 20
LETTERS = re.compile(r"[^\W\d_]+")


def word_buckets(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of the letter runs in lower-cased chunks of non-space characters, and each one's chunk.
    Runs are marked "<run>"; all windows of all runs are hashed at once, without those that span two runs."""
    marked = ["".join([f"<{r}>" for r in LETTERS.findall(c)]) for c in chunks]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    chunk = np.repeat(np.arange(len(chunks)), [len(m) for m in marked])
    opens = codes == ord("<")
    buckets, owners = [], []
    window, crossing = codes.copy(), np.zeros(len(codes), bool)
    for n in range(2, max(GRAMS) + 1):
        window = window[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        crossing = crossing[: len(window)] | opens[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(~crossing)
            x = window[at] * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(chunk[at])
    return np.concatenate(buckets), np.concatenate(owners)


def shuffled(words: list[str]) -> list[str]:
    """Words of the same lengths out of the same letters in another order, which follows from the words."""
    runs = sorted(r for w in words for r in LETTERS.findall(w))
    letters = "".join(runs)
    order = np.random.default_rng(zlib.crc32(letters.encode("utf-8", "surrogatepass"))).permutation(len(letters))
    mixed = "".join([letters[i] for i in order])
    ends = np.cumsum([len(r) for r in runs])
    return [mixed[e - len(r) : e] for e, r in zip(ends, runs, strict=True)]


def _counts():
    """Sparse subword counts of whole texts, each distinct word once: repeated lines weigh no more than others;
    and those of the texts with their letters shuffled, compressed, as they fill most buckets and all go to the driver."""

    def packed(words):
        x = np.bincount(word_buckets(words)[0], minlength=BUCKETS)
        i = np.flatnonzero(x)
        return i.astype("<u2").tobytes(), x[i].astype("<u4").tobytes()

    def run(text, lang):
        out = {"lang": lang, "at": [], "n": [], "mixed_at": [], "mixed_n": []}
        for t in text:
            words = list(set((t or "").lower().split()))
            mixed = [zlib.compress(b, 1) if b else b for b in packed(shuffled(words))]
            for (at, n), name in ((packed(words), ""), (mixed, "mixed_")):
                out[f"{name}at"].append(at)
                out[f"{name}n"].append(n)
        return out

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


SAMPLE = "lang string, at binary, n binary, mixed_at binary, mixed_n binary"


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """SAMPLE: packed subword counts, as they are and shuffled, of the per_lang texts of each language whose hashes are smallest (all, if fewer), out of all rows that
    may be learnt from; repeated rows count once. The same rule holds whatever the number of rows, and does not depend on how they fall into tasks."""
    may = docs.where(~held_out()).where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    # narrow rows; each task leaves out those beyond the limit before they are shuffled by language
    of_lang = Window.partitionBy("lang").orderBy("draw")
    least = may.select("lang", "draw").distinct().withColumn("place", F.row_number().over(of_lang)).where(F.col("place") <= per_lang).select("lang", "draw")
    drawn = may.join(F.broadcast(least), ["lang", "draw"]).dropDuplicates(["lang", "draw"])
    return map_rows(drawn, ["text", "lang"], SAMPLE, _counts)


class Model:
    """Word tables (logits and log ratios of a language's subwords) and temperature; small enough to travel with the task."""

    def __init__(self, langs: list[str], table: np.ndarray, ratios: np.ndarray, bias: np.ndarray, temperature: float, reject_under: float):
        self.langs, self.table, self.ratios, self.bias, self.temperature, self.reject_under = langs, table, ratios, bias, temperature, reject_under

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def typical(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (sums / (n + PRIOR_SUBWORDS)[:, None]).max(axis=1)


def frequencies(counts) -> np.ndarray:
    """Shares of the buckets over texts, each of the same weight; those never seen get a hundredth together."""
    total = np.zeros(BUCKETS)
    for at, n in counts:
        if len(at):
            total[at] += n / n.sum()
    return 0.99 * total / total.sum() + 0.01 / BUCKETS if total.any() else np.full(BUCKETS, 1 / BUCKETS)


def train(rows: list, epochs: int = 12, rate: float = 4.0, batch: int = 64, seed: int = 5) -> Model | None:
    """Fit the embeddings and the linear layer on sampled counts; a fifth is kept for calibration."""
    rows = [r for r in rows if len(r["at"])]
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    rows = sorted(rows, key=lambda r: (r["lang"], zlib.crc32(bytes(r["at"]) + bytes(r["n"]))))
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r["lang"]) for r in rows])

    def unpacked(i, name=""):
        at, n = (zlib.decompress(b) if name and b else b for b in (rows[i][f"{name}at"], rows[i][f"{name}n"]))
        return np.frombuffer(at, "<u2"), np.frombuffer(n, "<u4").astype(np.float64)

    def dense(which):
        """Subword shares of some texts; those of the whole sample would fill the driver's memory."""
        x = np.zeros((len(which), BUCKETS), np.float32)
        for to, i in enumerate(which):
            at, n = unpacked(i)
            x[to, at] = n / n.sum()
        return x

    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    k = len(langs)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    weight = (len(fit) / (k * np.maximum(1, np.bincount(y[fit], minlength=k)))).astype(np.float32)
    steps, total = 0, epochs * -(-len(fit) // batch)
    for _ in range(epochs):
        rng.shuffle(fit)
        for s in range(0, len(fit), batch):
            b = fit[s : s + batch]
            x = dense(b)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[y[b]][:, None] / len(b)
            lr = rate * (1 - steps / total)
            g_out, g_h = h.T @ p, p @ out.T
            # subword frequencies sum to 1, so embeddings get small gradients and a larger step
            emb -= (lr * 20) * (x.T @ g_h)
            out -= lr * 0.2 * g_out
            bias -= lr * 0.02 * p.sum(axis=0)
            steps += 1
    words = (emb @ out).astype(np.float64)
    # half of what a language is told from is shuffled text, half any subword at all
    other = 0.5 * frequencies(unpacked(i, "mixed_") for i in fit) + 0.5 / BUCKETS
    ratios = np.stack([np.log(frequencies(unpacked(i) for i in fit if y[i] == j) / other) for j in range(k)], axis=1)
    model = Model(langs, words, ratios, bias.astype(np.float64), 1.0, 0.0)
    check = held if len(held) else fit
    z = np.vstack([dense(check[s : s + batch]) @ words for s in range(0, len(check), batch)]) + model.bias

    def softmax(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.2, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(t)[np.arange(len(check)), y[check]] + 1e-12).mean()))
    p = softmax(model.temperature)
    typical = lambda which, name="": np.array([model.typical((n @ ratios[at])[None], n.sum(keepdims=True))[0] for at, n in (unpacked(i, name) for i in which)])
    right = check[p.argmax(axis=1) == y[check]]
    if len(right):
        least = np.quantile(typical(right), REJECT_SHARE)
        mixed = typical([i for i in check if len(rows[i]["mixed_at"])], "mixed_")
        model.reject_under = float(min(least, (least + np.quantile(mixed, 1 - SHUFFLED_SHARE)) / 2)) if len(mixed) else float(least)
    return model


def _predict(model: Model | None):
    memo: dict[str, int] = {}
    k = len(model.langs) if model else 0
    state = {"m": np.zeros((1024, 2 * k + 1))}
    columns = np.hstack([model.table, model.ratios]) if model else None

    def learn(words):
        """Add up the subwords of new words: a row each of logits, log ratios and a count."""
        words = list(words)
        buckets, owner = word_buckets(words)
        end = len(memo) + len(words)
        while len(state["m"]) < end:
            state["m"] = np.vstack([state["m"], np.zeros_like(state["m"])])
        rows = np.empty((len(words), 2 * k + 1))
        for j in range(2 * k):
            rows[:, j] = np.bincount(owner, columns[buckets, j], len(words))
        rows[:, 2 * k] = np.bincount(owner, minlength=len(words))
        state["m"][len(memo) : end] = rows
        memo.update(zip(words, range(len(memo), end), strict=True))

    def run(doc_id, held, text):
        out = {"doc_id": doc_id, "held_out": held, "lang_pred": [], "score": [], "rejected": []}
        sums, ns, letters = np.zeros((len(text), 2 * k)), np.zeros(len(text)), []
        for i, t in enumerate(text):
            found = bool(t) and any(any(map(str.isalpha, m[0])) for m in LETTERS.finditer(t))
            letters.append(found)
            if not found or model is None:
                continue
            if len(memo) > MEMO_WORDS:
                memo.clear()
            words = set(t.lower().split())
            if new := words.difference(memo):
                learn(new)
            s = state["m"][np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0)
            sums[i], ns[i] = s[:-1], s[-1]
        p, typical = (model.probabilities(sums[:, :k], ns), model.typical(sums[:, k:], ns)) if model else (None, None)
        for i, found in enumerate(letters):
            known = found and model is not None
            best = int(p[i].argmax()) if known else -1
            score = float(p[i, best]) if known else 0.0
            out["lang_pred"].append(model.langs[best] if known else "und")
            out["score"].append(score)
            out["rejected"].append(not known or bool(typical[i] < model.reject_under))
        return out

    return run


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    return train(labelled_sample(docs, per_lang).collect())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; only the text is looked at."""
    named = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_rows(named, ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", _predict, model=model)


def _keep(model: Model | None, names: list[str], text: str):
    predict = _predict(model)

    def run(*columns):
        got = dict(zip(names, columns, strict=True))
        keep = [not r for r in predict([None] * len(columns[0]), [False] * len(columns[0]), got[text])["rejected"]]
        return {n: [x for x, k in zip(c, keep, strict=True) if k] for n, c in got.items()}

    return run


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return map_rows(plain, plain.columns, schema, _keep, model=model, names=plain.columns, text=f"c{docs.columns.index('text')}").toDF(*docs.columns)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
