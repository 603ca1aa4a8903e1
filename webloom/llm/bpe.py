"""BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has one BPE encoding, so it has one last token. The operator stores that token for
each prefix: an Aho-Corasick automaton over the vocabulary (suffix matches, longest first) proposes the
tokens that end at a place, and the pair-compatibility test picks the one that BPE itself would leave
beside the last token of the prefix before it. Back-pointers from the end give the ids; the work is linear
in the word's length for a bounded token length. Words are memoised per Python worker, up to a bound.

Defined results: null or empty text has no ids and decodes to ""; repeated rows give repeated results; very long texts
and words are encoded whole, in proportion to their length; there are no ties, as a prefix has one encoding;
columns beyond those named are not read, so clashing names do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table, tokenizer_path

FILE = "word_bpe_49k.json"
MEMO_WORDS = 400_000
#: White space by Unicode's property, written out as Python's own class holds some more characters.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NEVER = 1 << 60


def category_ranges(major: str, limit: int) -> str:
    """A character class's content: all code points below limit whose Unicode category starts with major."""
    out, start = [], None
    for i in range(limit + 1):
        inside = i < limit and unicodedata.category(chr(i))[0] == major
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


def word_pattern(limit: int) -> re.Pattern:
    """The file's own split pattern with letters and numbers written out, as libraries differ in the
    Unicode version of their classes. ``limit`` bounds the code points that a text may hold."""
    letter, number = category_ranges("L", limit), category_ranges("N", limit)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class PrefixBpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form, with or without a word-end suffix."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = suffix = model.get("end_of_word_suffix") or ""
        self.ids = vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        names = byte_names()
        # One symbol for each byte inside a word, and another for a byte that ends one.
        self.inner, self.last = names, [n + suffix for n in names]
        symbol = {n: chr(0x100 + b) for b, n in enumerate(names)}
        final = {n + suffix: chr(0x200 + b) for b, n in enumerate(names)} if suffix else {}
        self.inner_symbols = {b: chr(0x100 + b) for b in range(256)}
        self.end_shift = 0x100 if suffix else 0
        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        spelled: dict[int, str] = {}
        for n, c in [*symbol.items(), *final.items()]:
            if n in vocab:
                spelled[vocab[n]] = c
                self.rank[vocab[n]] = -1
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((a, b), r)
            if ab not in self.rank:
                self.rank[ab], self.left[ab], self.right[ab] = r, a, b
                spelled[ab] = spelled[a] + spelled[b]
        self.automaton = ahocorasick.Automaton()
        for i, s in spelled.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.memo_words = memo_words
        self.words, self.words_any = word_pattern(0x10000).findall, None
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side when it encodes their joined text: undoing their
        merges from the latest back, no merge across the border may come before those that are left."""
        if (got := self.fits.get((a, b))) is not None:
            return got
        key, before = (a, b), NEVER
        rank = self.rank
        while True:
            if self.pair.get((a, b), NEVER) < before:
                got = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                got = True
                break
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = got
        return got

    def word(self, text: str) -> list[int]:
        """Ids of one word (a pre-token)."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return []
        symbols = "".join(map(self.inner_symbols.__getitem__, data[:-1])) + chr(0x100 + self.end_shift + data[-1])
        n = len(symbols)
        last, back = [0] * (n + 1), [-1] * (n + 1)
        back[0] = 0
        fits = self.fits
        for end, (size, token) in self.automaton.iter(symbols):
            end += 1
            start = end - size
            if back[end] >= 0 or back[start] < 0:
                continue
            if start:
                ok = fits.get((last[start], token))
                if not (self.compatible(last[start], token) if ok is None else ok):
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def pieces(self, text: str) -> tuple[list[bytes], list[bytes]]:
        """For each word of text: its ids as little-endian unsigned 32-bit integers, and its decoded form."""
        parts = self.split_special(text) if self.split_special and "<|" in text else [text]
        ids, shown = [], []
        memo = self.memo
        for part in parts:
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                shown.append(part.encode())
                continue
            words = self.words
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if len(part.encode("utf-16-le", "surrogatepass")) > 2 * len(part):  # long lists of ranges are slow: only where needed
                    words = self.words_any = self.words_any or word_pattern(0x110000).findall
            for w in words(part.lower()):
                got = memo.get(w)
                if got is None:
                    found = self.word(w)
                    if len(memo) >= self.memo_words:
                        memo.clear()
                    got = memo[w] = (struct.pack(f"<{len(found)}I", *found), " ".join([self.names[i] for i in found]).encode())
                ids.append(got[0])
                shown.append(got[1])
        return ids, shown

    def encode(self, text: str | None) -> list[int]:
        data = b"".join(self.pieces(text or "")[0])
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode of a file that names no decoder: the tokens' own strings, joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def _digests(folder: str | None):
    bpe = load(tokenizer_path(FILE, folder))

    def run(doc_id, text):
        out = {"doc_id": doc_id, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in text:
            ids, shown = bpe.pieces(t or "")
            ids = b"".join(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b" ".join(x for x in shown if x)).hexdigest())
        return out

    return run


def _ids(folder: str | None):
    bpe = load(tokenizer_path(FILE, folder))
    return lambda doc_id, text: {"doc_id": doc_id, "ids": [bpe.encode(t) for t in text]}


def _texts(folder: str | None):
    bpe = load(tokenizer_path(FILE, folder))
    return lambda doc_id, ids: {"doc_id": doc_id, "decoded": [bpe.decode(x or []) for x in ids]}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<long>) for every row of docs; null text gives []."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(named, ["doc_id", "text"], "doc_id long, ids array<long>", _ids, folder=folder)


def decode(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, decoded) of rows (doc_id, ids); null ids give ""."""
    return map_rows(encoded, ["doc_id", "ids"], "doc_id long, decoded string", _texts, folder=folder)


def digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass and return the digests of both."""
    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, folder=folder)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
