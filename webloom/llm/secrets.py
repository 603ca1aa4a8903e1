"""Secret scan: fixed patterns, and password guess cost for values in a credential context.

The base patterns give their spans as they are. Further values that stand after a credential word are
judged by the least number of guesses that finds them: dynamic programming over the value's prefixes picks
the cheapest segmentation into known words, dates, repeats, keyboard walks and sequences in one direction, and
brute-force characters (costs are decimal logarithms). A segment may start anywhere. Values that cost at least ``MIN_COST`` become ``guess`` spans,
unless they overlap a base span.

Defined results: null and empty texts have no spans; very long texts and values are looked at whole; repeated rows give repeated results; ties: of segmentations of equal cost any gives the
same verdict, as only the cost counts, and a value that costs just ``MIN_COST`` is a span; an empty table
gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.common import map_rows, table

#: Decimal logarithm of the guesses from which a value counts as secret.
MIN_COST = 9.0
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Equal to all runs filtered by length: such a run starts where no such character stands before it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth|bearer|login|pin)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+is:?\x20+)["'`]?([^\s"'`<>,;]+)""",
    re.I | re.A,
)
WORDS = (
    "password pass word admin user login secret token root test default example changeme welcome letmein master key access "
    "monkey dragon qwerty sunshine princess football baseball shadow super hello love money summer winter spring autumn "
    "january february march april june july august september october november december monday friday sunday "
    "your none null true false required here enter value string public private server client home work company "
    "the and for that this with from have was are not you all can her one our out day get has him his how man new now old see two way who"
).split()
RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("4@3105$7!", "aaeiosstI".lower())
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Neighbours on a row of keys, to the right and to the left.
RIGHT = {pair for row in ROWS for pair in zip(row, row[1:], strict=False)}
LEFT = {(b, a) for a, b in RIGHT}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
#: Least length of a repeat, walk or sequence, and its price beside its length's logarithm.
RUN = 3
RUN_PRICE = {"repeat": 1.5, "right": 1.7, "left": 1.7, "up": 1.5, "down": 1.5}
#: A segment more multiplies the guesses by two.
JOIN = math.log10(2)


def brute_cost(value: str) -> float:
    """Log10 guesses a character: letters of one case follow a language's two bits, mixtures their alphabet."""
    lower, upper, digit = (any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    other = any(not c.isalnum() for c in value)
    if not digit and not other and not (lower and upper and not value[1:].islower()):
        return math.log10(4)
    return math.log10(max(10, 26 * lower + 26 * upper + 10 * digit + 10 * other) / 2 if lower or upper or other else 10)


def goes_on(a: str, b: str) -> tuple[str, ...]:
    """The kinds of runs in which b may follow a."""
    step = ord(b) - ord(a)
    found = {"repeat": not step, "up": step == 1, "down": step == -1, "right": (a, b) in RIGHT, "left": (a, b) in LEFT}
    return tuple(k for k, v in found.items() if v)


def guess_cost(value: str) -> float:
    """Log10 of the guesses of the cheapest segmentation of value; "" costs 0. A run's starts that a better one
    beats now are beaten from then on, as the logarithms of their lengths draw near, and are let go; so time is
    about linear in the length."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(LEET)
    per_char = brute_cost(value)
    dates: dict[int, list[int]] = {}
    for m in re.finditer(rf"(?=({DATE.pattern}))", value):
        dates.setdefault(m.end(1), []).append(m.start())
    begin = dict.fromkeys(RUN_PRICE, 0)  # where the run that ends here began, and starts in it with what lies before them
    starts: dict[str, list[tuple[int, float]]] = {k: [] for k in RUN_PRICE}
    best, brute = [0.0] * (n + 1), [0.0] * (n + 1)  # brute: the best that ends in brute force
    for e in range(1, n + 1):
        i = e - 1
        on = goes_on(low[i - 1], low[i]) if i else ()
        brute[e] = min(brute[e - 1], best[e - 1] + (JOIN if e > 1 else 0)) + per_char
        cost = brute[e]
        for size in range(3, min(LONGEST, e) + 1):
            s = e - size
            for text, extra in ((low, 0.0), (plain, JOIN)):
                if (r := RANK.get(text[s:e])) is not None:
                    upper = 0.0 if value[s:e].islower() or not value[s:e].isalpha() else JOIN
                    cost = min(cost, best[s] + JOIN * (s > 0) + r + extra + upper)
        for s in dates.get(e, ()):
            cost = min(cost, best[s] + JOIN * (s > 0) + (2.0 if e - s == 4 else 4.3))
        for kind, price in RUN_PRICE.items():
            if kind not in on:
                begin[kind] = i
                starts[kind].clear()
            elif e - begin[kind] >= RUN:
                s = e - RUN
                open_ = [*starts[kind], (s, best[s] + JOIN * (s > 0))]
                kept, under = [], math.inf
                for x, c in open_:  # a later start must be better than all earlier ones
                    if (now := c + math.log10(e - x)) < under:
                        under = now
                        kept.append((x, c))
                cost = min(cost, under + price)
                under, starts[kind] = math.inf, []
                for x, c in reversed(kept):  # and an earlier one have cost less before it
                    if c < under:
                        under = c
                        starts[kind].insert(0, (x, c))
        best[e] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base spans, sorted; starts and ends are code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, base: list[tuple[int, int, int]], min_cost: float = MIN_COST) -> list[tuple[int, int, float]]:
    """(start, end, cost) of further values in a credential context."""
    out = []
    if not ("=" in text or ":" in text or " is" in text.lower()):
        return out
    for m in CONTEXT.finditer(text):
        s, e = m.span(1)
        while e > s and text[e - 1] in ".!?)]}":
            e -= 1
        if e - s < 6 or any(a < e and s < b for a, _, b in base):
            continue
        if (cost := guess_cost(text[s:e])) >= min_cost:
            out.append((s, e, cost))
    return out


def _scan(min_cost: float):
    def run(doc_id, text):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
        out["doc_id"] = doc_id
        for t in text:
            base = base_spans(t) if t else []
            more = guess_spans(t, base, min_cost) if t else []
            named = [f"{BASE[k]}:{s}:{e}" for s, k, e in base]
            every = sorted([*base, *((s, 3, e) for s, e, _ in more)])
            for k, name in enumerate(BASE):
                out[f"n_{name}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(",".join(named).encode()).hexdigest())
            out["spans"].append(",".join(f"{(*BASE, 'guess')[k]}:{s}:{e}" for s, k, e in every))
            out["n_guess"].append(len(more))
        return out

    return run


def scan(docs: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, all spans, and the count of guess spans."""
    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long", _scan, min_cost=min_cost)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
