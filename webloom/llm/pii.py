"""Personal data by bootstrapped contextual extraction, in DataFrame expressions alone.

Base patterns give seed entities with exact spans. Each seed's neighbouring words become lexical patterns:
the two words before it, the word before it, and the words around it. A bipartite graph ties patterns to the
values that they extract, seeds and unlabelled candidates alike; confidence runs from values to patterns
(the share of a pattern's values that a kind holds) and back to values (noisy-or over a value's patterns)
until the trusted patterns are the same as in a round before: as in the last one, or, should they go in a circle, as in the one
that closes it, whose values then count. Candidates of a plausible shape whose confidence reaches ``ACCEPT`` become added
spans; base spans stay as they are.

The scan looks at each text once. Only tokens with a digit or an at sign, and what stands around them, leave
it; counts are aggregated before they are shuffled.

Defined results: null and empty texts have no spans; a repeated row gets the same result each time; a null
doc_id is kept; an empty table gives an empty one; columns beyond those used are not read or, in redact(),
kept, whatever their names. Very long texts are looked at whole, in time n log n of their matches. A pattern that
two kinds share alike goes to the first kind, and so does a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table
from webloom.operators.storage import materialise

KINDS = ("email", "ip", "card", "phone")
#: Accepted spans up to this number in total are broadcast; beyond it they are joined by row.
BROADCAST_SPANS = 300_000
#: Least distinct values of a pattern, and the confidences that patterns and values need.
SUPPORT = 3
PATTERN_CONFIDENCE = 0.6
ACCEPT = 0.8

# A match can start only where the last one ended or where no character of its first class stands before,
# and repetitions that cannot help a match do not give back: equal matches, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Tokens that may be identifiers.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a candidate of each kind must look like, beyond the base pattern (its words and trailing marks aside).
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}$|^[0-9]{1,3}(?:[.,-][0-9]{1,3}){3}$",
    "card": r"^(?:[0-9][._-]?){13,19}$",
    "phone": r"^[(]?[0-9][0-9().-]{5,18}[0-9]$",
}


def quoted(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: str) -> str:
    """SQL for the Luhn test of a string of digits."""
    n = f"length({digits})"
    d = f"cast(substring({digits}, {n} - i, 1) as int)"
    return f"aggregate(sequence(0, {n} - 1), 0, (s, i) -> s + if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0))) % 10 = 0"


def holds(kind: str, value: str) -> str:
    """SQL for the condition that a match of a kind must meet."""
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "card":
        return f"length({digits}) between 13 and 19 and {luhn(digits)}"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def with_spans(df: DataFrame, name: str, pattern: str, when: str) -> DataFrame:
    """Adds array<struct<start, end, value, before, after>> of all matches in the column text, places in code
    points. The parts between matches and the matches add up to the places (prefix sums by doubling: n log n);
    before and after are what of the neighbouring parts is nearest."""
    q = quoted(pattern)
    n = f"size(_m_{name})"
    widths = f"zip_with(slice(_g_{name}, 1, {n}), _m_{name}, (g, m) -> length(g) + length(m))"
    ends = f"aggregate(sequence(0, cast(ceil(log2({n})) as int)), {widths}, (a, k) -> zip_with(a, concat(array_repeat(0, least(shiftleft(1, k), {n})), slice(a, 1, greatest({n} - shiftleft(1, k), 0))), (x, y) -> x + y))"
    return (
        df.withColumn(f"_m_{name}", F.expr(f"if({when}, regexp_extract_all(text, {q}, 0), cast(array() as array<string>))"))
        .withColumn(f"_g_{name}", F.expr(f"if({n} > 0, split(text, {q}, -1), cast(array() as array<string>))"))
        .withColumn(f"_e_{name}", F.expr(f"if({n} > 0, {ends}, cast(array() as array<int>))"))
        .withColumn(
            name,
            F.expr(
                f"transform(arrays_zip(_m_{name}, _e_{name}, transform(slice(_g_{name}, 1, {n}), x -> right(x, 80)), transform(slice(_g_{name}, 2, {n}), x -> left(x, 60))), "
                f"x -> struct(x._e_{name} - length(x._m_{name}) as start, x._e_{name} as end, x._m_{name} as value, x['2'] as before, x['3'] as after))"
            ),
        )
        .drop(f"_m_{name}", f"_g_{name}", f"_e_{name}")
    )


def scan(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, key, base, cand) for every row: base spans by kind and place, and further candidate tokens,
    both with their neighbouring words. key is a hash of the text. If asked for, the whole row comes along as a
    struct, where no name of its columns can clash."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    for kind in KINDS:
        df = with_spans(df, kind, PATTERNS[kind], "contains(text, '@')" if kind == "email" else "contains(text, '+')" if kind == "phone" else "text rlike '[0-9]'")
    df = with_spans(df, "cand", CANDIDATE, "text rlike '[0-9@]'")
    kinds = ", ".join(f"transform(filter({k}, x -> {holds(k, 'x.value')}), x -> struct({i} as kind, x.start, x.end, x.value, x.before, x.after))" for i, k in enumerate(KINDS))
    df = df.withColumn("base", F.expr(f"concat({kinds})"))
    # marks around a token are not part of its value
    lead, tail = quoted(r"""^[(\["'<]*"""), quoted(r"""[)\]"'>.,;:!?]*$""")
    df = df.withColumn(
        "cand",
        F.expr(
            f"filter(transform(cand, x -> struct(cast(null as int) as kind, x.start + length(regexp_extract(x.value, {lead}, 0)) as start, "
            f"x.end - length(regexp_extract(x.value, {tail}, 0)) as end, regexp_replace(regexp_replace(x.value, {tail}, ''), {lead}, '') as value, x.before, x.after)), "
            "c -> c.end - c.start >= 4 and not exists(base, b -> b.start < c.end and c.start < b.end))"
        ),
    )
    word = lambda text, pattern: f"lower(translate(regexp_extract({text}, {quoted(pattern)}, 1), '123456789', '000000000'))"
    context = (
        f"x -> struct(x.kind, x.start, x.end, x.value, {word('x.before', r'([^\s]+)[\s(\x22]*$')} as l1, "
        f"{word('x.before', r'([^\s]+)\s+[^\s]+[\s(\x22]*$')} as l2, {word('x.after', r'^[^\s]*\s+([^\s]+)')} as r1)"
    )
    for name in ("base", "cand"):
        df = df.withColumn(name, F.expr(f"transform({name}, {context})"))
    return df.select("doc_id", F.xxhash64("text").alias("key"), "base", "cand", *(["row"] if whole else []))


def graph(scanned: DataFrame) -> DataFrame:
    """Distinct edges (pattern, value, kind): kind is the seed's, or null for a candidate. Values are hashed."""
    x = scanned.select(F.explode(F.concat("base", "cand")).alias("x")).select("x.*")
    patterns = F.array(
        F.when(F.length("l1") > 0, F.concat(F.lit("B "), "l1")),
        F.when(F.length("l2") > 0, F.concat(F.lit("BB "), "l2", F.lit(" "), "l1")),
        F.when((F.length("l1") > 0) & (F.length("r1") > 0), F.concat(F.lit("BA "), "l1", F.lit(" _ "), "r1")),
    )
    return (
        x.select("kind", "value", F.explode(F.array_compact(patterns)).alias("pattern"))
        .groupBy(F.xxhash64("pattern").alias("pattern"), F.xxhash64("value").alias("value"))
        .agg(F.max("kind").alias("kind"), F.max(plausible("value")).alias("shapes"))
    )


def plausible(value: str) -> Column:
    """Bits of the kinds whose shape a value has."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(value).rlike(SHAPES[k]), 1 << i).otherwise(0) for i, k in enumerate(KINDS)])


def discover(scanned: DataFrame, support: int = SUPPORT, pattern_confidence: float = PATTERN_CONFIDENCE, accept: float = ACCEPT) -> DataFrame | None:
    """(value hash, found kind) of the candidates that the graph accepts; None if no pattern is trusted or no
    candidate has a plausible shape."""
    edges = materialise(graph(scanned), "pii-edges")
    if edges.where("kind is null and shapes > 0").isEmpty():
        return None
    known = edges.select("value", F.lit(None).cast("int").alias("found"), F.lit(0.0).alias("trust")).limit(0)
    seen = set()
    while True:
        held = edges.join(known, "value", "left").select("pattern", F.coalesce("kind", "found").alias("k"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("t"))
        share = [F.sum(F.when(F.col("k") == i, F.col("t")).otherwise(0.0)) / F.count("*") for i in range(len(KINDS))]
        scores = held.groupBy("pattern").agg(F.count("*").alias("n"), F.array(*share).alias("c"))
        best = F.array_max("c")
        trusted = materialise(
            scores.where((F.col("n") >= support) & (best >= pattern_confidence)).select("pattern", (F.array_position("c", best) - 1).cast("int").alias("found"), best.alias("c")), "pii-patterns"
        )
        now = tuple(trusted.agg(F.count("*"), F.sum(F.xxhash64("pattern", "found").cast("decimal(38,0)"))).first())
        if not now[0]:
            return None
        if now in seen:  # the same patterns score the same values
            break
        seen.add(now)
        open_edges = edges.where("kind is null and shapes > 0").join(trusted, "pattern").where("(shapes & shiftleft(1, found)) > 0")
        now = open_edges.groupBy("value", "found").agg((1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.99)))))).alias("trust"))
        known = materialise(now.groupBy("value").agg(F.max(F.struct("trust", "found")).alias("b")).select("value", "b.found", "b.trust"), "pii-values")
    return known.where(F.col("trust") >= accept).select("value", "found")


def added_spans(scanned: DataFrame, accepted: DataFrame | None) -> DataFrame | None:
    """(doc_id, key, added) for the rows that hold accepted candidates."""
    if accepted is None:
        return None
    occurrences = scanned.select("doc_id", "key", F.explode("cand").alias("x")).select("doc_id", "key", F.xxhash64("x.value").alias("value"), "x.start", "x.end")
    return (
        occurrences.join(accepted, "value").groupBy("doc_id", "key").agg(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added"))
    )


def attach(df: DataFrame, added: DataFrame | None) -> DataFrame:
    """Adds the column added to rows with doc_id and key; null-safe on doc_id."""
    if added is None:
        return df.withColumn("added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))
    added = materialise(added, "pii-added")
    a = added.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "added")
    if (added.agg(F.sum(F.size("added"))).first()[0] or 0) <= BROADCAST_SPANS:
        a = F.broadcast(a)
    return (
        df.join(a, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").drop("_d", "_k")
        .withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    )


def joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort(transform({spans}, x -> struct(x.kind, x.start, x.end))), x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, all spans, and the count of added ones."""
    scanned = materialise(scan(docs), "pii-scan")
    out = attach(scanned, added_spans(scanned, discover(scanned)))
    plain = "transform(base, x -> struct(x.kind, x.start, x.end))"
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.expr(joined(plain)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined(f"concat({plain}, added)")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets, and n_chars, where there is
    such a column, brought up to date; all columns stay, in order. Null texts stay null."""
    scanned = materialise(scan(docs, whole=True), "pii-scan")
    full = attach(scanned, added_spans(scanned, discover(scanned))).withColumn("text", F.col("row.text"))
    tags = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    text = F.expr(
        "if(text is null or size(base) + size(added) = 0, text, aggregate(array_sort(concat(transform(base, x -> struct(x.start, x.end, x.kind)), transform(added, x -> struct(x.start, x.end, x.kind)))), struct(0 as at, '' as out), "
        "(s, x) -> if(x.start < s.at, struct(greatest(s.at, x.end) as at, s.out as out), "
        f"struct(x.end as at, concat(s.out, substring(text, s.at + 1, x.start - s.at), array({tags})[x.kind]) as out)), "
        "s -> concat(s.out, substring(text, s.at + 1))))"
    )
    full = full.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return full.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
