"""N-gram Jaccard join over word shingles, exact, by size-banded tiles and hashed bitmap signatures.

A document's shingles are 64-bit hashes of five lower-cased words. Two documents of Jaccard similarity
0.8 or more differ in at most (a + b) / 9 shingles, where a and b are their set sizes. Sizes fall into
bands, and each band cuts the hash space into more segments than its documents may differ by: so many segments
at least, the rest, hold the same shingles in both. Documents of a band with an equal segment share a tile, and
only documents that share a tile are compared. A comparison first bounds the overlap from above by the bits
that one bitmap signature has beyond the other; pairs that the bound does not exclude are intersected
exactly as sorted arrays.

Not all segments have to make tiles. Put segments in one order over all documents, by their count of shingles
and then by a hash of their content. A document may leave out its lowest segments, one fewer than are equal at
least in any linked pair: then the highest equal segment of a pair is in both documents, and neither can have left
it out without leaving out all the equal ones. So no linked pair is lost, at any size, and what makes tiles are the
segments of two shingles and more, which strangers seldom share.

Equal sets are one vertex from the start, named by 128 bits; where two sets share the first 64, both get other
names. A tile yields pairs of one of its sets with the others; once
these are judged, tiles whose members are still in different components are compared as a whole: bit counts
of all their pairs across components, in blocks, and exact intersections of the pairs that remain. So
groups of near copies cost pairs in proportion to their members, a passage that many documents share costs
bit counts, and every pair of a tile is either compared or known to be connected. A tile of many blocks is first compared
within each block, which connects what is near, so that few pairs are left for the rest of its grid. A set of many pairs meets
them in several places.

Defined results: null and empty texts have no shingles and stay alone; with one to four words the whole
sequence is the one shingle; repeated rows and equal texts are linked; a similarity of just 0.8 links; very long texts are used whole; a null doc_id is a row of its own
that can be linked but never names a component unless all ids in it are null; an empty table gives an empty
one; only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table, unused
from webloom.operators.components import connected_components
from webloom.operators.storage import materialise

WIDTH = 5
#: Similarity as a ratio: 100 x intersection >= 80 x union.
NUMERATOR, DENOMINATOR = 80, 100
#: Bits of the least bitmap; a set has as many as shingles, rounded up to a power of two, if that is more.
BITMAP_BITS = 1024
#: Segment entries that one task takes, and members of a tile that one block of its pairs takes.
BUCKET_ENTRIES = 2_000_000
BLOCK = 1_000
#: Pairs of one set that meet it in one place.
HOT_PAIRS = 5_000
#: Rows of small tiles that are compared together.
ROWS = 1_000
#: Ways to choose the set of a tile that the others are tried with first.
CENTRES = 4
#: Places of the bitmap by which texts that nobody asks for are dropped before they are shuffled.
WANTED_BITS = 1 << 27
#: If a block leaves more possible pairs a row than this, only so many nearest ones of each row are tried in this
#: round, and in the next one MORE times as many.
NEAREST = 4
MORE = 8
BAND_STEP = 2
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: Odd factors of the words of a shingle.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: White space between words, and bytes with A-Z in lower case; other bytes stay as they are.
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
FOLDED = np.arange(256, dtype=np.uint16) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint16)
#: A hash of every byte at every place in a word, modulo PLACES; and bytes that are looked at together.
PLACES = 64
BYTES = mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * MIX[2])
CHUNK = 1 << 20


def changes(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours start; x is not empty."""
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return np.flatnonzero(first)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the scrambled sum of the hashes of its bytes, each by its place."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(~SPACE[raw])
    if not len(at):
        return np.empty(0, np.uint64)
    start = np.empty(len(at), bool)
    start[0] = True
    np.greater(at[1:] - at[:-1], 1, out=start[1:])
    start = np.flatnonzero(start)
    size = np.diff(np.append(start, len(at)))
    place = np.arange(len(at)) - np.repeat(start, size)
    value = BYTES[FOLDED[raw[at]] + ((place & (PLACES - 1)) << 8)]
    if int(size.max()) > PLACES:
        far = place >= PLACES
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64))
    return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * MIX[1])


def shingle(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    parts, at, n = [], 0, len(text or b"")
    while at < n:  # a long text in parts that end with a word
        end = at + CHUNK
        while end < n and not SPACE[text[end]]:
            end += 1
        parts.append(word_hashes(text[at:end] if at or end < n else text))
        at = end
    w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(w):
        return w
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    acc = w[:n] * FACTORS[0] + np.uint64(width)
    for k in range(1, width):
        acc += w[k : k + n] * FACTORS[k]
    acc = mix(acc)
    acc.sort()
    return acc[changes(acc)]


def digest(s: np.ndarray, id_bits: int = 64) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers; the first of fewer bits in tests."""
    a, b = mix(s + MIX[2]).sum(dtype=np.uint64), mix(s * MIX[0] + MIX[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)) >> (64 - id_bits), int(b.astype(np.int64))


def most_differing(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b: with overlap i and union u,
    i / u >= N / D and i + u = a + b, so u - i <= (a + b) (D - N) / (D + N)."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def _bands() -> np.ndarray:
    """Upper bounds of symmetric differences, band by band; the last exceeds any that fits in memory."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_STEP)))
    return np.array(out)


BANDS = _bands()


def segments(differing: int) -> int:
    """Segments of a band: more than may differ, and some to spare, so that small ones can be left out."""
    return differing + 2 + differing // 4


def bands_of(n: int) -> range:
    """The bands in which a set of size n can meet a partner: from its smallest partner to its largest."""
    low, high = -(-n * NUMERATOR // DENOMINATOR), n * DENOMINATOR // NUMERATOR
    first, last = most_differing(n, low), most_differing(n, high)
    if last == 0:
        return range(0)
    return range(int(np.searchsorted(BANDS, max(1, first))), int(np.searchsorted(BANDS, last)) + 1)


@cache
def plan(n: int) -> list[tuple[int, int, int]]:
    """(segments, how many of them may be left out, salt of the keys) in each band of a set of size n."""
    widest, out = most_differing(n, n * DENOMINATOR // NUMERATOR), []
    for band in bands_of(n):
        m = segments(int(BANDS[band]))
        out.append((m, m - min(int(BANDS[band]), widest) - 1, (band + 1) * int(MIX[2]) & 0xFFFFFFFFFFFFFFFF))
    return out


def tile_keys(s: np.ndarray) -> np.ndarray:
    """64-bit keys of the tiles that a sorted set belongs to."""
    if not len(s):
        return s
    out, high, content = [], s >> np.uint64(40), mix(s ^ MIX[2])
    for m, spare, salt in plan(len(s)):
        at = (high * np.uint64(m)) >> np.uint64(24)  # non-decreasing, as s is sorted
        starts = changes(at)
        size = np.diff(np.append(starts, len(at)))
        key = mix(np.add.reduceat(content, starts) + mix(at[starts] + np.uint64(salt)))
        empty = m - len(starts)
        if spare >= empty:
            if drop := spare - empty:
                key = key[np.lexsort((key, size))[drop:]]
        else:  # so few to spare that empty ones make tiles as well
            none = mix(mix(np.setdiff1d(np.arange(m, dtype=np.uint64), at[starts]) + np.uint64(salt)))
            none.sort()
            out.append(none[spare:])
        out.append(key)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """For each place of a bitmap, whether an odd number of shingles hash to it."""
    bits = max(BITMAP_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITMAP_BITS
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps in the rows of x, as they are with fewer bits."""
    return x if x.shape[-1] == words else np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, words), axis=-2)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of bitmaps, in the last axis, at the smaller one's width."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)


def could_link(na: np.ndarray, nb: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether sizes and the count of differing bits leave a link possible. Every shingle that only one set has
    turns one bit, so the bitmaps differ in no more bits than the sets in shingles, and what differs does not overlap."""
    need = -(-(na + nb) * NUMERATOR // (NUMERATOR + DENOMINATOR))  # least overlap of a link
    return (np.minimum(na, nb) >= need) & ((na + nb - differing) // 2 >= need)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked, by their exact intersection."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-(len(a) + len(b)) * NUMERATOR // (NUMERATOR + DENOMINATOR))
    if len(a) < need:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= need


SETS = "doc_id long, key long, n_shingles long, d1 long, d2 long, bits binary, bucket long, tiles binary, nodes binary, times binary"


def _sets(buckets: int, id_bits: int):
    """One row per document, its set's names and bitmap; and now and then, per bucket, the low 32 bits of tile keys
    beside the sets (nodes, times: each set's d1 and how many keys in a row are its own)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    form = to_arrow_schema(_parse_datatype_string(SETS))

    def batch(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in form], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        parts: dict[int, list] = defaultdict(list)
        held = 0

        def flush():
            at = sorted(parts)
            out = batch(
                bucket=at,
                tiles=[np.concatenate([k for k, _ in parts[b]]).tobytes() for b in at],
                nodes=[np.array([d for _, d in parts[b]], np.int64).tobytes() for b in at],
                times=[np.array([len(k) for k, _ in parts[b]], np.uint32).tobytes() for b in at],
            )
            parts.clear()
            return out

        for got in batches:
            rows = [], [], [], []
            for text in got.column(2).cast(pa.binary()).to_pylist():
                s = shingle(text)
                a, b = digest(s, id_bits)
                for x, v in zip(rows, (len(s), a, b, bitmap(s).tobytes()), strict=True):
                    x.append(v)
                if (a, b) in seen:
                    continue
                if len(seen) < 300_000:  # equal sets of one task give their keys once; sets are made distinct later anyway
                    seen.add((a, b))
                k = tile_keys(s)
                if not len(k):
                    continue
                k.sort()
                at = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                low = k.astype(np.uint32)
                cuts = changes(at).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
                    parts[int(at[i])].append((low[i:j], a))
                held += len(k)
            if len(rows[0]):
                yield batch(doc_id=got.column(0), key=got.column(1), n_shingles=rows[0], d1=rows[1], d2=rows[2], bits=rows[3])
            if held > 1_000_000:
                yield flush()
                held = 0
        if parts:
            yield flush()

    return run


def _tiles(keys: tuple, t: pa.Table) -> pa.Table:
    """A bucket's pairs (a, b) of each tile's first set with the others, and the memberships (b null) of the
    tiles of three sets and more, of those with equal members once. Which set is first follows from one of a few
    orders; so sets of many common tiles are tried with a few of their group."""
    k = np.concatenate([np.frombuffer(x, np.uint32) for x in t["tiles"].to_pylist()])
    d = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(n, np.uint32)) for x, n in zip(t["nodes"].to_pylist(), t["times"].to_pylist(), strict=True)])
    order = np.lexsort((mix(d.view(np.uint64) + (k % CENTRES) * MIX[2]), k))
    k, d = k[order], d[order]
    keep = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
    k, d = k[keep], d[keep]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[starts, len(k)])
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "tile")})
    at = np.concatenate([np.arange(s + 1, s + n) for s, n in zip(starts, sizes, strict=True)])
    pairs = np.unique(np.sort(np.stack([np.repeat(d[starts], sizes - 1), d[at]]), axis=0), axis=1)
    seen, a, tile = set(), [], []
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        x = d[s : s + n]
        name = int(mix(x.view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
        if name not in seen:
            seen.add(name)
            a.append(x)
            tile.append(np.full(n, name))
    a, tile = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (a, tile))
    null = pa.nulls(len(a), pa.int64())
    return pa.table(
        {"a": pa.array(np.r_[pairs[0], a]), "b": pa.concat_arrays([pa.array(pairs[1]), null]), "tile": pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(tile, pa.int64())])}
    )


def _possible():
    def run(a, b, na, nb, bits_a, bits_b):
        keep = np.zeros(len(a), bool)
        na, nb = np.array(na, np.int64), np.array(nb, np.int64)
        widths: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, (x, y) in enumerate(zip(bits_a, bits_b, strict=True)):
            widths[len(x), len(y)].append(i)
        for at in widths.values():
            x, y = (np.frombuffer(b"".join([z[i] for i in at]), np.uint64).reshape(len(at), -1) for z in (bits_a, bits_b))
            keep[at] = could_link(na[at], nb[at], differing_bits(x, y))
        return {"a": [v for v, k in zip(a, keep, strict=True) if k], "b": [v for v, k in zip(b, keep, strict=True) if k]}

    return run


def _verify():
    def run(a, b, s_a, s_b):
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(s_a, s_b, strict=True)]
        return {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}

    return run


def _compare(x: pa.Table, y: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows of x and y, or of different rows of x, in different components c, that sizes and bit counts
    leave possible: ids and differing bits. Rows are ordered by size n; so a row meets only those whose size allows a link."""
    sides = [t.sort_by([("n", "ascending"), ("id", "ascending")]) for t in (x, y) if t is not None]
    ids, n, c = zip(*[[t[k].to_numpy() for k in ("id", "n", "c")] for t in sides], strict=True)
    runs = []  # of bitmaps of one width, which grows with the size
    for t in sides:
        bits = t["bits"].to_pylist()
        cuts = [*changes(np.array([len(v) for v in bits])).tolist(), len(bits)]
        runs.append([(i, j, np.frombuffer(b"".join(bits[i:j]), np.uint64).reshape(j - i, -1)) for i, j in zip(cuts, cuts[1:], strict=False)])
    low = np.searchsorted(n[-1], -(-n[0] * NUMERATOR // DENOMINATOR), "left")
    high = np.searchsorted(n[-1], n[0] * DENOMINATOR // NUMERATOR, "right")
    out = []
    for s, e, mine in runs[0]:
        step = max(1, 250_000 // max(1, len(n[-1]) * mine.shape[1] // 4))
        for i in range(s, e, step):
            j = min(i + step, e)
            for p, q, other in runs[-1]:
                p2, q2 = max(p, int(low[i])), min(q, int(high[j - 1]))
                if y is None:
                    p2 = max(p2, i + 1)
                if p2 >= q2:
                    continue
                a, b = mine[i - s : j - s, None], other[None, p2 - p : q2 - p]
                ok = c[0][i:j, None] != c[-1][None, p2:q2]
                if y is None:
                    ok &= np.arange(p2, q2)[None] > np.arange(i, j)[:, None]
                words = min(a.shape[2], b.shape[2])
                a, b = folded(a, words), folded(b, words)
                # a quarter of the words excludes most
                u, v = np.nonzero(ok & could_link(n[0][i:j, None], n[-1][None, p2:q2], np.bitwise_count(a[..., : words // 4] ^ b[..., : words // 4]).sum(axis=2, dtype=np.int64)))
                differing = np.bitwise_count(a[u, 0] ^ b[0, v]).sum(axis=1, dtype=np.int64)
                keep = could_link(n[0][i + u], n[-1][p2 + v], differing)
                out.append((ids[0][i + u[keep]], ids[-1][p2 + v[keep]], differing[keep]))
    return tuple(np.concatenate(z) if out else np.empty(0, np.int64) for z in (zip(*out, strict=True) if out else ((), (), ())))


def _nearest(a: np.ndarray, b: np.ndarray, gap: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the nearest of one of their ends, so many of each."""
    keep = np.zeros(len(a), bool)
    for mine, other in ((a, b), (b, a)):
        order = np.lexsort((other, gap, mine))
        starts = changes(mine[order])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        keep[order[rank < most]] = True
    return keep


def _block(most: int):
    def group(keys: tuple, t: pa.Table) -> pa.Table:
        """Possible pairs (a, b) across components of one block of a large tile, or of several small tiles. Where
        they are too many, only nearest ones, and a row that names the tile."""
        out, unfinished = ([], []), []
        t = t.combine_chunks().sort_by([("tile", "ascending"), ("side", "ascending")])
        tile, side = t["tile"].to_numpy(), t["side"].to_numpy()
        cuts = [*changes(tile).tolist(), len(tile)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            middle = i + int(np.searchsorted(side[i:j], 1))
            x, y = t.slice(i, middle - i), t.slice(middle, j - middle)
            if keys[1].as_py() != keys[2].as_py():
                if not len(x) or not len(y):
                    continue
                a, b, gap = _compare(x, y)
            else:
                a, b, gap = _compare(x, None)
            if len(a) > most * (j - i):
                keep = _nearest(a, b, gap, most)
                if not keep.all():
                    a, b = a[keep], b[keep]
                    unfinished.append(int(tile[i]))
            out[0].append(np.minimum(a, b))
            out[1].append(np.maximum(a, b))
        a, b = np.unique(np.stack([np.concatenate(z) if z else np.empty(0, np.int64) for z in out]), axis=1)
        none = pa.nulls(len(unfinished), pa.int64())
        columns = {"a": [pa.array(a), none], "b": [pa.array(b), none], "tile": [pa.nulls(len(a), pa.int64()), pa.array(unfinished, pa.int64())]}
        return pa.table({k: pa.concat_arrays(v) for k, v in columns.items()})

    return group


NO_ID = -(1 << 63)


def _own(id_bits: int):
    def run(ids, d1, d2, text):
        out = {"id": [], "s": []}
        for i, a, b, t in zip(ids, d1, d2, text, strict=True):
            s = shingle(t)
            if digest(s, id_bits) == (a, b):
                out["id"].append(i)
                out["s"].append(s.tobytes())
        return out

    return run


def meet(pairs: DataFrame, arrays: DataFrame, end: str) -> DataFrame:
    """pairs with the array s_<end> of their end a or b. A set of very many pairs is met in several places."""
    side = arrays.select(F.col("id").alias(end), F.col("s").alias(f"s_{end}"))
    hot = pairs.groupBy(end).count().where(F.col("count") > HOT_PAIRS).select(end, F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("places"))
    if hot.isEmpty():
        return pairs.join(side, end)
    hot = materialise(hot, "ngram-hot")
    other = "b" if end == "a" else "a"
    places = F.coalesce("places", F.lit(1))
    dealt = pairs.join(hot, end, "left").withColumn("place", F.pmod(F.xxhash64(other), places).cast("int")).drop("places")
    copied = side.join(hot, end, "left").withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("places")
    return dealt.join(copied, [end, "place"]).drop("place")


def asked_for(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the texts those whose row is wanted, and some others: by a bitmap of bounded size over hashes of the rows."""
    spread = lambda df: df.withColumn("bit", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(WANTED_BITS))).withColumn("part", F.shiftright("bit", 15)).withColumn("bit", F.col("bit").bitwiseAND(32767))
    bits = spread(wanted.select("row")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(shiftright(bit, 3) as int) + 1, 1)")), 16, 10).cast("int")
    has = F.expr("cast(bit & 7 as int)")
    found = spread(texts).join(F.broadcast(bits), "part").where(F.call_function("bit_get", byte, has) == 1)
    return found.drop("part", "bit", "bits")


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, id_bits: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are linked, by exact intersection of their shingles."""
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    rows = sets.join(nodes, "id", "left_semi").groupBy("id", "d1", "d2").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("row"))
    wanted = materialise(rows, "ngram-wanted")
    # a repeated doc_id may bring other texts, which their sets' names tell apart, or the same text again
    texts = asked_for(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("row"), F.col("text").cast("binary").alias("text")), wanted).join(wanted, "row")
    arrays = materialise(map_rows(texts, ["id", "d1", "d2", "text"], "id long, s binary", _own, id_bits=id_bits), "ngram-arrays")
    if arrays.count() > wanted.count():
        arrays = materialise(arrays.dropDuplicates(["id"]), "ngram-arrays")
    both = meet(meet(pairs, arrays, "b"), arrays, "a")
    return materialise(map_rows(both, ["a", "b", "s_a", "s_b"], "a long, b long", _verify), "ngram-links")


def _named(sets: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets and tiles with ids in place of d1, and one row (id, n, bits) for each id. An id is d1; where several
    sets share that, their ids are other hashes, and whatever named d1 names all of them."""
    first = F.struct(F.col("n_shingles").alias("n"), "bits")
    signs = materialise(sets.groupBy(F.col("d1").alias("id")).agg(F.min(first).alias("s"), F.min("d2").alias("low"), F.max("d2").alias("high")), "ngram-signs")
    shared = signs.where("low <> high").select(F.col("id").alias("d1"))
    if shared.isEmpty():
        return sets.withColumn("id", F.col("d1")), tiles, signs.select("id", "s.n", "s.bits")
    # as many as there are clashes of 64 bits
    names = materialise(sets.join(F.broadcast(shared), "d1", "left_semi").select("d1", "d2", F.xxhash64("d1", "d2", F.lit(1)).alias("id")).distinct(), "ngram-names")
    sets = materialise(sets.join(F.broadcast(names), ["d1", "d2"], "left").withColumn("id", F.coalesce("id", "d1")), "ngram-sets")
    signs = sets.groupBy("id").agg(F.min(first).alias("s"))
    for end in ("a", "b"):
        tiles = tiles.join(F.broadcast(names.select(F.col("d1").alias(end), F.col("id").alias("other"))), end, "left").withColumn(end, F.coalesce("other", end)).drop("other")
    x, y = names.select("d1", F.col("id").alias("a")), names.select("d1", F.col("id").alias("b"))
    tiles = tiles.select("a", "b", "tile").union(x.join(y, "d1").where("a < b").select("a", "b", F.lit(None).cast("long")))
    return sets, materialise(tiles, "ngram-tiles"), materialise(signs.select("id", "s.n", "s.bits"), "ngram-signs")


def links(docs: DataFrame, id_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (doc_id, key, n_shingles, id, d1, d2, bits), and links (a, b) between different sets' ids
    that connect exactly what all links connect."""
    spark = docs.sparkSession
    # a word of about six letters and a space is a shingle, and three shingles are a tile key
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-size // 18 // BUCKET_ENTRIES))
    both = materialise(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_sets(buckets, id_bits), SETS), "ngram-sets")
    sets = both.where("bucket is null").select("doc_id", "key", "n_shingles", "d1", "d2", "bits")
    packed = both.where("bucket is not null").select("bucket", "tiles", "nodes", "times")
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = materialise(packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_tiles, "a long, b long, tile long"), "ngram-tiles")
    sets, tiles, signs = _named(sets, tiles)
    side = lambda x: signs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = tiles.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    pairs = materialise(map_rows(pairs, ["a", "b", "na", "nb", "bits_a", "bits_b"], "a long, b long", _possible), "ngram-pairs")
    judged, found = pairs, verify(pairs, docs, sets, id_bits)
    members = materialise(tiles.where("b is null").select("tile", F.col("a").alias("id")).distinct(), "ngram-members")
    most, near, comp = NEAREST, True, connected_components(found)
    while not members.isEmpty():
        open_ = open_tiles(members, comp)
        large = open_.where(F.col("k") > BLOCK).select("tile").distinct()
        near = near and not large.isEmpty()  # at first, large tiles are compared within their blocks alone
        got = materialise(_across(open_, signs, most, near), "ngram-more")
        tried = materialise(got.where("tile is null").select("a", "b").distinct(), "ngram-tried")
        more = materialise(tried.join(judged, ["a", "b"], "left_anti"), "ngram-more")
        if not more.isEmpty():
            judged, new = judged.union(more), verify(more, docs, sets, id_bits)
            if not new.isEmpty():
                found = found.union(new)
                comp = connected_components(found)
        left = got.where("tile is not null").select("tile")
        members = materialise(members.join((left.union(large) if near else left).distinct(), "tile", "left_semi"), "ngram-members")
        most, near = most if near else most * MORE, False
    return sets, comp


def open_tiles(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(tile, id, c, k) of the tiles with members in different components c, k being the count of members."""
    placed = materialise(members.join(comp, "id", "left").select("tile", "id", F.coalesce("component_id", "id").alias("c")), "ngram-placed")
    split = placed.groupBy("tile").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).where("low <> high")
    return materialise(placed.join(split.select("tile", "k"), "tile"), "ngram-open")


def _across(members: DataFrame, signs: DataFrame, most: int, near: bool) -> DataFrame:
    """Possible pairs (a, b) of open tiles' members in different components, and the tiles that have more of them.
    A large tile is the upper half of a grid of blocks, or its diagonal alone; small tiles are compared many at a time."""
    together = max(1, -(-members.count() // ROWS))
    row = members.join(signs, "id").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    deal = F.expr("explode(transform(sequence(0, blocks - 1), o -> struct(int(own > o) as side, least(own, o) as x, greatest(own, o) as y)))")
    if near:
        deal = F.struct(F.lit(0).alias("side"), F.col("own").alias("x"), F.col("own").alias("y"))
    dealt = row.withColumn("d", deal).select("tile", "id", "n", "c", "bits", "d.side", "d.x", "d.y", F.when(F.col("blocks") > 1, F.col("tile")).otherwise(F.pmod(F.xxhash64("tile"), F.lit(together))).alias("dealt"))
    return dealt.groupBy("dealt", "x", "y").applyInArrow(_block(most), "a long, b long, tile long")


def components(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """The sets of all rows (doc_id, a hash of the text as key, n_shingles) and their component's set c."""
    sets, comp = links(docs, id_bits)
    comp = comp.select("id", F.col("component_id").alias("c"))
    return materialise(sets.join(comp, "id", "left").select("doc_id", "key", "n_shingles", F.coalesce("c", "id").alias("c")), "ngram-placed")


def join(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    placed = components(docs, id_bits)
    full, empty = placed.where("n_shingles > 0"), placed.where("n_shingles = 0")
    least = full.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = full.join(least, "c").select("doc_id", "n_shingles", "component_id")
    return named.union(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (null ids last), with all its columns, whatever
    their names. Rows without shingles all stay."""
    names = docs.columns
    mark, won_id, won_key = unused(names, "key", "won_id", "won_key")
    placed = components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    won = placed.where("n_shingles > 0").groupBy("c").agg(first.alias("w")).select(F.col("w.doc_id").alias(won_id), F.col("w.key").alias(won_key))
    alone = placed.where("n_shingles = 0").select(F.col("doc_id").alias(won_id), F.col("key").alias(won_key))
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(won_id)) & (F.col(mark) == F.col(won_key))
    kept = keyed.join(won, same, "left_semi")
    if placed.where("n_shingles > 0").groupBy("doc_id", "key").count().where("count > 1").isEmpty() is False:
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.union(keyed.join(alone.distinct(), same, "left_semi")).drop(mark)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w),
     n AS MATERIALIZED (SELECT doc_id, len(s) AS n, s FROM s),
     e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM n),
     f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
     r AS (SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS pos FROM e JOIN f USING (g)),
     p AS (SELECT doc_id, n, g FROM r WHERE pos <= n - (80 * n + 99) // 100 + 1),
     c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
     i AS (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
     l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * i >= 80 * (na + nb - i)),
     b AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
     walk(a, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT walk.a, b.b FROM walk JOIN b ON b.a = walk.z),
     reach AS (SELECT a, min(z) AS component_id FROM walk GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, reach.component_id FROM n JOIN reach ON reach.a = n.doc_id
"""
