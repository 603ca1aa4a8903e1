"""Embedding operators: near-duplicates by an inverted multi-index, neighbours by pruned graphs.

Near-duplicates
    Unit vectors are cut in halves, and a codebook is trained for each half on a bounded sample. The product
    of the codebooks is a grid of cells; every vector is stored in the cell of its nearest codewords. A query
    visits cells in order of their distance (multi-sequence traversal), a half-vector's distance to a
    codeword's region being at least that to the plane between the region and its own. It stops at the
    distance that target recall asks for: measured on sampled vectors with partners at the linking cosine, and
    on the sample's own links, with a margin, and never beyond the linking distance, at which nothing can be
    missed. Vectors that meet in a cell are verified by cosine in double precision.

Neighbours
    Rows are dealt to shards: those nearest to one of a few centroids, which are trained on a bounded sample, and
    of these, beyond a shard's size, by a hash. In each shard, a directed graph is grown: greedy searches propose
    neighbours, and robust pruning drops those that a kept, nearer neighbour makes needless, with a relaxed
    factor that leaves some long edges. Beam search answers a query in the shards of its own centroid first; then
    in each other shard that the distance of its last candidate leaves possible. What is nearer to another centroid
    is at least as far as the plane between them, and what lies within a radius at least as far as the rest of the way
    to the centroid; so no shard that could hold a nearer row is left out. The candidates are ranked by exact distance.

Equal vectors are one point in both: its rows are counted, or expanded, at the end.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing
and take no part in searches; a null label links with nothing; vectors of different lengths do not meet;
repeated rows count as further vectors; in searches, a repeated vec_id asks with its smallest vector (by its components in order), and
none of its vectors is a neighbour of another, and as a neighbour it counts once, at its nearest vector; ties go to the smaller vec_id; an empty table gives an empty one;
columns beyond vec_id, embedding and label are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import map_rows, table
from webloom.operators.components import connected_components
from webloom.operators.storage import materialise

COSINE = 0.98
#: Vectors that a codebook is trained on, its size at most, and the vectors of a label that a cell should hold.
SAMPLE = 20_000
CODEWORDS = 1_024
CELL_ROWS = 500
#: Share of pairs at the linking cosine that a query's cells must hold, seen from one side.
TARGET_RECALL = 0.9999
#: Stored vectors and queries of one verification task.
TILE = 2_000
#: Rows of a shard: so many at least, then a share of all rows, as each query may ask each shard, up to what memory holds.
SHARD, SHARD_SHARE, SHARD_MOST = 4_000, 64, 50_000
CENTROIDS = 4_000
DEGREE, BEAM, ALPHA = 24, 64, 1.2
#: Beam of the queries in a shard of SHARD rows; it grows with the square root of the shard.
QUERY_BEAM = 144
#: Nodes that a search opens at once, and searches that go on side by side.
STEP, ABREAST = 8, 64
NEIGHBOURS = 10
QUERY_BLOCK = 20_000


def usable(vector: str = "embedding"):
    """Whether a vector can be compared: all components finite, not all zero."""
    return F.expr(
        f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; by the largest component first, so that nothing over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codewords of a sample, by Lloyd's iterations from random rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each half-vector, and lower bounds of its squared distances to all codewords' regions."""
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    own = d.argmin(1)
    sq = (c * c).sum(1)
    gap = np.sqrt(np.maximum(sq[own][:, None] - 2 * (c @ c.T)[own] + sq, 0))
    plane = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * gap, 1e-300)
    plane[gap < 1e-9] = 0
    return own, np.maximum(plane - 1e-7, 0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, radius2: float) -> Iterator[tuple[int, int]]:
    """Cells in order of a[i] + b[j], up to radius2: the multi-sequence algorithm over two sorted lists."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    heap, seen = [(float(sa[0] + sb[0]), 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > radius2:
            return
        yield int(oa[i]), int(ob[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(sa) and q < len(sb) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(sa[p] + sb[q]), p, q))


CELL = "label int, cell long, query boolean, id long, n long, v binary"


def stop_at(x: np.ndarray, labels: np.ndarray, book: tuple[np.ndarray, np.ndarray], cosine: float, target: float, seed: int = 9) -> float:
    """Squared cell distance at which traversal stops, from unit vectors of the sample."""
    rng = np.random.default_rng(seed)
    h = x.shape[1] // 2
    need = []

    def needed(a, b):
        far = margins(a[:, :h], book[0])[1], margins(a[:, h:], book[1])[1]
        home = margins(b[:, :h], book[0])[0], margins(b[:, h:], book[1])[0]
        at = np.arange(len(a))
        return far[0][at, home[0]] + far[1][at, home[1]]

    x, labels = x[:2_000], labels[:2_000]
    for _ in range(8):
        side = rng.normal(size=x.shape)
        side = unit(side - (side * x).sum(axis=1, keepdims=True) * x + 1e-12)
        need.append(needed(x, cosine * x + np.sqrt(1 - cosine * cosine) * side))
    i, j = np.nonzero(np.triu((x @ x.T >= cosine) & (labels[:, None] == labels[None]), 1))
    if len(i):
        need.append(needed(x[i], x[j]))
    return float(min(2 - 2 * cosine, 2.0 * np.quantile(np.concatenate(need), target, method="higher") + 1e-9))


def _cells(books: dict):
    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 1_000):
                t = whole.slice(s, 1_000)
                out = {k: [] for k in ("label", "cell", "query", "id", "n", "v")}
                data = t.column("embedding").to_pylist()
                sizes = np.array([len(v) for v in data])
                ids, ns, labels = (t.column(c).to_numpy() for c in ("id", "n", "label"))
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    raw = np.array([data[i] for i in rows], np.float32)
                    h = dim // 2
                    ca, cb, radius2 = books.get(dim) or (np.zeros((1, h)), np.zeros((1, dim - h)), 0.0)
                    x = unit(raw)
                    (own_a, ma), (own_b, mb) = margins(x[:, :h], ca), margins(x[:, h:], cb)
                    for i, r in enumerate(rows.tolist()):
                        v, home = raw[i].tobytes(), (int(own_a[i]), int(own_b[i]))
                        for cell in traverse(ma[i], mb[i], radius2):
                            for query in (False, True) if cell == home else (True,):
                                for k, value in zip(out, (labels[r], (dim << 40) | (cell[0] << 20) | cell[1], query, ids[r], ns[r], v), strict=True):
                                    out[k].append(value)
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, ty) for (k, v), ty in zip(out.items(), kinds, strict=True)})

    return run


def _verify(cosine: float):
    def group(keys: tuple, t: pa.Table) -> pa.Table:
        """One tile of a cell: links between its stored vectors and its queries. Gives each query's count of
        linked rows (b null), and edges that connect what the links connect."""
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        query = t["query"].to_numpy()
        ids, weight = t["id"].to_numpy(), t["n"].to_numpy()
        x = unit(np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(len(ids), -1))
        s, q = np.flatnonzero(~query), np.flatnonzero(query)
        if not len(s) or not len(q):
            return empty
        a, b, n = [], [], []
        parent = np.arange(len(s))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(q), 500):
            part = q[at : at + 500]
            near = x[part] @ x[s].T >= cosine
            near &= ids[part][:, None] != ids[s][None]
            total = near @ weight[s]
            for i in np.flatnonzero(total):
                me = int(ids[part[i]])
                a.append(me)
                b.append(None)
                n.append(int(total[i]))
                # one edge for each set of stored vectors that is not yet known to be connected
                hits = np.flatnonzero(near[i])
                roots = {}
                for h in hits.tolist():
                    roots.setdefault(find(h), h)
                first = None
                for r, h in roots.items():
                    a.append(me)
                    b.append(int(ids[s[h]]))
                    n.append(0)
                    if first is None:
                        first = r
                    else:
                        parent[r] = first
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return group


def points(rows: DataFrame) -> DataFrame:
    """One row per label and distinct vector: smallest vec_id as id, and the count n of its rows."""
    return rows.where(usable() & F.col("label").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))


def codebooks(pts: DataFrame, cosine: float = COSINE, target: float = TARGET_RECALL) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each vector length the halves' codebooks and the squared distance at which traversal stops, from at
    most SAMPLE points, the first by a hash. The grid grows with the largest label, so that cells don't."""
    largest = {r["dim"]: r["n"] for r in pts.groupBy(F.size("embedding").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    got = pts.select("id", "label", "embedding").orderBy(F.xxhash64("id", F.lit(11))).limit(SAMPLE).toPandas()
    out = {}
    for dim, rows in got.groupby(got["embedding"].map(len)):
        if dim < 2:
            continue
        x, h = unit(np.stack(rows["embedding"].to_numpy())), int(dim) // 2
        k = int(min(CODEWORDS, max(1, round((largest[dim] / CELL_ROWS) ** 0.5))))
        book = kmeans(x[:, :h], k), kmeans(x[:, h:], k)
        out[int(dim)] = (*book, stop_at(x, rows["label"].to_numpy(), book, cosine, target))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. Rows that repeat a vec_id are further vectors;
    a null vec_id takes part, but names no component beside others."""
    # ids of points must not depend on vec_id being there
    pts = materialise(points(vectors.select("vec_id", "label", "embedding")).withColumn("least", F.col("id")).withColumn("id", F.xxhash64("label", F.hex(F.to_json("embedding")))), "mi-points")
    books = codebooks(pts, cosine)
    cells = materialise(pts.select("label", "id", "n", "embedding").mapInArrow(_cells(books), CELL), "mi-cells")
    sizes = cells.groupBy("label", "cell").agg(F.count(F.when(~F.col("query"), 1)).alias("s"), F.count(F.when(F.col("query"), 1)).alias("q")).where("s > 0 and q > 1")
    tiles = sizes.select("label", "cell", F.ceil(F.col("s") / TILE).alias("ts"), F.ceil(F.col("q") / TILE).alias("tq"))
    placed = cells.join(tiles, ["label", "cell"])
    # a large cell is a grid of tiles: stored vectors have a row of it, queries a column
    own = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("tq")).otherwise(F.col("ts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("ts")).otherwise(F.col("tq")) - 1))
    dealt = placed.withColumn("own", own).withColumn("other", other).select(
        "label", "cell", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("row"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("column"), "query", "id", "n", "v"
    )
    found = materialise(dealt.groupBy("label", "cell", "row", "column").applyInArrow(_verify(cosine), "a long, b long, n long"), "mi-links")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    named = pts.join(links, "id", "left").join(comp, "id", "left").select("label", "embedding", "least", "n", "links", F.coalesce("component_id", "id").alias("c"))
    named = materialise(named, "mi-named")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    per = named.join(least, "c").select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", "label", "embedding", usable().alias("_ok"))
    out = rows.join(per, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")) & F.col("_ok"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL3 = """
WITH RECURSIVE v AS MATERIALIZED (
       SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     u AS MATERIALIZED (
       SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
     l AS MATERIALIZED (
       SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
       WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
     walk(a, z) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.a, l.b FROM walk JOIN l ON l.a = walk.z),
     c AS (SELECT a, min(z) AS component_id FROM walk GROUP BY a),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of each query to its row of ids; -1 gives infinity."""
    d = x[ids] - q[:, None, :]
    out = np.einsum("bcd,bcd->bc", d, d)
    out[ids < 0] = np.inf
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest nodes that a search from the entries finds for each query: ids and squared distances,
    nearest first (-1 and infinity: no more). Each round opens the STEP nearest nodes of every beam that are still closed."""
    got = [_beams(x, graph, np.unique(entry)[:beam], q[s : s + ABREAST], beam) for s in range(0, len(q), ABREAST)]
    return np.concatenate([i for i, _ in got]), np.concatenate([d for _, d in got])


def _beams(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, none = len(q), len(x)
    ids, d = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, x.dtype)
    ids[:, : len(start)] = start
    d[:, : len(start)] = distances(x, q, ids[:, : len(start)])
    closed = d.copy()  # distances of nodes that are not yet opened
    seen = np.zeros((n, none + 1), bool)
    seen[:, none] = True
    seen[:, start] = True
    active, step = np.arange(n), min(STEP, beam)
    while True:
        c = closed[active]
        pick = np.argpartition(c, step - 1, axis=1)[:, :step]
        ok = np.isfinite(np.take_along_axis(c, pick, 1))
        more = ok.any(axis=1)
        active, pick, ok = active[more], pick[more], ok[more]
        if not len(active):
            break
        a = active[:, None]
        near = np.where(ok[:, :, None], graph[np.where(ok, ids[a, pick], 0)], -1).reshape(len(active), -1)
        closed[a, pick] = np.inf
        near[near < 0] = none
        row, column = np.nonzero(~seen[a, near])
        _, first = np.unique(active[row] * (none + 1) + near[row, column], return_index=True)
        new, row = near[row[first], column[first]], active[row[first]]
        seen[row, new] = True
        gap = x[new] - q[row]
        far = np.einsum("ij,ij->i", gap, gap)
        better = far < d.max(axis=1)[row]
        row, new, far = row[better], new[better], far[better]
        if not len(row):
            continue
        # rows are in order; each one's new nodes go beside its beam, and the nearest of both stay
        size = np.bincount(row, minlength=n)
        hit = np.flatnonzero(size)
        at = (np.cumsum(size > 0) - 1)[row], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        beside = np.full((len(hit), int(size.max())), -1, np.int64), np.full((len(hit), int(size.max())), np.inf, x.dtype)
        beside[0][at], beside[1][at] = new, far
        all_d = np.concatenate([d[hit], beside[1]], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[hit] = np.take_along_axis(np.concatenate([ids[hit], beside[0]], axis=1), best, 1)
        closed[hit] = np.take_along_axis(np.concatenate([closed[hit], beside[1]], axis=1), best, 1)
        d[hit] = np.take_along_axis(all_d, best, 1)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node out of its candidates (-1: none): the nearest is kept, and those that it is nearer
    to than the node is, by the relaxed factor, are dropped; and so on."""
    n = len(nodes)
    out = np.full((n, degree), -1, np.int64)
    size = max(1, 6_000_000 // max(1, candidates.shape[1] ** 2))
    for s in range(0, n, size):
        c = candidates[s : s + size].copy()
        c[c == nodes[s : s + size, None]] = -1
        v = x[c]
        d = distances(x, x[nodes[s : s + size]], c)
        sq = np.einsum("bcd,bcd->bc", v, v)
        between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
        alive = np.isfinite(d)
        rows = np.arange(len(c))
        for k in range(degree):
            best = np.where(alive, d, np.inf).argmin(axis=1)
            ok = alive[rows, best]
            if not ok.any():
                break
            out[s : s + size][ok, k] = c[rows, best][ok]
            alive &= ~(ok[:, None] & (alpha * alpha * between[rows, best] <= d))
            alive[rows, best] = False
            alive &= c != np.where(ok, c[rows, best], -2)[:, None]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours [n, degree] of all rows of x (-1: none), and the nodes from which searches start. Rows are
    inserted in random order, in batches that at most double what there is."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    medoid = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.r_[medoid, order[order != medoid]]
    entry = order[: min(n, 8)]
    first = min(n, degree + 1)
    for i in order[:first]:
        near = order[:first][order[:first] != i]
        graph[i, : len(near)] = near
    at = first
    while at < n:
        batch = order[at : at + min(at, 512)]
        found, _ = beam_search(x, graph, entry, x[batch], beam)
        graph[batch] = robust_prune(x, batch, found, degree, alpha)
        back: dict[int, list[int]] = {}
        for i, row in zip(batch.tolist(), graph[batch].tolist(), strict=True):
            for j in row:
                if j >= 0:
                    back.setdefault(j, []).append(i)
        crowded: list[tuple[int, list[int]]] = []
        for j, more in back.items():
            has = graph[j][graph[j] >= 0].tolist()
            every = list(dict.fromkeys(has + more))
            if len(every) <= degree:
                graph[j, : len(every)] = every
            else:
                crowded.append((j, every))
        crowded.sort(key=lambda c: len(c[1]))
        for s in range(0, len(crowded), 256):
            part = crowded[s : s + 256]
            width = max(len(e) for _, e in part)
            cand = np.array([e + [-1] * (width - len(e)) for _, e in part])
            nodes = np.array([j for j, _ in part])
            graph[nodes] = robust_prune(x, nodes, cand, degree, alpha)
        at += len(batch)
    return graph, entry


def _graphs(keys: tuple, t: pa.Table) -> pa.Table:
    """A shard's rows with their out-neighbours, by place in the shard; entries are marked."""
    t = t.combine_chunks().sort_by("id")
    x = np.array(t["embedding"].to_pylist(), np.float64)
    graph, entry = build_graph(scaled(x)[0])
    is_entry = np.zeros(len(x), bool)
    is_entry[entry] = True
    return pa.table(
        {"shard": t["shard"], "dim": t["dim"], "pos": pa.array(range(len(x)), pa.int32()), "id": t["id"], "least": t["least"], "v": pa.array([r.tobytes() for r in x], pa.binary()), "near": pa.array([r.tobytes() for r in graph.astype(np.int32)], pa.binary()), "entry": pa.array(is_entry)}
    )


def scaled(*arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays in single precision for the search, scaled alike so that no square over- or underflows."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=1.0)
    return [(a / most).astype(np.float32) for a in arrays]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision."""
    gap = x - q
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    odd = ~np.isfinite(d) | (d < 1e-150)  # squares that over- or underflow
    if odd.any():
        most = np.maximum(np.abs(gap[odd]).max(axis=1, keepdims=True), 5e-324)
        d[odd] = most[:, 0] * np.sqrt(((gap[odd] / most) ** 2).sum(axis=1))
    return d


def _search(wanted: int, beam: int):
    def group(keys: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        shard = shard.combine_chunks().sort_by("pos")
        n = shard.num_rows
        x = np.frombuffer(b"".join(shard["v"].to_pylist()), np.float64).reshape(n, -1)
        graph = np.frombuffer(b"".join(shard["near"].to_pylist()), np.int32).reshape(n, -1).astype(np.int64)
        entry = np.flatnonzero(shard["entry"].to_numpy())
        ids, least = shard["id"].to_numpy(), shard["least"].to_numpy()
        q = np.array(queries["embedding"].to_pylist(), np.float64)
        names = queries["query_id"].to_numpy()
        width = max(int(beam * max(1.0, n / SHARD) ** 0.5), wanted + 8)
        small, asked = scaled(x, q)
        found = beam_search(small, graph, entry, asked, width)[0]
        row, column = np.nonzero(found >= 0)
        node = found[row, column]
        score = np.concatenate([exact(x[node[s : s + 20_000]], q[row[s : s + 20_000]]) for s in range(0, len(node), 20_000)])
        order = np.lexsort((ids[node], least[node], score, row))
        row, node, score = row[order], node[order], score[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = rank < wanted
        return pa.table({"query_id": names[row[keep]], "id": ids[node[keep]], "score": score[keep]})

    return group


def centroids(pts: DataFrame, shards: dict[int, int]) -> dict[int, np.ndarray]:
    """For each vector length the centroids, as many as shards are wanted, from at most SAMPLE points, the first by a hash."""
    if all(n == 1 for n in shards.values()):
        return {}
    got = pts.select("id", "embedding").orderBy(F.xxhash64("id", F.lit(13))).limit(SAMPLE).toPandas()
    out = {}
    for dim, rows in got.groupby(got["embedding"].map(len)):
        if shards[dim] > 1:
            out[int(dim)] = kmeans(np.stack(rows["embedding"].to_numpy()).astype(np.float64), min(shards[dim], CENTROIDS))
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _assign(books: dict):
    """Own centroid of each vector and the distance to it."""

    def run(vid, embedding):
        out = {"id": vid, "cell": [0] * len(vid), "far": [0.0] * len(vid)}
        dims: dict[int, list[int]] = {}
        for i, e in enumerate(embedding):
            dims.setdefault(len(e), []).append(i)
        for dim, rows in dims.items():
            if dim in books:
                for s in range(0, len(rows), 1_000):
                    part = rows[s : s + 1_000]
                    d = _squares(np.array([embedding[i] for i in part], np.float64), books[dim])
                    own = d.argmin(axis=1)
                    for i, c, f in zip(part, own.tolist(), np.sqrt(d[np.arange(len(part)), own]).tolist(), strict=True):
                        out["cell"][i], out["far"][i] = c, f
        return out

    return run


def _others(books: dict, radius: dict):
    """Cells beside its own that may hold something nearer to a query than ``score``."""

    def run(query_id, embedding, cell, score):
        out = {"query_id": [], "cell": []}
        for name, e, own, most in zip(query_id, embedding, cell, score, strict=True):
            book = books.get(len(e))
            if book is None:
                continue
            x = np.array(e, np.float64)
            d = np.sqrt(((book - x) ** 2).sum(axis=1))
            between = np.sqrt(((book - book[own]) ** 2).sum(axis=1))
            plane = (d * d - d[own] * d[own]) / np.maximum(2 * between, 1e-300)
            least = np.maximum(plane, d - radius[len(e)])
            may = np.flatnonzero((radius[len(e)] >= 0) & ((least <= most * (1 + 1e-6) + 1e-6 * d.max()) if most is not None else True))
            found = [c for c in may.tolist() if c != own]
            out["query_id"] += [name] * len(found)
            out["cell"] += found
        return out

    return run


def neighbours(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = NEIGHBOURS, shard_rows: int | None = None, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query. Rows with a null vec_id take no part,
    and a repeated vec_id is no neighbour of itself."""
    from pyspark.sql import Window

    rows = vectors.select("vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    # of equal vectors, the k + 1 smallest ids are all that k neighbours beside a query's own row can need
    first = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    pts = first.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a vec_id may have several vectors, so points have names of their own
    pts = materialise(pts.withColumn("dim", F.size("embedding")).withColumn("id", F.xxhash64(F.hex(F.to_json("embedding")))), "ann-points")
    counts = {r["dim"]: r["count"] for r in pts.groupBy("dim").count().collect()}
    size = {d: shard_rows or min(max(SHARD, n // SHARD_SHARE), SHARD_MOST) for d, n in counts.items()}
    books = centroids(pts, {d: -(-n // size[d]) for d, n in counts.items()})
    cells = materialise(map_rows(pts, ["id", "embedding"], "id long, cell int, far double", _assign, books=books), "ann-cells")
    placed = pts.join(cells, "id").select("dim", "cell", "id", "least", "embedding", "far")
    # a row for each centroid; its rows make one shard up to twice the size
    found = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radius = {d: np.full(len(b), -1.0) for d, b in books.items()}
    for r in found:
        if r["dim"] in radius:
            radius[r["dim"]][r["cell"]] = r["far"] * (1 + 1e-9)
    spark = vectors.sparkSession
    parts = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // (2 * size[r["dim"]]))) for r in found], "dim int, cell int, parts int")
    shard = (F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard")
    graphs = placed.join(F.broadcast(parts), ["dim", "cell"]).select(shard, "dim", "id", "least", "embedding")
    graphs = materialise(graphs.groupBy("shard", "dim").applyInArrow(_graphs, "shard long, dim int, pos int, id long, least long, v binary, near binary, entry boolean"), "ann-graphs")
    # of a repeated vec_id, the smallest vector asks
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    own = map_rows(asking.withColumnRenamed("query_id", "id"), ["id", "embedding"], "id long, cell int, far double", _assign, books=books)
    asking = materialise(asking.join(own.select(F.col("id").alias("query_id"), "cell"), "query_id"), "ann-queries")

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.join(F.broadcast(parts), ["dim", "cell"]).withColumn("shard", F.explode(F.expr("transform(sequence(0, parts - 1), p -> cell * 4294967296 + p)")))
        asked = materialise(asked.select("query_id", "embedding", "dim", "shard"), "ann-asked")
        # a shard that more queries ask than one task should hold is there once for each block of them
        blocks = F.broadcast(asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")))
        asked = asked.join(blocks, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        stored = graphs.join(blocks, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        keys = ["shard", "dim", "block"]
        return materialise(stored.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_search(k + 1, beam), "query_id long, id long, score double"), "ann-found")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("r") <= k + 1)

    near = search(asking)
    if books:
        last = ranked(near).where(F.col("r") == k + 1).select("query_id", "score")
        more = map_rows(asking.join(last, "query_id", "left"), ["query_id", "embedding", "cell", "score"], "query_id long, cell int", _others, books=books, radius=radius)
        near = near.union(search(asking.drop("cell").join(more, "query_id")))
    every = ranked_points(near, pts, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ranked_points(found: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the rows of the k + 1 nearest points found, and of further ones at the same distance
    as the last; a vec_id counts once, at its nearest vector."""
    from pyspark.sql import Window

    near = found.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).where(F.col("r") <= k + 1)
    rows = near.join(pts.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
