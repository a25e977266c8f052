"""Approximate nearest neighbours (operator 7): a learned partition of the vector space.

On a bounded sample, the graph of each vector's nearest neighbours is cut into balanced parts: halves along principal directions
first, then vertices move to the part of most of their neighbours as long as the parts stay balanced. A small network learns,
for a vector, the parts of its neighbours. Every vector is indexed under its most probable part; a query is routed to the
most probable parts, as many as vectors that the network hasn't seen need to find `aim` of their true neighbours, and reranks
their vectors by exact cosine.

Bounds: the fit uses at most `sample` vectors, taken in the order of a hash, a fifth of them not for learning; there are at most
`max_parts` parts, and PART_SAMPLE vectors of the sample for each at least. Everything
else covers all vectors. A part's vectors and queries meet in blocks of at most `block` rows each, so a part of any size
(equal vectors all fall into one) is searched by many tasks in bounded memory.

A cosine needs vectors of one length. The index is fitted for the usual length (the most frequent one, ties to the smaller);
vectors of every other length form a part of their own for each length, searched whole.

Defined results: vectors that are null or zero, or hold null or non-finite components take no part; neither do rows without
id. Rows with equal ids are rows of their own: each is a candidate for the others, and each of them that is a query gets its
own ranks. Fewer candidates of a query's length than k give fewer rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import map_arrow, pick, saved, table

SAMPLE = 8192
PART_SAMPLE = 60
MAX_PARTS = 256
BLOCK = 1024
AIM = 0.95
NEIGHBOURS = 10


@dataclass(frozen=True)
class Index:
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    probes: int
    length: int = 0  #: of the vectors that the network takes

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the parts, up to a constant, for rows of unit vectors."""
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k + 1 < len(self.layers):
                x = np.maximum(x, 0)
        return x


def valid_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row long (any number of its own), vec_id long, v array<double>: every usable vector. Written, so that a row keeps its number."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = pick(rows, key, vector).select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -np.inf
        out[low : low + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, passes: int = 12) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the neighbour graph. parts: a power of two."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            c = x[g] - x[g].mean(0)
            _, vectors = np.linalg.eigh(c.T @ c)
            order = g[np.argsort(c @ vectors[:, -1], kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    part = np.empty(len(x), dtype=np.int64)
    for k, g in enumerate(groups):
        part[g] = k
    most, least = int(slack * len(x) / parts) + 1, int(len(x) / parts / slack)
    size = np.bincount(part, minlength=parts)
    source, target = np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
    for _ in range(passes):
        edges = np.zeros((len(x), parts))
        np.add.at(edges, (source, part[target]), 1)
        np.add.at(edges, (target, part[source]), 1)
        best = edges.argmax(1)
        gain = edges[np.arange(len(x)), best] - edges[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < most and size[part[v]] > least:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 25, batch: int = 256, rate: float = 2e-3) -> tuple:
    """A network of one hidden layer for soft labels, by Adam."""
    draw = np.random.default_rng(7)
    sizes = [x.shape[1], hidden, goal.shape[1]]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for low in range(0, len(x), batch):
            at = order[low : low + batch]
            h = np.maximum(x[at] @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - goal[at]) / len(at)
            dh = (dz @ params[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return (params[0], params[1]), (params[2], params[3])


def parts_of(n: int, sample: int = SAMPLE, max_parts: int = MAX_PARTS) -> int:
    """How many parts n vectors get: a power of two, with PART_SAMPLE vectors of the sample for each at least."""
    parts = 1
    while parts * 2 <= max_parts and parts * 2 * PART_SAMPLE <= min(n, sample):
        parts *= 2
    return parts


def fit(vectors: DataFrame, *, sample: int = SAMPLE, max_parts: int = MAX_PARTS, aim: float = AIM) -> Index:
    """The network learns from four fifths of the sample; the other fifth, which it hasn't seen, says how many parts a query must probe for `aim` of its neighbours."""
    usual = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    length = usual.n if usual else 0
    rows = vectors.where(F.size("v") == length).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(sample).select("v").toArrow()
    parts = parts_of(rows.num_rows, sample, max_parts)
    if parts == 1:
        return Index((), 1, length)
    x = unit(matrix(rows.column("v")))
    unseen = np.arange(len(x)) % 5 == 0
    seen = x[~unseen]
    near = nearest(seen, NEIGHBOURS)
    part = balanced_parts(seen, near, parts)
    goal = np.zeros((len(seen), parts))
    np.add.at(goal, (np.repeat(np.arange(len(seen)), NEIGHBOURS), part[near].reshape(-1)), 1 / NEIGHBOURS)
    layers = train(seen, goal)
    scores = Index(layers, 1).scores(x)
    own, order = scores.argmax(1), np.argsort(-scores, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    found = np.take_along_axis(rank, own[nearest(x, 5)], axis=1)[unseen]
    return Index(layers, next(m for m in range(1, parts + 1) if (found < m).mean() >= aim), length)


def routed(vectors: DataFrame, index: Index, probes: int) -> DataFrame:
    """vectors with a row for each of their `probes` most probable parts. The part of another length than the index's is that length, negated."""
    held = vectors.sparkSession.sparkContext.broadcast(index)  # of a fixed size

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            v, index = batch.column("v"), held.value
            lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int32)
            usual = np.flatnonzero((lengths == index.length) & bool(index.layers))
            times = np.ones(len(lengths), dtype=np.int64)
            part = np.where(lengths == index.length, 0, -lengths)
            top = np.zeros((0, 1), dtype=np.int32)
            if len(usual):
                s = index.scores(unit(matrix(v.take(pa.array(usual)))))
                top = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                times[usual] = top.shape[1]
            at = np.repeat(np.arange(len(lengths)), times)
            part = part[at]
            part[np.isin(at, usual)] = top.reshape(-1)
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

        return f

    row = F.col("row" if "row" in vectors.columns else "vec_id").alias("row")
    return map_arrow(vectors.select(row, "vec_id", "v"), "row long, vec_id long, v array<double>, part int", make)


def best_of(q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vector ids, cosines) of each query's k nearest rows of v but itself, ties to the smaller id. rows: those of v, their ids if not given."""
    rows = ids if rows is None else rows
    uq, uv = unit(q), unit(v)
    q, v = (x / np.exp2(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] - 1) for x in (q, v))  # powers of two: exact, and no square overflows
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    out: tuple[list, list, list] = ([], [], [])
    for low in range(0, len(q), 256):
        s = uq[low : low + 256] @ uv.T
        s[q_rows[low : low + 256, None] == rows[None, :]] = -np.inf
        take = min(k, s.shape[1])
        least = np.partition(s, -take, axis=1)[:, -take]
        for i in range(len(s)):
            at = np.flatnonzero((s[i] >= least[i] - 1e-9) & (s[i] > -np.inf))
            a = low + i
            exact = (v[at] * q[a]).sum(axis=1) / (vn[at] * qn[a])
            top = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(top), q_rows[a]))
            out[1].append(ids[at][top])
            out[2].append(exact[top])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def search(queries: DataFrame, vectors: DataFrame, index: Index, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. queries and vectors: row, vec_id, v; a query's row is the one among the vectors that is left out. Without row, ids must differ and stand for it."""
    stored = saved(routed(vectors, index, 1), "parts")
    asked = saved(routed(queries, index, index.probes), "routes")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        return n

    def own(count: str) -> Column:  # by row: rows with equal ids go to different blocks
        return F.pmod(F.xxhash64("row"), count).cast("int")

    grid = blocks(stored, "vs").join(blocks(asked, "qs"), "part")
    left = asked.join(grid, "part").select("row", "vec_id", "v", "part", own("qs").alias("qb"), F.explode(F.expr("sequence(0, vs - 1)")).alias("vb"))
    right = stored.join(grid, "part").select("row", "vec_id", "v", "part", F.explode(F.expr("sequence(0, qs - 1)")).alias("qb"), own("vs").alias("vb"))
    found = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return found.empty_table()
        q_rows, q_ids = (a.column(c).to_numpy() for c in ("row", "vec_id"))
        rows, ids, scores = best_of(q_rows, matrix(a.column("v")), b.column("vec_id").to_numpy(), matrix(b.column("v")), k, b.column("row").to_numpy())
        order = np.argsort(q_rows)
        asked_ids = q_ids[order[np.searchsorted(q_rows, rows, sorter=order)]] if len(rows) else np.zeros(0)
        return pa.table([pa.array(c, t) for c, t in zip((rows, asked_ids, ids, scores), found.types, strict=True)], schema=found)

    keys = ["part", "qb", "vb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors.where("vec_id % 50 = 0"), vectors, fit(vectors))
