"""Best-fit packing (operator 2): patterns of few document lengths, fitted by non-negative least squares.

Documents longer than a sequence are cut into whole sequences and a shorter first piece. The histogram of the other pieces'
lengths is fitted by a non-negative combination of patterns: all ways to fill a sequence exactly with two or three lengths.
The repeat counts are rounded, never using more pieces than there are, and what remains is packed by best fit: the longest
piece left opens a sequence and the longest that still fits follows, as often as the counts allow.

Scale: only the histogram, a row for each length, comes to the driver, and only the plan, bounded by the sequence length and
not by the data, goes back. A task numbers its own pieces of each length while it reads them; pieces find their place from
(task, length) totals, so no length, however common, is gathered in one task. Whole sequences need no place.

Defined results: a null text counts as empty and has just the end id; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored. Within a sequence pieces lie without gaps from offset 0; sequence numbers of whole
sequences are negative.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.byte_tokens import shared_encoder
from ledgerlake.llm.common import giving_back, pick, saved, table

END_ID = 2
LENGTH = 1024
LEAST_REMAINDERS = (0.0, 0.03, 0.08, 0.15, 0.25, 0.5)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def cut(docs: DataFrame, size: int = LENGTH, file: str | None = None) -> DataFrame:
    """The pieces of all documents. part and place: the task, and the piece's number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seen = shared_encoder(file), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                raw += end
                for k, (start, n) in enumerate(pieces_of(len(raw) // 4, size)):
                    rows.append((doc, k, start, n, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + n)]), part, int(seen[n])))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(giving_back(run), PIECES)


def patterns(size: int) -> np.ndarray:
    """Every way to fill a sequence with two or three lengths, ascending in a row; 0 stands for none."""
    rows = []
    for a in range(0, size // 3 + 1):
        b = np.arange(max(a, 1), (size - a) // 2 + 1)
        rows.append(np.stack([np.full(len(b), a), b, size - a - b], axis=1))
    return np.concatenate(rows).astype(np.int64)


def fit(histogram: np.ndarray, ways: np.ndarray, steps: int = 1500, tolerance: float = 1e-7) -> np.ndarray:
    """Non-negative repeat counts of the patterns that come closest to the histogram, by accelerated projected gradients."""
    size = len(histogram) - 1
    total = max(1.0, float(histogram.sum()))
    weight = np.sqrt((np.arange(size + 1) + size / 8) / size)  # a long piece left over costs more than a short one
    weight[0] = 0.0
    goal = weight * histogram / total

    def made(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(ways[:, k], weights=x, minlength=size + 1) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * r)[ways].sum(axis=1)

    v = np.ones(len(ways))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(made(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(ways))
    t, was = 1.0, np.inf
    for k in range(steps):
        new = np.maximum(0.0, y - step * back(made(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
        if k % 50 == 49:
            now = float(np.linalg.norm(made(x) - goal))
            if was - now < tolerance * max(now, 1e-12):
                break
            was = now
    return x * total


def rounded(x: np.ndarray, ways: np.ndarray, histogram: np.ndarray, least: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats of the fitted patterns, and the pieces left: whole parts first, then one more by the largest remainders, from `least` on, until the fit's total is reached. Never beyond the pieces there are."""
    left = histogram.copy()
    whole = np.floor(x + 1e-9).astype(np.int64)
    rest = x - whole
    owed = int(round(float(x.sum()))) - int(whole.sum())
    used: dict[int, int] = {}

    def take(k: int, most: int) -> int:
        own = [int(v) for v in ways[k] if v]
        n = min(most, *(int(left[v]) // own.count(v) for v in own))
        for v in own:
            left[v] -= n
        used[k] = used.get(k, 0) + n
        return n

    for k in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)].tolist():
        take(k, int(whole[k]))
    for k in np.argsort(-rest, kind="stable").tolist():
        if owed <= 0 or rest[k] < least:
            break
        owed -= take(k, 1)
    return [(tuple(int(v) for v in ways[k][::-1] if v), n) for k, n in used.items() if n], left


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for the pieces left: always the longest piece that still fits."""
    size = len(left) - 1
    left = left.copy()
    out = []
    while left.any():
        own, free = [], size
        while free > 0:
            fitting = np.flatnonzero(left[: free + 1] > np.bincount(own, minlength=size + 1)[: free + 1])
            if not len(fitting):
                break
            own.append(int(fitting[-1]))
            free -= own[-1]
        n = min(int(left[v]) // own.count(v) for v in set(own))
        for v in own:
            left[v] -= n
        out.append((tuple(own), n))
    return out


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) for all pieces shorter than a sequence. histogram[n]: the pieces of length n.

    Small remainders use up pieces that best fit needs, so several least remainders are tried: the fewest sequences win, then
    the most of them from patterns.
    """
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = left[size] = 0
    if not left.any():
        return []
    ways = patterns(size)
    x = fit(left.astype(float), ways)
    tried = []
    for least in LEAST_REMAINDERS:
        own, rest = rounded(x, ways, left, least)
        tried.append((own, best_fit(rest)))
    own, others = min(tried, key=lambda t: (sum(n for part in t for _, n in part), -sum(n for _, n in t[0])))
    return own + others


def slots(sequences: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first piece of each run of places, its sequence minus that piece's number, its offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(size + 1, dtype=np.int64)
    base = 0
    for own, n in sequences:
        offset = 0
        for v in own:
            runs.setdefault(v, []).append((int(used[v]), base - int(used[v]), offset))
            used[v] += n
            offset += v
        base += n
    return {v: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for v, r in runs.items()}


def pack(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """pieces (as cut() gives them, written) with sequence_id and offset."""
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < size)
    sums = saved(short.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row for each length
        histogram[r.length] = r.n
    held = spark.sparkContext.broadcast(slots(plan(histogram), size))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = held.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                starts, shift, offsets = by[int(v)]
                k = np.searchsorted(starts, number[at], side="right") - 1
                sequence[at], offset[at] = number[at] + shift[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = short.join(first, ["part", "length"]).select(*columns, (F.col("first") + F.col("place")).alias("number"))
    placed = placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    whole = pieces.where(F.col("length") == size).select(*columns, (F.lit(-1) - F.shiftleft(F.col("part").cast("long"), 40) - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def packed(docs: DataFrame, size: int = LENGTH, file: str | None = None) -> DataFrame:
    return pack(saved(cut(docs, size, file), "pieces"), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
