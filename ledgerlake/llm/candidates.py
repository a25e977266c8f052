"""Building blocks of the similarity operators: comparing rows that share a key, Bloom filters, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import giving_back, saved

BLOOM_BITS = 26

#: passing(columns, y, x): which pairs of row numbers (y before x) may be similar.
Passing = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def compare_group_rows(col: dict[str, np.ndarray], key: np.ndarray, item: np.ndarray, passing: Passing, *, every: bool, touched: bool) -> tuple[np.ndarray, ...]:
    """(x, y, more) items of pairs within equal keys; rows of a key stand together, earlier ones first, and an item counts once in a key.

    every: all passing pairs. Otherwise each x with its earliest passing y, and whether it had more. touched: also (z, z) for
    each item z of a passing pair. Pairs are compared by their distance in the order, so memory stays linear in the rows.
    """
    _, group = np.unique(key, return_inverse=True)
    order = np.lexsort((np.arange(len(key)), item, group))
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = (group[order[1:]] == group[order[:-1]]) & (item[order[1:]] == item[order[:-1]])
    keep = np.flatnonzero(~again)
    col, group, item = {c: v[keep] for c, v in col.items()}, group[keep], item[keep]
    n = len(group)
    best, count, hit, pairs = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), []
    left, d = np.arange(n), 1  # rows that have a row d places on in their group
    while True:
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        y = left[passing(col, left, left + d)]
        if every:
            pairs.append((y + d, y))
        else:
            best[y + d] = y  # a larger distance is an earlier partner
            count[y + d] += 1
        if touched:
            hit[y] = hit[y + d] = True
        d += 1
    if every:
        x, y = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        more = np.zeros(len(x), dtype=bool)
    else:
        x = np.flatnonzero(best >= 0)
        y, more = best[x], count[x] > 1
    z = np.flatnonzero(hit)
    return item[np.concatenate([x, z])], item[np.concatenate([y, z])], np.concatenate([more, np.zeros(len(z), dtype=bool)])


def in_groups(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, batch_rows: int = 200_000) -> DataFrame:
    """f(table, group) for rows that share their keys, sorted by `order`: a bounded number of whole groups at a time."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return f(t, np.cumsum(change))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            change = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                v = batch.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            at = np.flatnonzero(change)
            if held + batch.num_rows > batch_rows and len(at):
                cut = int(at[-1])
                if (out := done([*parts, batch.slice(0, cut)])) is not None:
                    yield out
                parts, held = [batch.slice(cut)], batch.num_rows - cut
            else:
                parts.append(batch)
                held += batch.num_rows
        if held and (out := done(parts)) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(giving_back(run), schema)


PAIRS = "x long, y long, more boolean"


def pairs_batch(x: np.ndarray, y: np.ndarray, more: np.ndarray) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(more)], ["x", "y", "more"]) if len(x) else None


def compare(rows: DataFrame, keys: list[str], order: list[str], item: str, columns: Callable[[pa.Table], dict[str, np.ndarray]], passing: Passing, *, every: bool = False, touched: bool = False) -> DataFrame:
    """x long, y long, more boolean: rows that share their keys, compared in `order`."""

    def f(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        return pairs_batch(*compare_group_rows(columns(t), group, t.column(item).to_numpy(), passing, every=every, touched=touched))

    return in_groups(rows, keys, order, f, PAIRS)


def bloom(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of 2^BLOOM_BITS bits, two of them for each 64-bit hash; at most 2^(BLOOM_BITS - 6) rows come to the driver."""
    mask = (1 << BLOOM_BITS) - 1
    bit = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, BLOOM_BITS).bitwiseAND(mask)))
    words = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    ok = np.ones(len(h), dtype=bool)
    for bit in (h & mask, (h >> np.uint64(BLOOM_BITS)) & mask):
        ok &= (filter_[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component. edges: x, y.

    Each round every node takes the smallest label among its neighbours and then its label's label, so a component of n nodes
    needs about log n rounds; labels are written after each round.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e")).select("e.a", "e.b")
    both = saved(both.where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select("node", "label", "next").join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next")
        new = saved(jump.select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels
