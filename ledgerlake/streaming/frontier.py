"""Blocks in order from a stream that brings them early, late or not at all (T03, T05 to T08), and merged requests.

What has come but can't be released yet is held as runs: intervals of numbers without a gap whose blocks are linked by their
hashes. A micro-batch finds the runs of its own blocks in ranges of the numbers, merges them and the waiting runs by their edges,
and decides by edges alone how far a chain goes. Only edges of a chain's runs are looked at together;
its blocks never are. Blocks that wait lie in folders with bounds, and a release reads the folders that it needs. Blocks, events,
runs and heads of a batch become visible in one commit, and a batch that is tried again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlake.operators.neighbors import WIDTH
from ledgerlake.sinks.batch import first_of
from ledgerlake.sinks.store import Store

STALL_MS = 55_000
REFETCHES = 3
MOST_BUFFERED = 1000
RUNS = "chain_id long, start long, end long, parent string, hash string"
HEADS = "chain_id long, expected long, last_hash string, refetched int, moved_ms long, since long"
WAITING = "chain_id long, number long, hash string, parent_hash string, batch_id long"
ORDERED = "chain_id long, number long, hash string"
EVENTS = "chain_id long, kind string, number long, range_from long, range_to long"


def _differ(a: Column, b: Column) -> Column:
    """Whether two hashes are known and differ."""
    return F.coalesce(F.lower(a) != F.lower(b), F.lit(False))


def _islands(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Intervals (start, end, parent of the first block, hash of the last) joined, within each part, where one follows another and is linked to it."""
    w = W.partitionBy(*parts).orderBy("start")
    follows = F.coalesce(F.lag("end").over(w) + 1 == F.col("start"), F.lit(False)) & ~_differ(F.lag("hash").over(w), F.col("parent"))
    rows = rows.withColumn("_first", (~follows).cast("int"))
    rows = rows.withColumn("_island", F.sum("_first").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.groupBy(*parts, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("parent", "start").alias("parent"), F.max_by("hash", "start").alias("hash"))
    return found.select("chain_id", "start", "end", "parent", "hash")


def runs_of(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Runs of blocks (chain_id, number, hash, parent_hash) within ranges of `width` numbers."""
    rows = blocks.select("chain_id", F.floor(F.col("number") / width).alias("_range"), F.col("number").alias("start"), F.col("number").alias("end"), F.col("parent_hash").alias("parent"), "hash")
    return _islands(rows, ["chain_id", "_range"])


def merged(runs: DataFrame) -> DataFrame:
    """Runs joined by their edges; a row is a run, not a block."""
    return _islands(runs, ["chain_id"])


def outside(blocks: DataFrame, runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks whose numbers lie in none of the runs. A run goes to each range of numbers that it touches."""
    at = lambda c: F.floor(F.col(c) / width)
    rows = blocks.select("chain_id", at("number").alias("_range"), F.col("number").alias("start"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), "hash", "parent_hash")
    pieces = runs.select("chain_id", F.explode(F.sequence(at("start"), at("end"))).alias("_range"), "start", F.lit(0).alias("kind"), "end")
    w = W.partitionBy("chain_id", "_range").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.unionByName(pieces, allowMissingColumns=True).withColumn("cover", F.last("end", ignorenulls=True).over(w))
    rows = rows.where((F.col("kind") == 1) & F.coalesce(F.col("start") > F.col("cover"), F.lit(True)))
    return rows.select("chain_id", F.col("start").alias("number"), "hash", "parent_hash")


class IntervalFrontier:
    """A sink of micro-batches: chain_id, number, hash, parent_hash, range_end, at_ms.

    Rows with a number are blocks. Rows with a range_end only are markers: everything up to it holds nothing more (T07). at_ms is a
    clock (the rows of a rate source, say): once a chain hasn't moved for `stall_ms`, each batch that brings a later time asks for
    the gap again, up to `refetches` times, and then skips it (T05); a chain with nothing waiting moves on by one. More than `most`
    waiting blocks skip the gaps before them (T06); None: no limit. A block that contradicts the hash before it is a
    reorganisation: it and all that waits behind it go, and the chain expects its number again (T08).

    The store gets tables ordered (blocks in order), events (reorg, overflow, refetch, bypass), waiting, runs and heads.
    """

    def __init__(self, store: Store, *, start: int = 0, most: int | None = MOST_BUFFERED, stall_ms: int | None = None, refetches: int = REFETCHES, width: int = WIDTH):
        self.store, self.start, self.most, self.stall_ms, self.refetches, self.width = store, start, most, stall_ms, refetches, width

    def __call__(self, batch: DataFrame, batch_id: int, run: str = "") -> None:
        if batch_id <= self.store.committed(run):
            return
        work = f"{self.store.path}/_work/{uuid4().hex}"
        try:
            self._advance(batch.select("chain_id", "number", "hash", "parent_hash", "range_end", "at_ms"), batch_id, run, work)
        finally:
            self.store.drop(work)

    def _keep(self, df: DataFrame, work: str, name: str) -> DataFrame:
        """df, written to the batch's own folder and read again: plans stay flat, small sides of joins are known, and lost executors take nothing along."""
        df.write.parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    def _heads(self, rows: DataFrame) -> DataFrame:
        """Each chain's head with this batch's marker and clock; a marker moves it."""
        marks = rows.groupBy("chain_id").agg(F.max("range_end").alias("mark"), F.max("at_ms").alias("now"))
        heads = self.store.read("heads", HEADS).join(marks, "chain_id", "full")
        old = F.coalesce("expected", F.lit(self.start).cast("long"))
        jumps = F.coalesce(F.col("mark") + 1 > old, F.lit(False))
        return heads.select(
            "chain_id", F.when(jumps, F.col("mark") + 1).otherwise(old).alias("expected"), F.when(~jumps, F.col("last_hash")).alias("last_hash"),
            F.coalesce("refetched", F.lit(0)).alias("refetched"), "moved_ms", F.coalesce("since", F.lit(-1)).alias("since"), "now", jumps.alias("jumped"),
        )

    def _unstalled(self, heads: DataFrame, runs: DataFrame) -> DataFrame:
        """heads with what a chain that has stood still for too long does: refetch, or bypass (to `expected`)."""
        first = runs.groupBy("chain_id").agg(F.min("start").alias("first"), F.sum(F.col("end") - F.col("start") + 1).alias("waiting"))
        h = heads.join(first, "chain_id", "left")
        moves = F.col("jumped") | F.coalesce(F.col("first") == F.col("expected"), F.lit(False))
        if self.most is not None:
            moves = moves | (F.coalesce("waiting", F.lit(0)) > self.most)
        still = F.lit(False) if self.stall_ms is None else ~moves & F.coalesce(F.col("now") - F.col("moved_ms") >= self.stall_ms, F.lit(False))
        asks = still & F.col("first").isNotNull() & (F.col("refetched") < self.refetches)
        h = h.withColumn("stood", F.col("expected")).withColumn("asks", asks).withColumn("skips", still & ~asks).withColumn("target", F.coalesce("first", F.col("expected") + 1))
        return h.withColumn("last_hash", F.when(~F.col("skips"), F.col("last_hash"))).withColumn("expected", F.when(F.col("skips"), F.col("target")).otherwise(F.col("expected")))

    def _reached(self, runs: DataFrame, heads: DataFrame) -> DataFrame:
        """Waiting runs with how far their chain gets: done, gap_from (where a gap before a run that is done begins), and breaks on the run at which a reorganisation shows."""
        w = W.partitionBy("chain_id").orderBy("start")  # the edges of a chain's waiting runs
        r = runs.join(heads.select("chain_id", "expected", "last_hash"), "chain_id")
        r = r.withColumn("prev", F.lag("end").over(w)).withColumn("gap_from", F.coalesce(F.col("prev") + 1, F.col("expected")))
        size = F.col("end") - F.col("start") + 1
        behind = F.sum(size).over(W.partitionBy("chain_id")) - F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) + size  # a frame of all rows that follow would be summed up anew for each run
        follows = F.col("start") == F.col("gap_from")
        may_skip = F.lit(False) if self.most is None else behind > self.most
        breaks = follows & F.when(F.col("prev").isNotNull(), F.lit(True)).otherwise(_differ(F.col("last_hash"), F.col("parent")))  # linked neighbours are one run
        r = r.withColumn("follows", follows).withColumn("breaks", breaks).withColumn("stops", (breaks | ~(follows | may_skip)).cast("int"))
        stopped = F.sum("stops").over(w.rowsBetween(W.unboundedPreceding, 0))
        return r.withColumn("done", stopped == 0).withColumn("breaks", F.col("breaks") & (stopped == 1) & (F.col("stops") == 1))

    def _advance(self, rows: DataFrame, batch_id: int, run: str, work: str) -> None:
        keep = lambda df, name: self._keep(df, work, name)
        rows = keep(rows, "rows")
        heads = keep(self._heads(rows), "heads")
        edge = heads.select("chain_id", F.col("expected").alias("_from"))
        waiting = self.store.read("runs", RUNS).join(edge, "chain_id").where("end >= _from")
        cut = F.col("start") < F.col("_from")
        waiting = waiting.select("chain_id", F.greatest("start", "_from").alias("start"), "end", F.when(~cut, F.col("parent")).alias("parent"), "hash")
        blocks = first_of(rows.where("number IS NOT NULL").join(edge, "chain_id").where("number >= _from").select("chain_id", "number", "hash", "parent_hash"), ["chain_id", "number"], ["hash", "parent_hash"])
        fresh = keep(outside(blocks, waiting, self.width), "fresh")
        runs = keep(merged(runs_of(fresh, self.width).unionByName(waiting)), "runs")
        heads = self._unstalled(heads, runs)
        reached = keep(self._reached(runs, heads), "reached")
        moved = reached.groupBy("chain_id").agg(
            F.max(F.when(F.col("done"), F.col("end"))).alias("to"), F.max_by("hash", F.when(F.col("done"), F.col("start"))).alias("to_hash"), F.max(F.when(F.col("breaks"), F.col("start"))).alias("reorg"),
        )
        h = keep(heads.join(moved, "chain_id", "left"), "ends")
        went = F.col("to").isNotNull()
        progress = went | F.col("skips") | F.col("jumped")
        after = h.select(
            "chain_id", F.when(went, F.col("to") + 1).otherwise(F.col("expected")).alias("expected"),
            F.when(F.col("reorg").isNull(), F.when(went, F.col("to_hash")).otherwise(F.col("last_hash"))).alias("last_hash"),
            F.when(progress, 0).otherwise(F.col("refetched") + F.col("asks").cast("int")).cast("int").alias("refetched"),
            F.when(progress, F.coalesce("now", "moved_ms")).otherwise(F.coalesce("moved_ms", "now")).alias("moved_ms"),
            F.when(F.col("reorg").isNotNull(), F.lit(batch_id)).otherwise(F.col("since")).cast("long").alias("since"),
        )
        reach = h.select("chain_id", F.col("expected").alias("_from"), F.col("to").alias("_to"), "reorg", F.col("since").alias("_since"))
        got = fresh.join(reach, "chain_id")
        released = got.where("number <= _to").select("chain_id", "number", "hash")
        went_from = F.when(went, F.col("expected"))
        span = h.agg(F.min(went_from).alias("low"), F.max("to").alias("high"), F.min(F.when(went, F.col("to") + 1).otherwise(F.col("expected"))).alias("least")).head()
        if span.low is not None:
            early = self.store.read("waiting", WAITING, span.low, span.high).join(reach, "chain_id").where("batch_id > _since AND number BETWEEN _from AND _to")
            released = released.unionByName(early.select("chain_id", "number", "hash"))
        waits = got.where("reorg IS NULL AND number > coalesce(_to, -1)").select("chain_id", "number", "hash", "parent_hash", F.lit(batch_id).cast("long").alias("batch_id"))
        none = F.lit(None).cast("long")
        events = reached.where("done AND NOT follows").select("chain_id", F.lit("overflow").alias("kind"), none.alias("number"), F.col("gap_from").alias("range_from"), (F.col("start") - 1).alias("range_to"))
        events = events.unionByName(h.where("reorg IS NOT NULL").select("chain_id", F.lit("reorg").alias("kind"), F.col("reorg").alias("number"), none.alias("range_from"), none.alias("range_to")))
        stalls = h.where("asks OR skips").select("chain_id", F.when(F.col("asks"), "refetch").otherwise("bypass").alias("kind"), none.alias("number"), F.col("stood").alias("range_from"), (F.col("target") - 1).alias("range_to"))
        left = reached.join(h.where("reorg IS NOT NULL").select("chain_id"), "chain_id", "left_anti").where("NOT done").select("chain_id", "start", "end", "parent", "hash")
        self.store.commit(batch_id, {"ordered": released, "waiting": waits, "events": events.unionByName(stalls)}, {"heads": after, "runs": left}, run, below={} if span.least is None else {"waiting": span.least})


def ordered_frontier(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """All that is there now of a stream of blocks, markers and clock rows through an IntervalFrontier into a store."""
    sink = IntervalFrontier(store, **options)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MERGED = "start long, end long, ts timestamp"


class RequestMerge(StatefulProcessor):
    """A request for a range is dropped within a window after the last accepted one for it."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        kept, last = accepted(frame["ts"], self.last.get()[0] if self.last.exists() else None, self.window_ms)
        if last is not None:
            self.last.update((last,))
        if kept:
            yield pd.DataFrame({"start": key[0], "end": key[1], "ts": frame["ts"].iloc[kept].reset_index(drop=True)})

    def close(self) -> None:
        pass


def accepted(times: pd.Series, last: int | None, window_ms: int) -> tuple[list[int], int | None]:
    """Which of the ascending times are accepted, and the last accepted one in milliseconds."""
    kept = []
    for i, ms in enumerate((times.astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()):
        if last is None or ms - last >= window_ms:
            kept.append(i)
            last = ms
    return kept, last


def request_merge(stream: DataFrame, window_ms: int) -> DataFrame:
    return stream.select("start", "end", "ts").groupBy("start", "end").transformWithStateInPandas(RequestMerge(window_ms), MERGED, "Append", "None")


def request_merge_batch(requests: DataFrame, window_ms: int) -> DataFrame:
    """T12 over a table: requests sorted by range and time, each partition read once in bounded memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            keep = []
            ms = (frame["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            for i, (a, b, t) in enumerate(zip(frame["start"].tolist(), frame["end"].tolist(), ms, strict=True)):
                if (a, b) != key:
                    key, last = (a, b), None
                if last is None or t - last >= window_ms:
                    keep.append(i)
                    last = t
            yield frame.iloc[keep]

    rows = requests.select("start", "end", "ts").repartition("start", "end").sortWithinPartitions("start", "end", "ts")
    return rows.mapInPandas(run, MERGED)
