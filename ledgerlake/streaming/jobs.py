"""Structured Streaming jobs, and the same rules over tables (S03, S04, S07, T)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerlake.operators.decode import block_activities
from ledgerlake.operators.neighbors import running_max
from ledgerlake.operators.windows import gap_list
from ledgerlake.sinks.batch import TASKS, commit_batch, commit_due
from ledgerlake.sinks.store import Store

CAPTURE = "ts long, type string, data string"
LOG = "struct<address:string,topics:array<string>,data:string,logIndex:string,transactionHash:string>"
HEADER = "struct<hash:string,parentHash:string,timestamp:string,gasLimit:string,gasUsed:string,baseFeePerGas:string>"
DATA = f"Number string, RangeEnd string, Block map<string,string>, Header {HEADER}, Logs array<{LOG}>, Err string"


def whole_number(text: Column) -> Column:
    """A JSON number or string, decimal or 0x hex, as a long; null for others."""
    hexes = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 20), 16, 10).try_cast("long"))
    return F.coalesce(hexes, F.regexp_replace(text, r"\.0+$", "").try_cast("long"))


def parse_capture(lines: DataFrame) -> DataFrame:
    """Number, range_end, block, logs of the usable lines (value) of a capture. Not usable: what isn't JSON or of the type, has no number, or a Block of exactly two keys."""
    envelope = lines.select(F.from_json("value", CAPTURE, {"mode": "PERMISSIVE"}).alias("e")).where("e.type = 'block_data'")
    rows = envelope.select("e.ts", F.from_json("e.data", DATA.replace(f"Header {HEADER}, ", ""), {"mode": "PERMISSIVE"}).alias("d"))
    number = whole_number(F.col("d.Number"))
    complete = F.col("d.Block").isNull() | (F.size(F.map_keys("d.Block")) != 2)
    return rows.where(number.isNotNull() & complete).select("ts", number.alias("number"), whole_number(F.col("d.RangeEnd")).alias("range_end"), F.col("d.Block").alias("block"), F.coalesce("d.Logs", F.array().cast(f"array<{LOG}>")).alias("logs"))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return parse_capture(spark.read.text(path))


def read_capture_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """S04."""
    return parse_capture(spark.readStream.option("maxFilesPerTrigger", files).text(path))


def within_head(batch: DataFrame, head: int, buffer: int, window: int = 10) -> DataFrame:
    """Rows of a batch up to head - buffer + window, never past head."""
    return batch.where(F.col("number") <= min(head, head - buffer + window))


def tail_follow(stream: DataFrame, head, sink, *, buffer: int, window: int = 10, checkpoint: str) -> StreamingQuery:
    """Each batch goes to sink up to the moving target that head() gives; the rest goes to sink with the flag late."""

    def each(batch: DataFrame, batch_id: int) -> None:
        top = head()
        limit = min(top, top - buffer + window)
        sink(batch.withColumn("deferred", F.col("number") > limit), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def units_of(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Units of ingest: block_number, logs, transactions; one row a block, which holds what one block can."""
    packed = lambda df, name: df.groupBy("block_number").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "block_number"])).alias(name))
    return packed(logs, "logs").join(packed(transactions, "transactions"), "block_number", "full")


def stream_decode(units: DataFrame, labels: DataFrame, metadata: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All activities (C13) of a stream of units. A unit is a whole block, so nothing is kept between batches; a batch writes a folder of its own, so one that is tried again changes nothing. Units are read again where they are used twice, which takes less room than holding them."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = lambda name: batch.select("block_number", F.explode(name).alias("_row")).select("block_number", "_row.*")
        out = block_activities(rows("logs"), rows("transactions"), labels, metadata)
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={batch_id}")

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "spark.sql.streaming.stateStore"
#: State in RocksDB: a bounded part of it is in memory, and a batch logs its changes instead of copying all keys.
ON_DISK = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "300",
}


@contextmanager
def _with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes along when it starts; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


TRANSFER_KEYS = ["block_number", "log_index"]


def stream_dedup(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """One row of each key within the delay; the insert-if-absent commit is what lasts. time: when a row came, so that none is late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(TRANSFER_KEYS)


def stream_dedup_commit(stream: DataFrame, store: Store, time: str, delay: str, checkpoint: str) -> StreamingQuery:
    """The store gets each key once, however late it comes again: state of `delay` spares the store near repeats, and what
    comes after that is compared with stored rows in folders whose bounds meet the batch. The state lets each key of a batch pass
    once, so only stored keys are left to look for."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop(time).persist()
        try:
            run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
            ends = batch.select(F.col("block_number").cast("long").alias("k")).agg(F.min("k").alias("low"), F.max("k").alias("high")).head()
            stored = store.read("transfers", batch.schema, ends.low, ends.high) if ends.low is not None else batch.limit(0)
            store.commit(batch_id, {"transfers": batch.join(stored.select(*TRANSFER_KEYS), TRANSFER_KEYS, "left_anti")}, {}, run)
        finally:
            batch.unpersist()

    with _with_settings(store.spark, ON_DISK):
        return stream_dedup(stream, time, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frontier_batch(blocks: DataFrame, start: int) -> DataFrame:
    """How far the blocks from start go without a gap; start - 1 if start is missing."""
    rows = blocks.where(F.col("number") >= start).select("number").distinct()
    gap = gap_list(rows).agg(F.min("gap_start").alias("gap"))
    ends = rows.agg(F.min("number").alias("low"), F.max("number").alias("high"))
    frontier = F.when(F.coalesce(F.col("low") != start, F.lit(True)), F.lit(start - 1)).otherwise(F.coalesce(F.col("gap") - 1, F.col("high")))
    return ends.crossJoin(gap).select(frontier.cast("long").alias("frontier"))


def tumbling_minute(events: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Counts a minute; the watermark matters on streams only."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


def sliding_rate(events: DataFrame, time: str, delay: str = "1 minute") -> DataFrame:
    """Events a second over the last five seconds, every second."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, "5 seconds", "1 second").alias("w")).agg((F.count("*") / 5).alias("rate")).select(F.col("w.end").alias("at"), "rate")


def sliding_rate_batch(events: DataFrame, time: str) -> DataFrame:
    """T10 over a table, from counts of seconds; a row for each second that has events."""
    counts = events.groupBy(F.unix_seconds(time).alias("second")).agg(F.count("*").alias("n"))
    parts = counts.withColumn("_part", F.floor(F.col("second") / 86400))
    reach = F.explode(F.when(F.col("second") % 86400 >= 86396, F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part")))  # the next day's first seconds look back
    w = W.partitionBy("_day").orderBy("second").rangeBetween(-4, 0)
    rows = parts.withColumn("_day", reach).withColumn("rate", F.sum("n").over(w) / 5)
    return rows.where(F.col("_day") == F.col("_part")).select("second", "rate")


def rate_with_silence(events: DataFrame, time: str, delay: str = "1 minute") -> DataFrame:
    """T10 with silence: second, rate of every second from an event to five seconds after it, when the rate is 0 unless others came. Streams and tables alike; no state but the windows'."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    rows = rows.select(F.window(time, "6 seconds", "1 second").alias("w"), F.unix_seconds(time).alias("second"))
    inside = F.count_if(F.col("second") >= F.unix_seconds("w.end") - 5)
    return rows.groupBy("w").agg((inside / 5).alias("rate")).select((F.unix_seconds("w.end") - 1).alias("second"), "rate")


CRITICAL = ["signup", "error"]


def latest_per_type(events: DataFrame, time: str = "ts", critical: list[str] = CRITICAL, window: str = "200 milliseconds") -> DataFrame:
    """Of each window only the newest event of a type; critical types pass whole. events: event_type, event_id and the time."""
    rows = events.withWatermark(time, "1 minute") if events.isStreaming else events
    kept = F.struct(time, "event_id", "value")
    plain = rows.where(~F.col("event_type").isin(critical)).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.max(kept).alias("e"))
    return plain.select("event_type", "e.event_id", "e.value").unionByName(rows.where(F.col("event_type").isin(critical)).select("event_type", "event_id", "value"))


def height_merge(updates: DataFrame, window_ms: int = 100) -> DataFrame:
    """The greatest head of each window, never less than before. updates: chain_id, ts, latest."""
    slots = updates.groupBy("chain_id", F.floor(F.unix_millis("ts") / window_ms).alias("slot")).agg(F.max("latest").alias("head"))
    return running_max(slots.withColumnRenamed("head", "own"), "slot", "own", "head", by=["chain_id"]).drop("own")


def height_merge_stream(updates: DataFrame, store: Store, checkpoint: str, window_ms: int = 100, delay: str = "1 minute") -> StreamingQuery:
    """T13 as a stream: the greatest head of each window that the watermark has closed, never less than before, into the store's table `merged`. What a chain has reached is carried in its table `tops`."""
    closed = updates.withWatermark("ts", delay).groupBy("chain_id", F.window("ts", f"{window_ms} milliseconds").alias("w")).agg(F.max("latest").alias("head"))
    closed = closed.select("chain_id", F.floor(F.unix_millis("w.start") / window_ms).alias("slot"), "head")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            tops = store.read("tops", "chain_id long, top long")
            rows = running_max(batch.withColumnRenamed("head", "own"), "slot", "own", "head", by=["chain_id"]).drop("own")
            rows = rows.join(tops, "chain_id", "left").withColumn("head", F.greatest("head", "top")).drop("top")
            last = tops.unionByName(batch.select("chain_id", F.col("head").alias("top"))).groupBy("chain_id").agg(F.max("top").alias("top"))
            run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
            store.commit(batch_id, {"merged": rows}, {"tops": last}, run)
        finally:
            batch.unpersist()

    return closed.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_commit(blocks: DataFrame, store: Store, chain_id: int, now: Column, checkpoint: str, transfers=None) -> StreamingQuery:
    """Every micro-batch of blocks is one commit; the cursor only rises. transfers(batch): the rows to commit with it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        rows = transfers(batch) if transfers else batch.sparkSession.createDataFrame([], "block_number long, log_index int")
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        commit_batch(store, batch_id, chain_id, batch, rows, now, run)
        batch.unpersist()

    return blocks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cadence(tasks: DataFrame, store: Store, chain_id: int, now: Column, checkpoint: str, *, most: int = 200, every_ms: int = 500) -> StreamingQuery:
    """K06's cadence: tasks (task_id, height, arrival_ms) are committed when `most` have gathered or their beat of `every_ms` ends.

    A trigger isn't a flush: it may bring several, or none, and the batch it leaves open is carried to the next. The clock is the
    greatest arrival that has come, so a replay flushes the same batches. `drain_cadence` commits what is left when the stream ends.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            clock = batch.agg(F.max("arrival_ms")).head()[0]
            if clock is not None:
                run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
                commit_due(store, batch_id, batch, clock, chain_id, now, most=most, every_ms=every_ms, run=run)
        finally:
            batch.unpersist()

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_cadence(store: Store, chain_id: int, now: Column, *, most: int = 200, every_ms: int = 500) -> None:
    """Commit what a stopped cadence has left open."""
    none = store.spark.createDataFrame([], TASKS)
    commit_due(store, store.committed("drain") + 1, none, None, chain_id, now, most=most, every_ms=every_ms, run="drain")


def observed(stream: DataFrame, name: str = "ingest") -> DataFrame:
    """The stream, counting its rows and heights into each batch's progress."""
    return stream.observe(name, F.count("*").alias("rows"), F.max("number").alias("height"))


SAMPLES = "ts string, metric string, labels map<string,string>, value double"


class MetricListener(StreamingQueryListener):
    """Metric samples (ts, metric, labels, value) of every batch. At most `keep` are held; beyond that they go to a folder of Parquet."""

    def __init__(self, folder: str, keep: int = 10_000):
        self.folder, self.keep, self.samples, self.written = folder, keep, [], False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        values = {"input_rows": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution", 0)}
        for name, row in (p.observedMetrics or {}).items():
            values |= {f"{name}_{k}": v for k, v in row.asDict().items() if v is not None}
        self.samples += [(p.timestamp, k, {"query": p.name or str(p.id), "batch": str(p.batchId)}, float(v)) for k, v in values.items()]
        if len(self.samples) >= self.keep:
            self._flush(SparkSession.active())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def _flush(self, spark: SparkSession) -> None:
        rows, self.samples, self.written = self.samples, [], True
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(self.folder)

    def frame(self, spark: SparkSession) -> DataFrame:
        held = spark.createDataFrame(self.samples, SAMPLES)
        return held.unionByName(spark.read.schema(SAMPLES).parquet(self.folder)) if self.written else held


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now through a stream into Parquet, and that read again."""
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(folder)


def run_complete(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """All that is there now through an aggregation in complete mode; each batch's whole result goes to a folder of its own, and the last is read."""
    last: list[str] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch-{batch_id:012d}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
