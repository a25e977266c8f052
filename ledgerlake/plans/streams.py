"""Queries of the streaming jobs: streams over files written from the tables, and their rules over tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.plans.base import query
from ledgerlake.plans.ledger import _ACT, _LOGA, _TXA
from ledgerlake.plans.scratch import new_folder
from ledgerlake.plans.views import Views
from ledgerlake.sinks import batch as K
from ledgerlake.sources import tail
from ledgerlake.streaming import frontier, jobs

def _as_stream(v: Views, rows: DataFrame, tag: str, files: int = 8) -> DataFrame:
    """rows, written to files and streamed from them, three at a time."""
    folder = new_folder(v.spark, tag)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(folder)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)


def _as_they_lie(v: Views, rows: DataFrame, tag: str, triggers: int = 4) -> DataFrame:
    """rows, written by the tasks that have them and streamed in some triggers; a file goes once it has been read."""
    folder = new_folder(v.spark, tag)
    rows.write.option("compression", "zstd").parquet(folder)
    paths = v.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    files = len(paths.getFileSystem(v.spark._jsc.hadoopConfiguration()).globStatus(paths))
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // triggers))).option("cleanSource", "delete").parquet(folder)


def _arrival(rows: DataFrame, files: int = 4, apart: int = 40, most: int = 100_000):
    """The file in which each block comes: files follow the numbers, and a block comes up to `apart` numbers late."""
    top = rows.agg(F.max("number")).first()[0] or 0
    width = min(max(top // files + 1, 2 * apart), most)
    return F.floor((F.col("number") + F.pmod(F.xxhash64("number"), F.lit(apart))) / width)


def _aged(v: Views, folder: str) -> Counter:
    """Give files the order of their parts: a file stream takes the oldest file first. How many files each part has."""
    paths = v.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part=*/*.parquet")
    store = paths.getFileSystem(v.spark._jsc.hadoopConfiguration())
    files = Counter()
    for f in store.globStatus(paths):
        part = f.getPath().getParent().getName().split("=")[1]
        store.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * int(part), -1)
        files[part] += 1
    return files


def _in_order(v: Views, rows: DataFrame, tag: str, triggers: int = 4) -> DataFrame:
    """rows, written to files in the order of their numbers and streamed from them, some neighbours at a time; fewer than 40 blocks are early at once. There are as many triggers whatever the size, since each costs as much."""
    folder = new_folder(v.spark, tag)
    rows.withColumn("part", _arrival(rows)).repartition("part").write.partitionBy("part").parquet(folder)
    files = len(_aged(v, folder))
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // triggers))).parquet(f"{folder}/part=*")


def _through(v: Views, stream: DataFrame, tag: str) -> DataFrame:
    return jobs.run_to_table(stream, new_folder(v.spark, tag), new_folder(v.spark, f"{tag}-state"))


def _captured(v: Views) -> DataFrame:
    """Capture lines of blocks, some malformed: not JSON, of another type, without number, incomplete, and numbers as text."""
    rows = v.blocks.withColumn("ts", F.col("processed_at_ms")).withColumn("k", F.col("number") % 20)
    block = F.create_map(F.lit("hash"), F.col("hash"), F.lit("parentHash"), F.col("parent_hash"), F.lit("timestamp"), F.col("timestamp").cast("string"))
    partial = F.create_map(F.lit("hash"), F.col("hash"), F.lit("number"), F.col("number").cast("string"))
    number = F.when(F.col("k") != 3, F.col("number"))
    data = F.struct(number.alias("Number"), F.col("number").alias("RangeEnd"), F.when(F.col("k") == 4, partial).otherwise(block).alias("Block"))
    text = F.struct(F.concat(F.lit("0x"), F.lower(F.hex("number"))).alias("Number"), F.col("number").alias("RangeEnd"), block.alias("Block"))
    line = F.to_json(F.struct("ts", F.when(F.col("k") == 2, "transfer").otherwise("block_data").alias("type"), data.alias("data")))
    as_text = F.to_json(F.struct("ts", F.lit("block_data").alias("type"), text.alias("data")))
    return rows.select(F.when(F.col("k") == 1, "{broken").when(F.col("k") == 5, as_text).otherwise(line).alias("value"))


_USABLE = "SELECT number, hash, number AS range_end FROM blocks WHERE number % 20 NOT IN (1, 2, 3, 4)"


@query("s03_read_capture", "blocks", _USABLE)
def s03(v):
    folder = new_folder(v.spark, "capture")
    _captured(v).write.option("compression", "gzip").text(folder)
    return jobs.read_capture(v.spark, folder).select("number", F.col("block")["hash"].alias("hash"), "range_end")


@query("s04_read_capture_stream", "blocks", _USABLE)
def s04(v):
    folder = new_folder(v.spark, "capture")
    _captured(v).repartition(6).write.text(folder)
    rows = jobs.read_capture_stream(v.spark, folder, 2).select("number", F.col("block")["hash"].alias("hash"), "range_end")
    return _through(v, rows, "capture-rows")


@query("s07_tail_follow", "blocks", "SELECT number, hash, number > 9010 AS deferred FROM blocks")
def s07(v):
    out = new_folder(v.spark, "tail")
    stream = _as_stream(v, v.blocks.select("number", "hash"), "tail-in")
    sink = lambda rows, _: rows.write.mode("append").parquet(out)
    jobs.tail_follow(stream, lambda: 9050, sink, buffer=50, checkpoint=new_folder(v.spark, "tail-state")).awaitTermination()
    return v.spark.read.parquet(out)


_TAIL = "WITH h AS (SELECT max(number) AS top FROM blocks)"


@query("s07_tail_source", "blocks", f"{_TAIL} SELECT number, hash, CASE WHEN number <= top // 2 - 40 THEN 1 ELSE 2 END AS run FROM blocks, h WHERE number <= top - 40")
def s07_source(v):
    head, state, out = (new_folder(v.spark, f"tail-{x}") for x in ("head", "state", "out"))
    top = v.blocks.agg(F.max("number")).head()[0]
    blocks = v.blocks.select("number", "hash")
    for run, height in enumerate((top // 2, top // 3, top), 1):  # the second head falls, and brings nothing
        tail.publish_head(v.spark, head, height)
        ranges = tail.tail_ranges(v.spark, head, buffer=50)
        sink = lambda rows, k, run=run: rows.withColumn("run", F.lit(1 if run == 1 else 2)).write.mode("overwrite").parquet(f"{out}/batch={k}")
        tail.follow(ranges, blocks, sink, state).awaitTermination()
    return v.spark.read.parquet(out).select("number", "hash", "run")


@query("k03_append_bulk", "blocks", "SELECT number, hash FROM blocks")
def k03(v):
    out = new_folder(v.spark, "bulk")
    for part in (0, 1):
        K.append_bulk(v.blocks.where(F.col("number") % 2 == part).select("number", "hash"), out)
    return v.spark.read.parquet(out)


_COMMITTED = "SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(DISTINCT (block_number, log_index)) FROM transfers) AS transfers, (SELECT max(number) FROM blocks) AS checkpoint, false AS again"


@query("k06_commit_batch", "blocks transfers", _COMMITTED)
def k06(v):
    store = K.Store(v.spark, new_folder(v.spark, "store"))
    for part in (0, 1, 2):
        args = (store, part, 1, v.blocks.where(F.col("number") % 3 == part), v.transfers.where(F.col("block_number") % 3 == part), F.timestamp_seconds(F.lit(1700000000)))
        K.commit_batch(*args)
        again = K.commit_batch(*args)
    blocks, transfers = store.read("blocks", v.blocks.schema), store.read("transfers", v.transfers.schema)
    point = store.read("checkpoints", K.CHECKPOINTS).select(F.col("last_synced_block").alias("checkpoint"))
    return blocks.agg(F.count("*").alias("blocks")).crossJoin(transfers.agg(F.count("*").alias("transfers"))).crossJoin(point).withColumn("again", F.lit(again))


_CADENCE = """WITH t AS (SELECT number, (number * 2 + number % 7) // 500 AS beat, number * 2 + number % 7 AS ms FROM blocks), p AS (SELECT *, (row_number() OVER (PARTITION BY beat ORDER BY ms, number) - 1) // 200 AS part, count(*) OVER (PARTITION BY beat) AS n FROM t)
 SELECT beat, part, CASE WHEN (part + 1) * 200 <= any_value(n) THEN 'count' ELSE 'age' END AS reason, count(*) AS tasks, max(number) AS checkpoint FROM p GROUP BY beat, part"""


def _tasks(v: Views) -> DataFrame:
    n = F.col("number")
    return v.blocks.select(n.alias("task_id"), n.alias("height"), (n * 2 + n % 7).alias("arrival_ms"))


@query("k06_commit_cadence", "blocks", _CADENCE)
def k06c(v):
    return K.flushes(_tasks(v))


@query("k06_cadence_stream", "blocks", _CADENCE)
def k06s(v):
    """Six triggers of equal spans of time, which end inside beats; what the last leaves open is drained."""
    tasks, now = _tasks(v), F.timestamp_seconds(F.lit(1700000000))
    last = tasks.agg(F.max("arrival_ms")).head()[0] or 0
    part = F.floor(F.col("arrival_ms") * 6 / (last + 1))
    store = K.Store(v.spark, new_folder(v.spark, "cadence-store"))
    jobs.stream_cadence(_parts(v, [tasks.where(part == k) for k in range(6)], "tasks"), store, 1, now, new_folder(v.spark, "cadence-state")).awaitTermination()
    jobs.drain_cadence(store, 1, now)
    return store.read("flushed", K.FLUSHED).groupBy("beat", "part", "reason").agg(F.count("*").alias("tasks"), F.max("height").alias("checkpoint"))


_HALF = "SELECT max(number) * 2 // 3 AS k FROM blocks"


@query("q13_reorg_job", "blocks transfers", f"""WITH f AS ({_HALF}), a AS (SELECT max(number) AS ancestor FROM blocks, f WHERE number < k)
 SELECT ancestor AS checkpoint, (SELECT count(*) FROM blocks WHERE number <= ancestor) AS blocks, (SELECT count(DISTINCT (block_number, log_index)) FROM transfers WHERE block_number <= ancestor) AS transfers, 1 AS commits, true AS aligned FROM a""")
def q13_job(v):
    store, now = K.Store(v.spark, new_folder(v.spark, "reorg-job")), F.timestamp_seconds(F.lit(1700000000))
    top = v.blocks.agg(F.max("number")).head()[0]
    fork = top * 2 // 3
    stored = v.blocks.withColumn("hash", F.when(F.col("number") >= fork, F.concat(F.lit("0xfork"), "number")).otherwise(F.col("hash")))
    for k in range(3):  # thirds of the numbers
        third = lambda df, c, k=k: df.where(F.col(c).between(top * k // 3 + (k > 0), top * (k + 1) // 3))
        K.commit_batch(store, k, 1, third(stored, "number"), third(v.transfers, "block_number"), now)
    before = store.manifest().seq
    right = v.canonical_blocks.where(F.col("number") >= fork - 500)
    K.reorganise(store, 0, 1, right, v.blocks.schema, v.transfers.schema, now)
    again = K.reorganise(store, 1, 1, right, v.blocks.schema, v.transfers.schema, now)
    counts = store.read("blocks", v.blocks.schema).agg(F.count("*").alias("blocks")).crossJoin(store.read("transfers", v.transfers.schema).agg(F.count("*").alias("transfers")))
    point = store.read("checkpoints", K.CHECKPOINTS).select(F.col("last_synced_block").alias("checkpoint"))
    return point.crossJoin(counts).withColumn("commits", F.lit(store.manifest().seq - before)).withColumn("aligned", F.lit(again is None))


@query("k07_tee_sinks", "blocks", "SELECT 'bad' AS sink, true AS failed, 0 AS rows UNION ALL SELECT 'one', false, count(*) FROM blocks UNION ALL SELECT 'two', false, count(*) FROM blocks")
def k07(v):
    one, two = new_folder(v.spark, "tee"), new_folder(v.spark, "tee")

    def bad(_):
        raise OSError("no space")

    status = K.tee_sinks(v.blocks.select("number"), {"one": lambda r: r.write.parquet(one), "bad": bad, "two": lambda r: r.write.parquet(two)})
    counts = v.spark.read.parquet(one).agg(F.count("*").alias("rows")).withColumn("sink", F.lit("one")).unionByName(v.spark.read.parquet(two).agg(F.count("*").alias("rows")).withColumn("sink", F.lit("two")))
    return status.join(counts, "sink", "left").select("sink", F.col("error").isNotNull().alias("failed"), F.coalesce("rows", F.lit(0)).alias("rows"))


@query("k08_capture_sink", "blocks", "SELECT number, hash, 'block' AS type FROM blocks")
def k08(v):
    out = new_folder(v.spark, "capture-out")
    K.capture_sink(v.blocks.select("number", "hash"), out, "block", F.lit(1700000000000))
    return v.spark.read.schema("ts long, type string, data struct<number:long,hash:string>").json(out).select("data.number", "data.hash", "type")


@query("t01_stream_decode", "transactions logs entity_labels token_metadata", f"SELECT {', '.join(_ACT)} FROM ({_LOGA}) UNION ALL SELECT {', '.join(_ACT)} FROM ({_TXA})")
def t01(v):
    out = new_folder(v.spark, "decoded")
    dealt = v.by_block()
    units = _as_they_lie(v, jobs.units_of(dealt.logs, dealt.transactions), "units")
    jobs.stream_decode(units, v.entity_labels, v.token_metadata, out, new_folder(v.spark, "decoded-state")).awaitTermination()
    return v.spark.read.parquet(out).select(*_ACT)


@query("t02_stream_dedup", "transfers", "SELECT DISTINCT block_number, log_index FROM transfers")
def t02(v):
    """Three hours of rows; some come again an hour later, while they are remembered, others after three hours, when only the store knows them."""
    rows = v.transfers.withColumn("h", F.pmod(F.xxhash64("block_number", "log_index"), F.lit(105)))
    again = F.array_compact(F.array(F.lit(0), F.when(F.col("h") % 5 == 0, 1), F.when(F.col("h") % 7 == 0, 3)))
    rows = rows.withColumn("later", F.explode(again)).withColumn("hour", F.col("h") % 3 + F.col("later")).withColumn("arrived_at", F.timestamp_seconds(F.lit(1700000000) + 3600 * F.col("hour")))
    stream = _parted(v, rows.drop("h", "later").withColumnRenamed("hour", "part"), "transfers")
    store = K.Store(v.spark, new_folder(v.spark, "deduplicated"))
    jobs.stream_dedup_commit(stream, store, "arrived_at", "30 minutes", new_folder(v.spark, "deduplicated-state")).awaitTermination()
    return store.read("transfers", v.transfers.schema).select("block_number", "log_index")


def _parts(v: Views, parts: list[DataFrame], tag: str) -> DataFrame:
    """Parts of a stream, streamed in their order, one a trigger."""
    folder = new_folder(v.spark, tag)
    for k, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(f"{folder}/part={k:04d}")
    _aged(v, folder)
    return v.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def _parted(v: Views, rows: DataFrame, tag: str) -> DataFrame:
    """rows, streamed in the order of their part, one part a trigger. All tasks write all parts at once, so a part has a file of each task."""
    folder = new_folder(v.spark, tag)
    rows.write.partitionBy("part").parquet(folder)
    files = max(_aged(v, folder).values(), default=1)
    return v.spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")


def _frontier(v: Views, stream: DataFrame, tag: str, **options) -> K.Store:
    store = K.Store(v.spark, new_folder(v.spark, f"{tag}-store"))
    frontier.ordered_frontier(stream, store, new_folder(v.spark, f"{tag}-state"), **options).awaitTermination()
    return store


def _rows(blocks: DataFrame, chain=None, mark=None, at_ms: int | None = None) -> DataFrame:
    """Blocks (or chains only, where blocks has no number) as rows of a frontier's stream."""
    value = lambda c: c.cast("long") if c is not None else F.lit(None).cast("long")
    text = lambda c: F.col(c) if c in blocks.columns else F.lit(None).cast("string")
    number = F.col("number") if "number" in blocks.columns else F.lit(None)
    return blocks.select(value(F.lit(1) if chain is None else chain).alias("chain_id"), value(number).alias("number"), text("hash").alias("hash"), text("parent_hash").alias("parent_hash"), value(mark).alias("range_end"), F.lit(at_ms).cast("long").alias("at_ms"))


@query("t03_ordered_frontier", "canonical_blocks", "SELECT number, hash, 'block' AS kind FROM canonical_blocks")
def t03(v):
    stream = _as_stream(v, _rows(v.canonical_blocks), "frontier", 6)
    return _frontier(v, stream, "frontier", most=None).read("ordered", frontier.ORDERED).select("number", "hash", F.lit("block").alias("kind"))


SHORT = 97  #: blocks of one of many short chains; each has one gap, at 13


def _short(v: Views, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks as chains of SHORT numbers from 0, unlinked, and the chains."""
    chain = F.floor(F.col("number") / SHORT)
    rows = blocks.select(chain.alias("chain_id"), (F.col("number") % SHORT).alias("number"), "hash", F.lit(None).cast("string").alias("parent_hash"))
    return _rows(rows, F.col("chain_id")), rows.select("chain_id").distinct()


_SHORT = f"WITH s AS (SELECT number // {SHORT} AS chain_id, number % {SHORT} AS number, hash FROM blocks), c AS (SELECT chain_id, max(number) AS top, max(number) > 13 AS gap FROM s GROUP BY 1)"


@query("t05_gap_bypass", "blocks", f"""{_SHORT}
 SELECT chain_id, 'refetch' AS kind, 13::BIGINT AS range_from, 13::BIGINT AS range_to, 3::BIGINT AS n FROM c WHERE gap
 UNION ALL SELECT chain_id, 'bypass', 13, 13, 1 FROM c WHERE gap
 UNION ALL SELECT chain_id, 'bypass', top + k, top + k, 1 FROM c, (VALUES (1), (2)) v(k) WHERE k = 1 OR NOT gap
 UNION ALL SELECT chain_id, 'block', min(number), max(number), count(*) FROM s GROUP BY chain_id""")
def t05(v):
    rows, chains = _short(v, v.blocks)
    tick = lambda s: _rows(chains, F.col("chain_id"), at_ms=s * 1000)
    # a clock of six times: the start, 55 seconds without progress (three requests, then the bypass), and as long again
    stream = _parts(v, [rows.unionByName(tick(0)), tick(55), tick(56), tick(57), tick(58), tick(113)], "bypass")
    store = _frontier(v, stream, "bypass", most=None, stall_ms=frontier.STALL_MS)
    events = store.read("events", frontier.EVENTS).groupBy("chain_id", "kind", "range_from", "range_to").agg(F.count("*").alias("n"))
    blocks = store.read("ordered", frontier.ORDERED).groupBy("chain_id").agg(F.min("number").alias("range_from"), F.max("number").alias("range_to"), F.count("*").alias("n"))
    return events.unionByName(blocks.withColumn("kind", F.lit("block")))


@query("t07_range_teleport", "blocks", f"{_SHORT} SELECT s.chain_id, s.number, s.hash FROM s JOIN c USING (chain_id) WHERE s.number < 13 OR s.number > CASE WHEN chain_id % 3 = 0 THEN 40 ELSE 13 END")
def t07(v):
    rows, chains = _short(v, v.blocks)
    passed = _rows(chains, F.col("chain_id"), F.lit(5))  # behind what is expected, so it moves nothing
    marks = _rows(chains, F.col("chain_id"), F.when(F.col("chain_id") % 3 == 0, 40).otherwise(13))  # the gap, and for some chains blocks that wait behind it
    store = _frontier(v, _parts(v, [rows, passed, marks], "teleport"), "teleport", most=None)
    return store.read("ordered", frontier.ORDERED)


_OVER = 50


@query("t06_buffer_overflow_skip", "blocks", f"""WITH b AS (SELECT number FROM blocks WHERE number % 211 <> 5 AND number % 101 <> 7),
 g AS (SELECT number, lag(number) OVER (ORDER BY number) AS prev, count(*) OVER (ORDER BY number DESC) AS behind FROM b),
 stop AS (SELECT coalesce(min(number), (SELECT max(number) + 1 FROM b)) AS at FROM g WHERE number > coalesce(prev, -1) + 1 AND behind <= {_OVER})
 SELECT 'overflow' AS kind, coalesce(prev, -1) + 1 AS range_from, number - 1 AS range_to, 1::BIGINT AS n FROM g, stop WHERE number > coalesce(prev, -1) + 1 AND number < stop.at
 UNION ALL SELECT 'block', min(number), max(number), count(*) FROM b, stop WHERE number < stop.at""")
def t06(v):
    rows = v.blocks.where("number % 211 <> 5 AND number % 101 <> 7")
    store = _frontier(v, _in_order(v, _rows(rows), "overflow"), "overflow", most=_OVER)
    events = store.read("events", frontier.EVENTS).select("kind", "range_from", "range_to", F.lit(1).cast("long").alias("n"))
    blocks = store.read("ordered", frontier.ORDERED).agg(F.min("number").alias("range_from"), F.max("number").alias("range_to"), F.count("*").alias("n"))
    return events.unionByName(blocks.withColumn("kind", F.lit("block")))


@query("t08_stream_reorg", "blocks canonical_blocks", f"""WITH b AS (SELECT number // {SHORT} AS chain_id, min(number) AS at FROM blocks WHERE number % {SHORT} > 0 AND (number % 211 = 5 OR number % 101 = 7) GROUP BY 1),
 c AS (SELECT number // {SHORT} AS chain_id, count(*) AS blocks, count(DISTINCT number) AS numbers FROM canonical_blocks GROUP BY 1) SELECT c.chain_id, blocks, numbers, b.at % {SHORT} AS reorg_at FROM c LEFT JOIN b USING (chain_id)""")
def t08(v):
    # forked blocks with gaps, and the canonical ones twice: a fork behind a gap shows only when the gap is filled
    short = lambda df: _rows(df.select((F.col("number") % SHORT).alias("number"), "hash", "parent_hash", F.floor(F.col("number") / SHORT).alias("chain")), F.col("chain"))
    right = short(v.canonical_blocks)
    store = _frontier(v, _parts(v, [short(v.blocks), right, right], "reorg"), "reorg", most=None)
    reorgs = store.read("events", frontier.EVENTS).where("kind = 'reorg'").groupBy("chain_id").agg(F.min("number").alias("reorg_at"), F.count("*").alias("n"))
    blocks = store.read("ordered", frontier.ORDERED).groupBy("chain_id").agg(F.count("*").alias("blocks"), F.count_distinct("number").alias("numbers"))
    return blocks.join(reorgs.where("n = 1"), "chain_id", "left").select("chain_id", "blocks", "numbers", "reorg_at")


@query("t04_frontier_batch", "blocks", "SELECT min(number) - 1 AS frontier FROM (SELECT unnest(range(14, 20000)) AS number EXCEPT SELECT number FROM blocks)")
def t04(v):
    return jobs.frontier_batch(v.blocks, 14)


_MINUTES = "SELECT date_trunc('minute', make_timestamp(timestamp * 1000000)) AS minute, count(*) AS n FROM blocks GROUP BY 1"


@query("t09_tumbling_minute", "blocks", _MINUTES)
def t09(v):
    return jobs.tumbling_minute(v.blocks.withColumn("at", F.timestamp_seconds("timestamp")), "at")


@query("t09_tumbling_minute_stream", "blocks", _MINUTES)
def t09s(v):
    stream = _as_stream(v, v.blocks.select(F.timestamp_seconds("timestamp").alias("at")), "minutes")
    return jobs.run_complete(jobs.tumbling_minute(stream, "at"), new_folder(v.spark, "minute-counts"), new_folder(v.spark, "minute-state"))


@query("t10_sliding_tps", "", "WITH s AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY 1) SELECT second, (sum(n) OVER (ORDER BY second RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) / 5.0)::DOUBLE AS rate FROM s")
def t10(v):
    return jobs.sliding_rate_batch(v.events, "ts")


_SILENCE = "WITH e AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS s FROM events), x AS (SELECT s + k AS second, k < 5 AS inside FROM e, range(6) r(k)) SELECT second, (count(*) FILTER (inside) / 5.0)::DOUBLE AS rate FROM x GROUP BY second"


@query("t10_sliding_silence", "", _SILENCE)
def t10_silence(v):
    return jobs.rate_with_silence(v.events, "ts")


@query("t10_sliding_silence_stream", "", _SILENCE)
def t10_silence_stream(v):
    stream = _as_stream(v, v.events.select("ts"), "rates")
    return jobs.run_complete(jobs.rate_with_silence(stream, "ts"), new_folder(v.spark, "rate-counts"), new_folder(v.spark, "rate-state"))


@query("t11_latest_per_type", "", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type NOT IN ('signup', 'error') GROUP BY event_type, epoch_us(ts) // 200000 UNION ALL SELECT event_type, event_id, value FROM events WHERE event_type IN ('signup', 'error')")
def t11(v):
    return jobs.latest_per_type(v.events.select("event_type", "event_id", "value", "ts"))


@query("t12_request_merge", "", """WITH RECURSIVE r AS (SELECT user_id % 10 AS s, epoch_us(ts) // 1000 AS ms, min(ts) AS ts FROM events GROUP BY ALL),
 later AS MATERIALIZED (SELECT r.s, r.ms, n.ms AS later FROM r ASOF JOIN r n ON r.s = n.s AND r.ms + 3600000 <= n.ms),
 a AS (SELECT s, min(ms) AS ms FROM r GROUP BY s UNION ALL SELECT a.s, later FROM a JOIN later USING (s, ms))
 SELECT s AS start, s + 50 AS "end", r.ts FROM a JOIN r USING (s, ms)""")
def t12(v):
    rows = v.events.select((F.col("user_id") % 10).alias("start"), (F.col("user_id") % 10 + 50).alias("end"), "ts")
    return frontier.request_merge_batch(rows, 3_600_000)


_MERGED = "WITH s AS (SELECT chain_id, (epoch_us(ts) // 1000) // 100 AS slot, max(latest) AS head FROM status_samples GROUP BY 1, 2) SELECT chain_id, slot, max(head) OVER (PARTITION BY chain_id ORDER BY slot) AS head FROM s"


@query("t13_height_merge", "status_samples", _MERGED)
def t13(v):
    return jobs.height_merge(v.status_samples)


@query("t13_height_merge_stream", "status_samples", _MERGED)
def t13s(v):
    rows = v.status_samples.select("chain_id", "ts", "latest")
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.max("chain_id").alias("c")).head()
    quarter = F.floor(F.lit(4) * (F.unix_micros("ts") - F.unix_micros(F.lit(ends.low))) / (F.unix_micros(F.lit(ends.high)) - F.unix_micros(F.lit(ends.low)) + 1))
    closing = rows.sparkSession.range(1).select(F.lit(ends.c).alias("chain_id"), (F.lit(ends.high) + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(0).cast("long").alias("latest"))  # its own window stays open
    parts = [rows.where(quarter == k) for k in range(4)]
    store = K.Store(v.spark, new_folder(v.spark, "heads-store"))
    jobs.height_merge_stream(_parts(v, [*parts, closing], "heads"), store, new_folder(v.spark, "heads-state")).awaitTermination()
    return store.read("merged", "chain_id long, slot long, head long")


@query("t14_stream_commit", "blocks", "SELECT count(*) AS blocks, max(number) AS checkpoint FROM blocks")
def t14(v):
    store = K.Store(v.spark, new_folder(v.spark, "stream-store"))
    stream = _as_stream(v, v.blocks, "commits")
    jobs.stream_commit(stream, store, 1, F.timestamp_seconds(F.lit(1700000000)), new_folder(v.spark, "commit-state")).awaitTermination()
    point = store.read("checkpoints", K.CHECKPOINTS).select(F.col("last_synced_block").alias("checkpoint"))
    return store.read("blocks", v.blocks.schema).agg(F.count("*").alias("blocks")).crossJoin(point)


@query("t15_stream_metrics", "blocks", "SELECT count(*)::DOUBLE AS rows, max(number)::DOUBLE AS height FROM blocks")
def t15(v):
    listener = jobs.MetricListener(new_folder(v.spark, "metric-samples"))
    v.spark.streams.addListener(listener)
    try:
        _through(v, jobs.observed(_as_stream(v, v.blocks.select("number"), "metrics")), "metric-rows")
        v.spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        v.spark.streams.removeListener(listener)
    samples = listener.frame(v.spark)
    return samples.agg(F.sum(F.when(F.col("metric") == "ingest_rows", F.col("value"))).alias("rows"), F.max(F.when(F.col("metric") == "ingest_height", F.col("value"))).alias("height"))
