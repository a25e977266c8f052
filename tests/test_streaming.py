"""The ordered frontier's rules, and streams against their rules over tables."""

import json
import os
import random

import plain_frontier as plain
import pytest

from pyspark.sql import functions as F

from ledgerlake.sinks import batch as sinks
from ledgerlake.sinks.store import Store
from ledgerlake.sources import tail
from ledgerlake.streaming import frontier, jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def blocks(f, *numbers):
    return [x for n in numbers for x in f.block(n, f"h{n}", f"h{n - 1}")]


def test_reorders():
    f = plain.Frontier(100)
    assert [x[1] for x in blocks(f, 100, 102, 101)] == [100, 101, 102]
    assert f.expected == 103 and not f.buffer


def test_late_blocks_are_dropped():
    f = plain.Frontier(100)
    assert blocks(f, 99) == [] and f.expected == 100


def test_gap_is_refetched_and_then_bypassed():
    f = plain.Frontier(100)
    blocks(f, 100, 102)
    kinds = [list(f.stalled()) for _ in range(4)]
    assert [k[0][0] for k in kinds] == ["refetch"] * 3 + ["bypass"]
    assert kinds[3][0][3:] == (101, 101) and kinds[3][1][:2] == ("block", 102)
    assert f.expected == 103


def test_overflow_jumps():
    f = plain.Frontier(0, most=3)
    out = blocks(f, 10, 11, 12, 13)
    assert out[0][0] == "overflow" and [x[1] for x in out[1:]] == [10, 11, 12, 13]


def test_progress_marker_teleports():
    f = plain.Frontier(100)
    blocks(f, 151)
    assert [x[1] for x in f.progress(150)] == [151] and f.expected == 152


def test_reorg_drops_what_follows():
    f = plain.Frontier(100)
    blocks(f, 100)
    f.buffer[103] = ("h103", "h102")
    out = list(f.block(101, "h101", "other"))
    assert out[0][:2] == ("reorg", 101) and f.expected == 101 and not f.buffer
    assert [x[0] for x in f.block(101, "g101", "h100")] == ["block"]


FEED = "chain_id long, number long, hash string, parent_hash string, range_end long, at_ms long"


def feed(spark, store, batches, **options):
    sink = frontier.IntervalFrontier(store, **options)
    for k, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, FEED), k)
        sink(spark.createDataFrame(rows, FEED), k)  # tried again: changes nothing
    events = [tuple(r) for r in store.read("events", frontier.EVENTS).collect()]
    return sorted((r.chain_id, r.number, r.hash) for r in store.read("ordered", frontier.ORDERED).collect()), sorted(events, key=str)


def row(number=None, chain=1, parent=None, mark=None, at=None):
    return chain, number, None if number is None else f"h{number}", parent or (None if number is None else f"h{number - 1}"), mark, at


def test_stream_keeps_order_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate([[100], [102], [101], [99, 104, 103]]):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"chain_id": 1, "number": n, "hash": f"h{n}", "parent_hash": f"h{n - 1}"}) for n in batch))
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(folder))
    store = Store(spark, str(tmp_path / "out"))
    frontier.ordered_frontier(stream, store, str(tmp_path / "state"), start=100).awaitTermination()
    assert sorted(r.number for r in store.read("ordered", frontier.ORDERED).collect()) == [100, 101, 102, 103, 104]
    assert not store.folders("waiting") and not store.folders("runs")


def test_intervals_equal_the_rules_block_by_block(spark, tmp_path):
    rng, chains, batches, want = random.Random(4), (1, 2), [[] for _ in range(4)], []
    rules = {c: plain.Frontier(0, most=10**9) for c in chains}
    for c in chains:
        numbers = [n for n in range(60) if n not in ((7, 30) if c == 1 else (0, 41))]
        for n in numbers:
            batches[rng.randrange(3)].append(row(n, c))
            if n % 9 == 0:
                batches[rng.randrange(4)].append(row(n, c))  # comes again
    batches[1].append(row(chain=1, mark=9))
    batches[3] += [row(chain=2, mark=2), row(41, 2)]
    for rows in batches:
        for c, n, own, parent, mark, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
            out = rules[c].progress(mark) if n is None else rules[c].block(n, own, parent)
            want += [(c, x[1], x[2]) for x in out if x[0] == "block"]
    got, events = feed(spark, Store(spark, str(tmp_path / "s")), batches, most=None, width=16)
    assert got == sorted(want) and events == [] and len(got) > 60


def test_overflow_stall_and_reorganisation(spark, tmp_path):
    batches = [
        [row(n) for n in (0, 1, 3, 4, 6)] + [row(n, 2) for n in (0, 1, 2)] + [row(at=0), row(chain=2, at=0), row(chain=3, at=0)],
        [row(n) for n in (7, 8, 10)],  # five wait behind 2, four behind 5: 2 is skipped
        [row(3, 2, "fork"), row(4, 2)],
        [row(3, 2, "other"), *[row(chain=c, at=54_999) for c in (1, 2, 3)]],
        [row(chain=c, at=55_000) for c in (1, 2, 3)],
    ]
    got, events = feed(spark, Store(spark, str(tmp_path / "s")), batches, most=4, stall_ms=55_000)
    assert [n for c, n, _ in got if c == 1] == [0, 1, 3, 4] and [n for c, n, _ in got if c == 2] == [0, 1, 2, 3]
    want = [(1, "overflow", None, 2, 2), (1, "refetch", None, 5, 5), (2, "reorg", 3, None, None), (3, "bypass", None, 0, 0)]
    assert events == sorted(want, key=str)


BLOCK, TRANSFER = "number long, hash string, parent_hash string", "block_number long, log_index int"


def test_reorganisation_is_one_commit(spark, tmp_path):
    now = F.timestamp_seconds(F.lit(0))
    store = Store(spark, str(tmp_path / "s"))
    old = [(n, f"h{n}" if n < 250 else f"x{n}", f"h{n - 1}" if n < 251 else f"x{n - 1}") for n in range(1, 400)]
    for k in range(4):
        part = [b for b in old if b[0] // 100 == k]
        sinks.commit_batch(store, k, 5, spark.createDataFrame(part, BLOCK), spark.createDataFrame([(b[0], 0) for b in part], TRANSFER), now)
    before = store.manifest()
    assert [(f.low, f.high) for f in before.folders if f.name == "blocks"] == [(1, 99), (100, 199), (200, 299), (300, 399)]
    right = spark.createDataFrame([(n, f"h{n}", f"h{n - 1}") for n in range(240, 450)], BLOCK)
    assert sinks.reorganise(store, 0, 5, right, BLOCK, TRANSFER, now) == 249
    after = store.manifest()
    assert after.seq == before.seq + 1
    assert {f.path for f in after.folders if f.high and f.high < 200} == {f.path for f in before.folders if f.high and f.high < 200}  # not written anew
    assert store.read("blocks", BLOCK).agg(F.max("number")).head()[0] == store.read("transfers", TRANSFER).agg(F.max("block_number")).head()[0] == 249
    assert [tuple(r)[:2] for r in store.read("checkpoints", sinks.CHECKPOINTS).collect()] == [(5, 249)]
    assert sinks.reorganise(store, 1, 5, right.where("number > 249"), BLOCK, TRANSFER, now) is None
    with pytest.raises(ValueError):
        sinks.reorganise(store, 1, 5, spark.createDataFrame([(200, "y200", "y199"), (201, "y201", "y200")], BLOCK), BLOCK, TRANSFER, now, back=10)
    assert store.manifest() == after


def test_commits_read_only_folders_that_a_batch_meets(spark, tmp_path):
    now, store = F.timestamp_seconds(F.lit(0)), Store(spark, str(tmp_path / "s"))
    rows = lambda a, b: (spark.range(a, b).select(F.col("id").alias("number"), F.lit("h").alias("hash"), F.lit("p").alias("parent_hash")), spark.range(a, b).select(F.col("id").alias("block_number"), F.lit(0).alias("log_index")))
    for k in range(6):
        sinks.commit_batch(store, k, 1, *rows(10 * k, 10 * k + 12), now)  # two rows of each batch come again
        assert len(store.folders("blocks", 10 * k + 10, 10 * k + 22)) <= 1 and len(store.folders("blocks")) == k + 1
    assert store.read("blocks", BLOCK).count() == store.read("blocks", BLOCK).distinct().count() == 62
    assert len(store.read("blocks", BLOCK, 25, 27).inputFiles()) < len(store.read("blocks", BLOCK).inputFiles())
    assert store.compact("blocks", rows=25, most=3) > 0 and len(store.folders("blocks")) == 3
    assert store.read("blocks", BLOCK).count() == 62 and not sinks.commit_batch(store, 5, 1, *rows(0, 5), now)


def test_request_merge_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = spark.range(200).select((F.col("id") % 3).alias("start"), (F.col("id") % 3 + 10).alias("end"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    batch = frontier.request_merge_batch(rows, 60_000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_to_table(frontier.request_merge(stream, 60_000), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert 0 < got.count() < 200


def test_sliding_rate_batch_equals_a_global_window(spark):
    rows = spark.createDataFrame([(t,) for t in (86390, 86394, 86399, 86400, 86401, 86403, 90000)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = {r.second: r.rate for r in jobs.sliding_rate_batch(rows, "ts").collect()}
    seconds = [86390, 86394, 86399, 86400, 86401, 86403, 90000]
    assert got == {s: sum(1 for x in seconds if s - 4 <= x <= s) / 5 for s in seconds}


def test_capture_skips_unusable_lines(spark):
    good = {"ts": 1, "type": "block_data", "data": {"Number": "7", "RangeEnd": 7, "Block": {"a": "1", "b": "2", "c": "3"}, "Logs": [{"address": "0x1", "topics": ["t"], "data": "0x"}]}}
    lines = [
        json.dumps(good), "{not json", json.dumps(good | {"type": "transfer"}), json.dumps(good | {"data": {"Number": None}}),
        json.dumps(good | {"data": good["data"] | {"Block": {"a": "1", "b": "2"}}}), json.dumps(good | {"data": good["data"] | {"Number": 8, "Block": None}}),
    ]
    got = sorted((r.number, len(r.logs)) for r in jobs.parse_capture(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [(7, 1), (8, 1)]


def test_tail_brings_each_block_once(spark, tmp_path):
    head, state, got = str(tmp_path / "head"), str(tmp_path / "state"), []
    blocks = spark.range(1000).select(F.col("id").alias("number"))
    for height in (300, 250, 420, 420, 1000):  # it rises, falls, and stays
        tail.publish_head(spark, head, height)
        tail.follow(tail.tail_ranges(spark, head, start=5, buffer=30, window=tail.window_of(1)), blocks, lambda rows, k: got.append([r.number for r in rows.collect()]), state).awaitTermination()
    assert [(min(x), max(x)) for x in got] == [(5, 280), (281, 400), (401, 980)]
    assert sorted(n for x in got for n in x) == list(range(5, 981)) and tail.window_of(31337) == 100


def test_metric_samples_are_held_up_to_a_bound(spark, tmp_path):
    listener = jobs.MetricListener(str(tmp_path / "samples"), keep=4)
    spark.streams.addListener(listener)
    try:
        spark.range(7).select(F.col("id").alias("number")).write.parquet(str(tmp_path / "in"))
        for k in range(3):
            stream = spark.readStream.schema("number long").parquet(str(tmp_path / "in"))
            jobs.run_to_table(jobs.observed(stream), str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}"))
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert len(listener.samples) < 4 and listener.written
    assert listener.frame(spark).where("metric = 'ingest_rows'").agg(F.sum("value")).head()[0] == 21


def test_halo_and_positions(spark):
    from ledgerlake.operators.neighbors import with_halo, with_position

    rows = spark.createDataFrame([(s, k * k % 97, k) for s in (1, 2) for k in range(50)], "s long, key long, k long")
    got = with_position(rows, "key", "place", by=["s"], ties=["k"], width=10).collect()
    for s in (1, 2):
        assert [r.k for r in sorted((r for r in got if r.s == s), key=lambda r: r.place)] == sorted(range(50), key=lambda k: (k * k % 97, k))
    halo = with_halo(rows, "key", 4, width=10)
    assert halo.where("_own").count() == 100
    assert all(r._part == r.key // 10 + 1 and r.key % 10 >= 6 for r in halo.where("NOT _own").collect())


def test_repeats_after_the_delay_meet_the_store(spark, tmp_path):
    schema = "block_number long, log_index int, arrived_at timestamp"
    batches = [[(1, 0, 0), (1, 0, 0), (2, 0, 0)], [(3, 0, 1), (1, 0, 1)], [(4, 0, 2)], [(1, 0, 3), (2, 0, 3), (None, 0, 3)], [(5, 0, 4), (5, 1, 4)]]
    at = "make_timestamp(2024, 1, 1, hour, 0, 0)"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "block_number long, log_index int, hour int").selectExpr("block_number", "log_index", f"{at} AS arrived_at")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        for f in (tmp_path / "in" / f"part={k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    store = Store(spark, f"{tmp_path}/store")
    jobs.stream_dedup_commit(stream(), store, "arrived_at", "30 minutes", f"{tmp_path}/state").awaitTermination()
    got = [(r.block_number, r.log_index) for r in store.read("transfers", "block_number long, log_index int").where("block_number IS NOT NULL").collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1)]
    only = jobs.run_to_table(jobs.stream_dedup(stream(), "arrived_at", "30 minutes"), f"{tmp_path}/only", f"{tmp_path}/only-state")
    assert only.where("block_number = 1").count() == 2  # the state has forgotten the block by the third hour


def plain_cadence(triggers, most, every):
    """(beat, part, reason, sorted ids) of a writer that looks at one task after another, with the clock of its trigger."""
    out, beat, parts, held = [], 0, 0, []

    def tick(to):
        nonlocal beat, parts, held
        if to > beat:
            if held:
                out.append((beat, parts, "age", sorted(held)))
            beat, parts, held = to, 0, []

    for tasks in triggers:
        for ms, task in sorted(tasks):
            tick(ms // every)
            held.append(task)
            if len(held) == most:
                out.append((beat, parts, "count", sorted(held)))
                parts, held = parts + 1, []
    tick(beat + 1)
    return sorted(out)


def cadence(spark, store):
    rows = store.read("flushed", sinks.FLUSHED).groupBy("beat", "part", "reason").agg(F.sort_array(F.collect_list("task_id")).alias("ids"))
    return sorted((r.beat, r.part, r.reason, r.ids) for r in rows.collect())


def test_cadence_carries_a_started_batch_over_triggers(spark, tmp_path):
    draw, ms, triggers = random.Random(5), 1000, []
    for _ in range(5):
        tasks = []
        for _ in range(draw.choice([1, 9, 14])):
            ms += draw.choice([1, 3, 20, 130])
            tasks.append((ms, len(triggers) * 100 + len(tasks)))
        triggers.append(tasks)
    store, now = Store(spark, str(tmp_path / "s")), F.timestamp_seconds(F.lit(0))
    for k, tasks in enumerate(triggers):
        rows = spark.createDataFrame([(i, i, m) for m, i in tasks], sinks.TASKS)
        args = (store, k, rows, max(m for m, _ in tasks), 1, now)
        assert sinks.commit_due(*args, most=3, every_ms=100)
        assert not sinks.commit_due(*args, most=3, every_ms=100)  # a batch that is tried again
    held = store.read("started", sinks.TASKS).count()
    assert 0 < held < 3
    jobs.drain_cadence(store, 1, now, most=3, every_ms=100)
    want = plain_cadence(triggers, 3, 100)
    assert cadence(spark, store) == want and {r for _, _, r, _ in want} == {"count", "age"}
    assert store.read("started", sinks.TASKS).count() == 0
    assert store.read("checkpoints", sinks.CHECKPOINTS).head().last_synced_block == triggers[-1][-1][1]


def test_cadence_of_late_tasks_and_of_none(spark, tmp_path):
    store, now = Store(spark, str(tmp_path / "s")), F.timestamp_seconds(F.lit(0))
    jobs.drain_cadence(store, 1, now)
    assert cadence(spark, store) == [] and store.read("checkpoints", sinks.CHECKPOINTS).count() == 0
    for k, (clock, rows) in enumerate([(950, [(1, 1, 910), (2, 2, 950)]), (960, [(3, 3, 120)]), (1200, [(4, 4, 1200)])]):
        sinks.commit_due(store, k, spark.createDataFrame(rows, sinks.TASKS), clock, 1, now, most=3, every_ms=100)
    assert cadence(spark, store) == [(9, 0, "count", [1, 2, 3])]  # 3 came when beat 9 was open
    jobs.drain_cadence(store, 1, now, most=3, every_ms=100)
    assert cadence(spark, store)[1:] == [(12, 0, "age", [4])]
