"""What keeps jobs within their limits as tables grow."""

from pyspark.sql import functions as F

from ledgerlake.plans import streams
from ledgerlake.plans.views import Views
from ledgerlake.sinks.store import Store
from ledgerlake.streaming import jobs


def test_a_part_is_one_trigger_whatever_tasks_wrote_it(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("block_number"), F.lit(0).alias("log_index"), F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * (F.col("id") % 3)).alias("arrived_at"), (F.col("id") % 3).alias("part"))
    stream = streams._parted(Views(spark, ""), rows, "parted")
    store = Store(spark, f"{tmp_path}/store")
    job = jobs.stream_dedup_commit(stream, store, "arrived_at", "30 minutes", f"{tmp_path}/state")
    job.awaitTermination()
    assert [p.numInputRows for p in job.recentProgress if p.numInputRows] == [1334, 1333, 1333]
    assert store.read("transfers", "block_number long, log_index int").count() == 4000
    assert len(store.folders("transfers")) == 3
    assert any(k.startswith("rocksdb") for k in job.recentProgress[0].stateOperators[0].customMetrics)  # the state isn't held in memory


def test_an_empty_stream_of_parts_ends(spark, tmp_path):
    rows = spark.createDataFrame([], "block_number long, log_index int, arrived_at timestamp, part long")
    store = Store(spark, f"{tmp_path}/store")
    jobs.stream_dedup_commit(streams._parted(Views(spark, ""), rows, "parted"), store, "arrived_at", "30 minutes", f"{tmp_path}/state").awaitTermination()
    assert store.read("transfers", "block_number long, log_index int").count() == 0


def test_sustained_has_no_frame_that_slides(spark):
    from ledgerlake.operators.status import sustained

    rows = spark.range(0, 300).select((F.col("id") % 2).alias("chain_id"), "id", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("id")).alias("ts"), (F.col("id") != 150).alias("ok"))
    rows = rows.unionByName(spark.createDataFrame([(0, 1000, None, True)], "chain_id long, id long, ts timestamp, ok boolean"))
    out = sustained(rows, F.col("ok"), 3600, "alert")
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()  # such a frame looks at all of its rows for each row
    got = {r.id: r.alert for r in out.collect()}
    assert len(got) == 301 and not got[1000]  # a sample without time is neither lost nor an alert
    assert {k for k in range(300) if not got[k]} == set(range(60)) | set(range(150, 211, 2))


def test_transactions_and_log_hashes_are_dealt_once_and_packed(spark):
    from ledgerlake.operators.decode import packed, tx_activities, unpacked

    odd = ["0x", "0xab", "0xAB", "0xabc", "0xab\n", "ab", "", None, "0x" + "0f" * 5000, "0xzz"]
    texts = spark.createDataFrame([(x,) for x in odd], "t string").select("t", packed(F.col("t")).alias("p"))
    assert texts.where(~F.col("t").eqNullSafe(unpacked(F.col("p")))).count() == 0
    assert texts.where("p.bytes IS NOT NULL").count() == 2
    txs = spark.createDataFrame([(1, k, x, f"0xF{k}", "0xb", 1) for k, x in enumerate(odd)] + [(2, 0, "0xab", "0xa", None, 0), (2, 1, "0xcd", "0xa", "0xb", 0), (2, 2, "0xef", "0xC0", "0xb", 0)], "block_number long, tx_index int, tx_hash string, from_address string, to_address string, value long")
    logs = spark.createDataFrame([(1, x, ["t"]) for x in ("0xab", "ab", None, "0xab\n", "0xab")] + [(1, "0xzz", []), (2, "0x", ["t"])], "block_number long, tx_hash string, topics array<string>")
    labels = spark.createDataFrame([("0xc0", "Tap")], "address string, label string")
    out = tx_activities(txs, logs, labels)
    got = [(r.block_number, r.tx_hash, r.log_index, r.activity_type, r.symbol) for r in out.orderBy("block_number", "log_index").collect()]
    kept = [x for x in odd if x not in ("0xab", "ab", "0xab\n")]
    assert got == [(1, x, 20000 + k, "ETH_TRANSFER", "ETH") for k, x in enumerate(kept)] + [(2, "0xab", 20000, "DEPLOY", "EVM"), (2, "0xef", 20001, "FAUCET_CLAIM", "Tap")]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window ") == 2
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_units_are_dealt_while_narrow_and_go_once_read(spark, sf_dir, tmp_path, monkeypatch):
    v = Views(spark, sf_dir)
    dealt = v.by_block()
    units = jobs.units_of(dealt.logs, dealt.transactions)
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and all("orderkey" in x for x in plan.split("Exchange hashpartitioning(")[1:])
    assert units.count() == jobs.units_of(v.logs, v.transactions).count()
    monkeypatch.setattr(streams, "new_folder", lambda _, tag: f"{tmp_path}/{tag}")
    stream = streams._as_they_lie(v, units, "units")
    files = len(list((tmp_path / "units").glob("*.parquet")))
    seen = []
    job = stream.writeStream.foreachBatch(lambda rows, k: seen.append(rows.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sum(seen) == units.count() and len(seen) == min(4, files)
    assert len(list((tmp_path / "units").glob("*.parquet"))) < files


def test_triggers_in_order_do_not_grow_in_number(spark, tmp_path):
    rows = spark.range(0, 2_000_000, 500).select(F.col("id").alias("number"))
    spans = []
    stream = streams._in_order(Views(spark, ""), rows, "ordered")
    job = stream.writeStream.foreachBatch(lambda r, k: spans.append(r.agg(F.min("number"), F.max("number"), F.count("*")).head())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    assert len(spans) == 4 and sum(n for _, _, n in spans) == 4000  # 20 files
    assert all(b[0] > a[1] - 40 for a, b in zip(spans, spans[1:], strict=False))


def test_backlog_is_summed_once(spark, tmp_path):
    from ledgerlake.streaming.frontier import IntervalFrontier

    runs = spark.createDataFrame([(1, 3 * k, 3 * k + 1, None, None) for k in range(10)], "chain_id long, start long, end long, parent string, hash string")
    heads = spark.createDataFrame([(1, 0, None)], "chain_id long, expected long, last_hash string")
    out = IntervalFrontier(Store(spark, f"{tmp_path}/store"), most=8)._reached(runs, heads)
    assert [r.start for r in out.where("done").orderBy("start").collect()] == [3 * k for k in range(6)]  # eight blocks are left behind the gap at 17
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
