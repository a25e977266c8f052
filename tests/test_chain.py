"""Small frames for the rules of decoding, audits and writes."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.fixed import MINT, SWAP, TRANSFER, ZERO_ADDRESS
from ledgerlake.operators import audit, decode, neighbors, status, windows
from ledgerlake.operators import relational as rel
from ledgerlake.sinks import batch
from ledgerlake.sources import tables

A, B = "0x" + "a" * 40, "0x" + "b" * 40


def topic(a):
    return "0x" + a[2:].rjust(64, "0")


def logs(spark, rows):
    return spark.createDataFrame(rows, "block_number long, log_index int, tx_hash string, address string, topics array<string>, data string")


def test_log_activities(spark):
    rows = logs(spark, [
        (1, 0, "t", A, [TRANSFER, topic(A), topic(B)], "0x05"), (1, 1, "t", A, [MINT, topic(B)], "0x"), (1, 2, "t", A.upper(), ["0xother"], "0x01"),
        (1, 3, "t", A, [], "0x"), (1, 4, "t", A, [TRANSFER, topic(A)], "0x1"), (1, 5, "t", A, [SWAP, topic(A), topic(B)], "0x" + "f" * 320),
    ])
    got = {r.log_index: r for r in decode.log_activities(rows).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    assert (got[0].from_address, got[0].to_address, got[0].amount) == (A, B, "5")
    assert (got[1].activity_type, got[1].from_address, got[1].to_address) == ("MINT", ZERO_ADDRESS, B)
    assert (got[2].activity_type, got[2].from_address, got[2].to_address) == ("CONTRACT_EVENT", A, "multiple")
    assert (got[4].from_address, got[4].to_address) == ("", "")
    assert got[5].amount == str(2**256 - 1)


def test_watch_list(spark):
    rows = logs(spark, [(1, 0, "t", A, [TRANSFER], ""), (1, 1, "t", B, [TRANSFER], ""), (1, 2, "t", A, [SWAP], "")])
    assert decode.scan_watched_logs(rows, []).count() == 3
    assert [r.log_index for r in decode.scan_watched_logs(rows, [A.upper().replace("X", "x", 1)]).collect()] == [0]


def test_neighbors_equal_a_global_window(spark):
    numbers = [n for n in range(0, 5000, 3) if not 1000 < n < 2600 and n % 7]
    df = spark.createDataFrame([(n, n * 2) for n in numbers], "number long, x long")
    for ahead in (False, True):
        got = {r.number: r.near and r.near.x for r in neighbors.with_neighbor(df, "number", ["x"], "near", ahead=ahead, width=100).collect()}
        step = 1 if ahead else -1
        want = {n: numbers[i + step] * 2 if 0 <= i + step < len(numbers) else None for i, n in enumerate(numbers)}
        assert got == want
    got = {r.number: r.last for r in neighbors.carried_forward(df, "number", F.when(F.col("number") % 500 == 3, F.col("number")), "last", width=100).collect()}
    last, want = None, {}
    for n in numbers:
        last = n if n % 500 == 3 else last
        want[n] = last
    assert got == want


def test_running_maximum_equals_a_global_window(spark):
    draw = random.Random(8)
    rows = [(s, draw.randrange(4000), draw.choice([None, draw.randrange(1000)])) for s in "abbbb" for _ in range(200)] + [("c", 1, None), ("c", 900, None)]
    df = spark.createDataFrame(rows, "s string, k long, v long")
    got = sorted(tuple(r) for r in neighbors.running_max(df, "k", "v", "top", by=["s"], width=100).select("s", "k", "top").fillna(-1).collect())
    before = lambda s, k: max((v for t, j, v in rows if t == s and j <= k and v is not None), default=-1)
    assert got == sorted((s, k, before(s, k)) for s, k, _ in rows)


def test_gap_list(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 300)], "number long")
    got = sorted(tuple(r) for r in windows.gap_list(df, width=10).collect())
    assert got == [(3, 4, 2), (7, 299, 293)]
    assert windows.gap_flag(df.where("number < 3")).head().verdict == "PASS"
    assert windows.gap_list(df.limit(0)).count() == 0


def test_insert_if_absent_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a")], "number long, hash string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "number long, hash string")
    first = batch.insert_blocks_if_absent(stored, new)
    assert [tuple(r) for r in first.collect()] == [(2, "b")]
    assert batch.insert_blocks_if_absent(stored.unionByName(first), new).count() == 0


def test_commit_is_idempotent_and_monotone(spark, tmp_path):
    store = batch.Store(spark, f"file://{tmp_path}/s")
    b = lambda *n: spark.createDataFrame([(x, "h") for x in n], "number long, hash string")
    t = spark.createDataFrame([(1, 0, "x")], "block_number long, log_index int, tx_hash string")
    now = F.timestamp_seconds(F.lit(0))
    assert batch.commit_batch(store, 0, 5, b(10, 11), t, now)
    assert not batch.commit_batch(store, 0, 5, b(99), t, now)
    assert batch.commit_batch(store, 1, 5, b(3), t, now)
    assert batch.commit_batch(store, 0, 5, b(3), t, now, run="again")  # a stream with a new checkpoint counts from 0
    assert sorted(r.number for r in store.read("blocks", b(1).schema).collect()) == [3, 10, 11]
    assert store.read("transfers", t.schema).count() == 1
    assert [r.last_synced_block for r in store.read("checkpoints", batch.CHECKPOINTS).collect()] == [11]


def test_chain_id_guard(spark):
    rows = spark.createDataFrame([(1,), (2,)], "chain_id long")
    assert audit.chain_id_guard(rows.where("chain_id = 1"), 1).count() == 1
    with pytest.raises(Exception, match="expected chain 1"):
        audit.chain_id_guard(rows, 1).collect()


def test_reorg_skips_local_chains_and_unknown_parents(spark):
    stored = spark.createDataFrame([(5, "0xa")], "number long, hash string")
    incoming = spark.createDataFrame([(6, "0xb", "0xWRONG"), (9, "0xc", "0xd")], "number long, hash string, parent_hash string")
    assert [r.number for r in audit.detect_reorg(incoming, stored, 1).collect()] == [6]
    assert audit.detect_reorg(incoming, stored, 31337).count() == 0


def test_common_ancestor_without_match_is_null(spark):
    a = spark.createDataFrame([(5, "0xA"), (6, "0xB")], "number long, hash string")
    b = spark.createDataFrame([(5, "0xa"), (6, "0xc")], "number long, hash string")
    assert audit.common_ancestor(a, b, 6).head().ancestor == 5
    assert audit.common_ancestor(a.where("number = 6"), b, 6).head().ancestor is None


def test_quality_score_of_clean_chain(spark):
    blocks = spark.createDataFrame([(n, f"h{n}", f"h{n - 1}" if n else "0", 12 * n, 12000 * n) for n in range(5)], "number long, hash string, parent_hash string, timestamp long, processed_at_ms long")
    transfers = spark.createDataFrame([(1, A)], "block_number long, from_address string")
    report = audit.audit_report(blocks, transfers)
    assert tuple(audit.quality_score(report).head()) == (100, "EXCELLENT")


def test_ordered_checks_of_repeated_and_null_numbers(spark):
    rows = [(1, "a", "a", 50_000), (1, "b", "x", 50_000), (None, "c", "x", 50_000), (None, "d", "x", 50_000), (7, "e", "b", 44_000), (12, "f", "f", 39_000), (12, "f", "f", 39_000), (25, None, None, 80_000)]
    blocks = spark.createDataFrame(rows, "number long, hash string, parent_hash string, processed_at_ms long")
    for width in (5, 100_000):  # numbers in several ranges, in one
        got = audit.ordered_checks(blocks, width=width).head()
        assert (got.self_reference, got.timestamp_anomaly, got.duplicate) == (3, 1, 4)  # as count(*) - count(DISTINCT number) has it
    assert audit.duplicate_blocks(blocks).head().issues == 4
    assert tuple(audit.ordered_checks(blocks.limit(0)).head()) == (0, 0, 0)


def test_quota_boundaries(spark):
    df = spark.createDataFrame([(1001, "EXHAUSTED"), (1000, "EXHAUSTED"), (950, "STRICT"), (900, "THROTTLING"), (870, "THROTTLING"), (850, "NORMAL")], "used int, want string")
    assert df.where(windows.guard_mode(F.col("used") / 1000) != F.col("want")).count() == 0


def test_heat_wakes_on_a_spike(spark):
    rows = spark.createDataFrame([(1, k, 0.1) for k in range(60)] + [(1, 60, 50.0)], "chain_id int, k int, tps double")
    last = windows.heat(rows, ["chain_id"], ["k"]).where("k = 60").head()
    assert last.wake and last.pace_ms == 200


def test_ranges_hold_51_numbers(spark):
    spans = spark.createDataFrame([(0, 200, 120), (500, 600, 400)], "start long, end long, head long")
    got = sorted(tuple(r) for r in tables.plan_backfill_ranges(spans).collect())
    assert got == [(0, 50), (51, 101), (102, 120)]


def test_range_folders_prune(spark, tmp_path):
    blocks = spark.range(0, 1000).select(F.col("id").alias("number"), F.lit("h").alias("hash"))
    tables.write_blocks(blocks, str(tmp_path / "b"), size=100)
    got = tables.scan_written_range(spark, str(tmp_path / "b"), 250, 320, size=100)
    assert got.count() == 71
    assert "number_range" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


def test_admin_ip_needs_requests_enough(spark):
    rows = spark.createDataFrame([(k, "a") for k in range(99)], "request_id long, ip string")
    assert rel.admin_ips(rows).count() == 0
    assert rel.admin_ips(rows.unionByName(spark.createDataFrame([(99, "a")], rows.schema))).count() == 1


def test_status_of_unknown_heights(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 0)], "chain_id int, sample_id int, latest long, fetched long, synced long")
    r = status.sync_status(rows).head()
    assert (r.lag, r.fetch_percent, r.sync_percent) == (0, 0.0, 0.0)


def test_no_window_gathers_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("number"), F.lit("h").alias("hash"), F.lit("p").alias("parent_hash"), F.col("id").alias("timestamp"), F.col("id").alias("processed_at_ms"))
    plan = windows.chain_breaks(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
