"""Queries of the integrity jobs and status metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import audit as Q
from ledgerlake.operators import status as M
from ledgerlake.operators import windows as X
from ledgerlake.plans.base import query
from ledgerlake.plans.ledger import counters
from ledgerlake.plans.relational import _LOCAL, _SENDERS, _ZEROED, _odd_senders, local_blocks, zeroed
from ledgerlake.plans.views import NOW, ZERO_HASH

_r = lambda c: F.round(c, 6)
_P = lambda n: f"CASE WHEN {n} = 0 THEN 'PASS' ELSE 'FAIL' END"

_SELF = "SELECT count(*) AS issues FROM blocks WHERE hash = parent_hash"
_BREAK = "SELECT count(*) AS issues FROM blocks a JOIN blocks b ON a.number = b.number + 1 WHERE a.parent_hash <> b.hash"
_TIME = "SELECT count(*) AS issues FROM (SELECT processed_at_ms AS m, lag(processed_at_ms) OVER (ORDER BY number) AS p FROM blocks) WHERE p - m > 5000"
_ORPHAN = "SELECT count(*) AS issues FROM blocks WHERE number > 0 AND parent_hash NOT IN (SELECT hash FROM blocks)"
_DUP = "SELECT count(*) - count(DISTINCT number) AS issues FROM blocks"
_SYN = "SELECT count(*) FILTER (lower(from_address) LIKE '0xdead%' OR lower(from_address) LIKE '0x0000%') AS issues FROM odd"
_REPORT = " UNION ALL ".join(f"SELECT '{n}' AS check_name, issues, {_P('issues')} AS status FROM ({s})" for n, s in (("self_reference", _SELF), ("chain_break", _BREAK), ("timestamp_anomaly", _TIME), ("orphan", _ORPHAN), ("duplicate", _DUP), ("synthetic", _SYN)))
_WORTH = "CASE check_name WHEN 'self_reference' THEN 10 WHEN 'chain_break' THEN 20 WHEN 'timestamp_anomaly' THEN 15 WHEN 'orphan' THEN 20 WHEN 'duplicate' THEN 15 ELSE 20 END"


@query("q01_hash_self_reference", "blocks", "SELECT number, hash FROM blocks WHERE hash = parent_hash")
def q01(v):
    return Q.hash_self_reference(v.blocks)


@query("q02_duplicate_blocks", "doubled_blocks", "SELECT count(*) - count(DISTINCT number) AS issues FROM doubled_blocks")
def q02(v):
    return Q.duplicate_blocks(v.doubled_blocks)


@query("q03_gap_summary", "blocks", "SELECT max(number) - min(number) + 1 - count(DISTINCT number) AS missing, " + _P("max(number) - min(number) + 1 - count(DISTINCT number)") + " AS verdict FROM blocks")
def q03(v):
    return Q.gap_summary(v.blocks)


@query("q04_linked_ratio", "blocks", "WITH r AS (SELECT * FROM blocks WHERE number > (SELECT min(number) FROM blocks)) SELECT count(*) FILTER (parent_hash IN (SELECT hash FROM blocks)) AS linked, count(*) AS total, CASE WHEN count(*) FILTER (parent_hash IN (SELECT hash FROM blocks)) = count(*) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r")
def q04(v):
    return Q.linked_ratio(v.blocks)


@query("q05_synthetic_summary", "transfers", f"WITH odd AS ({_SENDERS}), s AS (SELECT (SELECT issues FROM ({_SYN})) AS synthetic, count(*) AS total FROM odd) SELECT synthetic, total, round(synthetic * 100.0::DOUBLE / total, 2) AS percent, {_P('synthetic')} AS verdict FROM s")
def q05(v):
    return Q.synthetic_summary(_odd_senders(v))


@query("q06_quality_score", "blocks transfers", f"WITH odd AS ({_SENDERS}), r AS ({_REPORT}), s AS (SELECT sum(CASE WHEN issues = 0 THEN {_WORTH} ELSE 0 END)::BIGINT AS score FROM r) SELECT score, CASE WHEN score >= 95 THEN 'EXCELLENT' WHEN score >= 85 THEN 'GOOD' ELSE 'FAIL' END AS grade FROM s")
def q06(v):
    return Q.quality_score(Q.audit_report(v.blocks, _odd_senders(v)))


@query("q07_audit_report", "blocks transfers", f"WITH odd AS ({_SENDERS}) {_REPORT}")
def q07(v):
    return Q.audit_report(v.blocks, _odd_senders(v))


@query("q08_recent_chain_audit", "blocks", "WITH t AS (SELECT * FROM blocks ORDER BY number DESC LIMIT 1000), p AS (SELECT *, lag(number) OVER w AS pn, lag(hash) OVER w AS ph FROM t WINDOW w AS (ORDER BY number)), s AS (SELECT count(*) AS blocks, max(number) AS head, count(*) FILTER (pn IS NOT NULL AND number <> pn + 1) AS sequence_gaps, count(*) FILTER (number = pn + 1 AND parent_hash <> ph) AS broken_links FROM p) SELECT *, CASE WHEN blocks < 2 THEN 'INSUFFICIENT' WHEN sequence_gaps + broken_links = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s")
def q08(v):
    return Q.recent_chain_audit(v.blocks)


_CUT = "SELECT * FROM local WHERE number <= (SELECT max(number) FROM canonical_blocks)"


@query("q09_sample_hash_audit", "blocks canonical_blocks", f"WITH local AS ({_LOCAL}), l AS ({_CUT}), h AS (SELECT (SELECT max(number) FROM l) - 9 * k AS number FROM range(40) r(k)) SELECT h.number, CASE WHEN l.hash IS NULL THEN 'MISSING_LOCAL' WHEN c.hash IS NULL THEN 'MISSING_CANONICAL' WHEN l.hash = c.hash THEN 'MATCH' ELSE 'HASH_MISMATCH' END AS status FROM h LEFT JOIN l USING (number) LEFT JOIN canonical_blocks c USING (number)")
def q09(v):
    top = v.canonical_blocks.agg(F.max("number").alias("_top"))  # one row
    local = local_blocks(v).crossJoin(F.broadcast(top)).where("number <= _top").drop("_top")
    return Q.sample_hash_audit(local, v.canonical_blocks, samples=40, step=9)


@query("q10_repair_parent_hash", "blocks canonical_blocks", f"WITH z AS ({_ZEROED}) SELECT z.number, z.hash, CASE WHEN z.parent_hash = '{ZERO_HASH}' AND z.number > 0 THEN coalesce(c.parent_hash, z.parent_hash) ELSE z.parent_hash END AS parent_hash FROM z LEFT JOIN canonical_blocks c USING (number)")
def q10(v):
    return Q.repair_parent_hash(zeroed(v).select("number", "hash", "parent_hash"), v.canonical_blocks, ZERO_HASH)


@query("q11_detect_reorg", "blocks canonical_blocks", "SELECT i.number, i.parent_hash, s.hash AS stored_hash FROM canonical_blocks i JOIN (SELECT number, CASE WHEN number % 61 = 2 THEN '0xbad' ELSE hash END AS hash FROM blocks) s ON i.number = s.number + 1 WHERE i.parent_hash <> s.hash")
def q11(v):
    stored = v.blocks.withColumn("hash", F.when(F.col("number") % 61 == 2, "0xbad").otherwise(F.col("hash")))
    return Q.detect_reorg(v.canonical_blocks, stored)


@query("q12_common_ancestor", "blocks canonical_blocks", f"WITH local AS ({_LOCAL}) SELECT max(l.number) AS ancestor FROM local l JOIN canonical_blocks c ON l.number = c.number AND l.hash = c.hash WHERE l.number BETWEEN (SELECT max(number) - 1000 FROM canonical_blocks) AND (SELECT max(number) FROM canonical_blocks)")
def q12(v):
    return Q.common_ancestor(local_blocks(v), v.canonical_blocks, v.canonical_blocks.agg(F.max("number")).head()[0])


@query("q13_rollback_reorg", "blocks transfers", "SELECT (SELECT count(*) FROM blocks WHERE number <= 1000) AS blocks, (SELECT count(*) FROM transfers WHERE block_number <= 1000) AS transfers, 1000::BIGINT AS checkpoint")
def q13(v):
    b, t, p = Q.rollback(v.blocks, v.transfers, 1000, 11155111)
    return b.agg(F.count("*").alias("blocks")).crossJoin(t.agg(F.count("*").alias("transfers"))).crossJoin(p.select(F.col("last_synced_block").alias("checkpoint")))


@query("q14_prune_future", "blocks transfers status_samples", "SELECT (SELECT count(*) FROM blocks WHERE number <= 9000) AS blocks, (SELECT count(*) FROM transfers WHERE block_number <= 9000) AS transfers, (SELECT max(least(s, 9000)) FROM (SELECT max(synced) AS s FROM status_samples GROUP BY chain_id)) AS cursor")
def q14(v):
    cursors = v.status_samples.groupBy("chain_id").agg(F.max("synced").alias("last_synced_block"))
    b, t, c = Q.prune_future(v.blocks, v.transfers, cursors, 9000)
    return b.agg(F.count("*").alias("blocks")).crossJoin(t.agg(F.count("*").alias("transfers"))).crossJoin(c.agg(F.max("last_synced_block").alias("cursor")))


@query("q15_cascade_check", "blocks transfers", "SELECT block_number, log_index, tx_hash, amount FROM transfers WHERE block_number NOT IN (SELECT number FROM blocks)")
def q15(v):
    return Q.cascade_check(v.transfers, v.blocks).select("block_number", "log_index", "tx_hash", "amount")


_FAR = "SELECT * REPLACE (CASE WHEN sample_id % 5 = 0 THEN latest + 2000 WHEN sample_id % 5 = 1 THEN latest + 200000 ELSE latest END AS latest) FROM status_samples"


def _far(v):
    k = F.col("sample_id") % 5
    return v.status_samples.withColumn("latest", F.when(k == 0, F.col("latest") + 2000).when(k == 1, F.col("latest") + 200000).otherwise(F.col("latest")))


@query("q16_leap_sync_decision", "status_samples", f"WITH f AS ({_FAR}) SELECT sample_id, CASE WHEN synced > latest THEN 'PRUNE' WHEN latest - synced > 100000 THEN 'RESET_REQUIRED' WHEN latest - synced > 1000 THEN 'LEAP' ELSE 'ALIGNED' END AS action, CASE WHEN synced > latest THEN latest WHEN latest - synced > 1000 THEN latest - 1 ELSE synced END AS cursor FROM f")
def q16(v):
    return Q.leap_sync(_far(v)).select("sample_id", "action", "cursor")


@query("q17_height_snapshot", "status_samples", "SELECT sample_id, greatest(latest - synced, 0) AS lag, greatest(synced - latest, 0) AS drift, greatest(synced - latest, 0) > 5 AS is_time_travel FROM status_samples")
def q17(v):
    return Q.height_snapshot(v.status_samples).select("sample_id", "lag", "drift", "is_time_travel")


@query("q18_checkpoint_consistent", "blocks status_samples", "WITH c AS (SELECT chain_id, max(synced) AS last_synced_block FROM status_samples GROUP BY 1) SELECT chain_id, last_synced_block, max_number, last_synced_block <= max_number AS consistent FROM c, (SELECT max(number) AS max_number FROM blocks)")
def q18(v):
    return Q.checkpoint_consistent(v.status_samples.groupBy("chain_id").agg(F.max("synced").alias("last_synced_block")), v.blocks)


@query("q19_watermark_audit", "status_samples", "SELECT chain_id, sample_id, greatest(fetched, synced) AS fetched, fetched < synced AS inverted, CASE WHEN latest > 0 AND latest < synced THEN 'STALLED' ELSE 'RUNNING' END AS state, synced <= fetched AND fetched <= latest AS ordered FROM status_samples")
def q19(v):
    return Q.watermark_audit(v.status_samples)


@query("q20_tear_detection", "status_samples", f"WITH f AS ({_FAR}) SELECT chain_id, sample_id, latest - 1 AS cursor, synced + 1 AS refetch_from, latest AS refetch_to FROM f WHERE sample_id % 300 * 1000 >= 120000 AND latest - synced > 1000 AND synced + 1 < latest - 1000")
def q20(v):
    rows = _far(v).withColumn("idle_ms", F.col("sample_id") % 300 * 1000).withColumn("expected", F.col("synced") + 1)
    return Q.tear_detection(rows)


_BADT = "SELECT block_number, log_index, CASE WHEN block_number % 29 = 1 THEN substr(tx_hash, 1, 60) ELSE tx_hash END AS tx_hash, CASE WHEN block_number % 31 = 1 THEN 'abc' WHEN block_number % 31 = 2 THEN '0xunknown' ELSE from_address END AS from_address, CASE WHEN block_number % 37 = 1 THEN '0x12' WHEN block_number % 37 = 2 THEN 'multiple' WHEN block_number % 37 = 3 THEN '' ELSE to_address END AS to_address FROM transfers"


@query("q21_transfer_sanity", "transfers", f"WITH b AS ({_BADT}) SELECT block_number, log_index, tx_hash, 'tx_hash' AS field FROM b WHERE block_number % 29 = 1 UNION ALL SELECT block_number, log_index, tx_hash, 'from_address' FROM b WHERE block_number % 31 = 1 UNION ALL SELECT block_number, log_index, tx_hash, 'to_address' FROM b WHERE block_number % 37 = 1")
def q21(v):
    n = F.col("block_number")
    bad = v.transfers.select(
        "block_number", "log_index",
        F.when(n % 29 == 1, F.substring("tx_hash", 1, 60)).otherwise(F.col("tx_hash")).alias("tx_hash"),
        F.when(n % 31 == 1, "abc").when(n % 31 == 2, "0xunknown").otherwise(F.col("from_address")).alias("from_address"),
        F.when(n % 37 == 1, "0x12").when(n % 37 == 2, "multiple").when(n % 37 == 3, "").otherwise(F.col("to_address")).alias("to_address"),
    )
    return Q.transfer_sanity(bad)


@query("q22_constraint_audit", "doubled_blocks transfers", "SELECT 'blocks_not_null' AS constraint_name, 0 AS issues UNION ALL SELECT 'blocks_unique_number', count(*) - count(DISTINCT number) FROM doubled_blocks UNION ALL SELECT 'blocks_unique_hash', count(*) - count(DISTINCT hash) FROM doubled_blocks UNION ALL SELECT 'transfers_not_null', 0 UNION ALL SELECT 'transfers_unique_key', count(*) - count(DISTINCT (block_number, log_index)) FROM transfers UNION ALL SELECT 'transfers_block_exists', count(*) FROM transfers WHERE block_number NOT IN (SELECT number FROM doubled_blocks)")
def q22(v):
    return Q.constraint_audit(v.doubled_blocks, v.transfers)


@query("q23_chain_id_guard", "blocks", "SELECT number, 11155111::BIGINT AS chain_id, 'sepolia' AS network FROM blocks")
def q23(v):
    rows = Q.chain_id_guard(v.blocks.select("number", F.lit(11155111).cast("long").alias("chain_id")), 11155111)
    return rows.withColumn("network", Q.network_name(F.col("chain_id")))


@query("q24_replay_determinism", "transfers", "SELECT count(*) AS n, true AS equal FROM transfers")
def q24(v):
    a = Q.content_digest(v.transfers)
    b = Q.content_digest(v.transfers.repartition(7, "tx_hash")).select(F.col("n").alias("n2"), F.col("content").alias("content2"))
    return a.crossJoin(b).select("n", ((F.col("n") == F.col("n2")) & (F.col("content") == F.col("content2"))).alias("equal"))


_HEAD = "CASE WHEN latest > 0 THEN latest WHEN fetched > 0 THEN fetched ELSE synced END"
_BLANK = "SELECT * REPLACE (CASE WHEN sample_id % 10 < 2 THEN 0 ELSE latest END AS latest, CASE WHEN sample_id % 10 = 0 THEN 0 ELSE fetched END AS fetched) FROM status_samples"


def _blank(v):
    k = F.col("sample_id") % 10
    return v.status_samples.withColumn("latest", F.when(k < 2, 0).otherwise(F.col("latest"))).withColumn("fetched", F.when(k == 0, 0).otherwise(F.col("fetched")))


@query("m01_sync_status_view", "status_samples", f"WITH b AS ({_BLANK}), h AS (SELECT *, {_HEAD} AS head FROM b) SELECT chain_id, sample_id, head, greatest(head - synced, 0) AS lag, head - fetched AS fetch_lag, round(fetched * 100.0::DOUBLE / head, 6) AS fetch_percent, round(synced * 100.0::DOUBLE / head, 6) AS sync_percent FROM h")
def m01(v):
    return M.sync_status(_blank(v)).withColumn("fetch_percent", _r("fetch_percent")).withColumn("sync_percent", _r("sync_percent"))


@query("m02_state_label", "status_samples", f"WITH f AS ({_FAR}), s AS (SELECT chain_id, sample_id, CASE WHEN results_depth > 128 THEN 'pressure_limit' WHEN greatest(latest - synced, 0) > 1000 AND bps < 1 THEN 'stalled' ELSE 'running' END AS state FROM f) SELECT *, state <> 'stalled' AS healthy FROM s")
def m02(v):
    return M.state_label(_far(v))


@query("m03_latest_status_scalars", "status_samples", "SELECT chain_id, arg_max(synced, (ts, sample_id)) AS last_synced_block, arg_max(latest - synced, (ts, sample_id)) AS sync_lag FROM status_samples GROUP BY 1")
def m03(v):
    return M.latest_status(v.status_samples)


@query("m04_latency_text", "status_samples blocks", f"""WITH f AS ({_FAR}), j AS (SELECT f.*, b.processed_at_ms FROM f LEFT JOIN blocks b ON b.number = f.synced),
 s AS (SELECT chain_id, sample_id, latest - synced AS lag, CASE WHEN latest - synced > 100 THEN (latest - synced) * 12.0::DOUBLE ELSE coalesce((1700200000000 - (processed_at_ms - processed_at_ms % 10)) / 1000.0::DOUBLE, (latest - synced) * 12.0::DOUBLE) END AS seconds FROM j)
 SELECT chain_id, sample_id, CASE WHEN lag > 100 THEN 'Catching up... (' || lag || ' blocks behind)' ELSE printf('%.2fs', seconds) END AS latency_text, seconds AS latency_seconds FROM s""")
def m04(v):
    processed = v.blocks.select("number", F.timestamp_millis(F.col("processed_at_ms") - F.col("processed_at_ms") % 10).alias("processed_at"))
    return M.latency_text(_far(v), F.timestamp_millis(F.lit(1700200000000)), processed)


def _rates(v):
    per_hour = X.counter_increase(counters(v), ["series"], "1 hour", 3600)
    return per_hour.select((F.length("series") % 3).cast("long").alias("chain_id"), "series", "start", F.when(F.hour("start") % 6 > 0, F.col("rate")).otherwise(F.lit(0.0)).alias("rate"), (F.length("series") * 100 + F.hour("start") * 7).cast("long").alias("lag"), F.lit(5000).cast("long").alias("head"))


@query("m05_eta_catch_up", "", """WITH c AS (SELECT event_type AS series, ts, event_id AS sample_id, (floor(value * 10) + (event_id % 1000) * 3)::DOUBLE AS value FROM events),
 d AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, sample_id) AS p FROM c)),
 r AS (SELECT length(series) % 3 AS chain_id, date_trunc('hour', ts) AS start, CASE WHEN hour(date_trunc('hour', ts)) % 6 > 0 THEN sum(delta) / 3600.0::DOUBLE ELSE 0 END AS rate, length(series) * 100 + hour(date_trunc('hour', ts)) * 7 AS lag FROM d GROUP BY series, date_trunc('hour', ts))
 SELECT chain_id, start, round(lag * 12.0::DOUBLE / nullif(rate * 60, 0), 6) AS eta_documented, round(lag / nullif(rate, 0), 6) AS eta_seconds, round((5000 - lag) / 50.0::DOUBLE, 6) AS percent, lag < 10 AS real_time FROM r""")
def m05(v):
    out = M.catch_up(_rates(v))
    for c in ("eta_documented", "eta_seconds", "percent"):
        out = out.withColumn(c, _r(c))
    return out


@query("m06_convergence_alert", "status_samples", "WITH s AS (SELECT *, (epoch_us(ts) // 1000) AS ms, (latest - synced >= 3)::INT AS ok FROM status_samples) SELECT sample_id, min(ok) OVER (PARTITION BY chain_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) = 1 AND ms - min(ms) OVER (PARTITION BY chain_id ORDER BY ms) >= 3600000 AS alert FROM s")
def m06(v):
    return M.sustained(v.status_samples, F.col("latest") - F.col("synced") >= 3, 3600, "alert").select("sample_id", "alert")


@query("m07_ingestion_rate", "", "SELECT event_id, coalesce(round(user_id / nullif(event_id % 4, 0)::DOUBLE, 2), 0) AS rate FROM events")
def m07(v):
    return v.events.select("event_id", M.ingestion_rate(F.col("user_id"), F.col("event_id") % 4).alias("rate"))


@query("m08_display_tps", "status_samples", "SELECT sample_id, CASE WHEN latest - synced > 10 THEN 0 ELSE bps END AS display_tps FROM status_samples")
def m08(v):
    return M.display_tps(v.status_samples, F.col("bps")).select("sample_id", "display_tps")


@query("m09_health_rollup", "status_samples", """WITH c AS (SELECT sample_id, 'database' AS component, CASE WHEN sample_id % 50 > 0 THEN 1 END AS value, 1 AS total FROM status_samples UNION ALL SELECT sample_id, 'nodes', sample_id % 4, 3 FROM status_samples UNION ALL SELECT sample_id, 'ordering', sample_id % 700, NULL FROM status_samples),
 s AS (SELECT *, CASE WHEN value IS NULL THEN 'unhealthy' WHEN component = 'nodes' AND value < total THEN 'degraded' WHEN component = 'ordering' AND value > 500 THEN 'degraded' ELSE 'healthy' END AS status FROM c)
 SELECT sample_id, bool_and(status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'unhealthy') AS unhealthy FROM s GROUP BY 1""")
def m09(v):
    e = F.col("sample_id")
    parts = F.array(
        F.struct(F.lit("database").alias("component"), F.when(e % 50 > 0, F.lit(1).cast("long")).alias("value"), F.lit(1).cast("long").alias("total")),
        F.struct(F.lit("nodes").alias("component"), (e % 4).alias("value"), F.lit(3).cast("long").alias("total")),
        F.struct(F.lit("ordering").alias("component"), (e % 700).alias("value"), F.lit(None).cast("long").alias("total")),
    )
    return M.health_rollup(v.status_samples.select("sample_id", F.explode(parts).alias("c")).select("sample_id", "c.*"))


@query("m10_debug_snapshot", "blocks transfers", "WITH b AS (SELECT number FROM blocks ORDER BY number DESC LIMIT 5), t AS (SELECT block_number, log_index FROM transfers ORDER BY block_number DESC, log_index DESC, tx_hash DESC, amount DESC LIMIT 5) SELECT 1000000 - (SELECT max(number) FROM b) AS reality_gap, false AS is_synced, (SELECT string_agg(number, ',' ORDER BY number DESC) FROM b) AS blocks, (SELECT string_agg(block_number || ':' || log_index, ',' ORDER BY block_number DESC, log_index DESC) FROM t) AS transfers")
def m10(v):
    row = M.debug_snapshot(v.blocks, v.transfers, 1000000)
    blocks = F.concat_ws(",", F.transform("blocks", lambda x: x.number.cast("string")))
    transfers = F.concat_ws(",", F.transform("transfers", lambda x: F.concat(x.block_number.cast("string"), F.lit(":"), x.log_index.cast("string"))))
    return row.select("reality_gap", "is_synced", blocks.alias("blocks"), transfers.alias("transfers"))


@query("m11_desync_pulse", "status_samples", "SELECT sample_id, sample_id % 6 = 0 AS desynced, latest + CASE WHEN sample_id % 6 = 0 THEN 4 ELSE 0 END - fetched AS distance FROM status_samples")
def m11(v):
    actual = v.status_samples.select("sample_id", (F.col("latest") + F.when(F.col("sample_id") % 6 == 0, 4).otherwise(0)).alias("head"))
    return M.desync_pulse(v.status_samples, actual)
