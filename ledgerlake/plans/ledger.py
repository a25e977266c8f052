"""Queries of the scans, decode functions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import chain, u256
from ledgerlake.functions.fixed import APPROVAL, FLOW_TOKENS, MINT, SWAP, SYMBOLS, TRANSFER, ZERO_ADDRESS
from ledgerlake.operators import decode as D
from ledgerlake.operators import windows as X
from ledgerlake.plans.base import query
from ledgerlake.plans.views import Views
from ledgerlake.sources import tables as S

_r = lambda c: F.round(c, 6)


@query("s01_scan_block_range", "blocks", "SELECT number, hash FROM blocks WHERE number BETWEEN 100 AND 900")
def s01(v: Views) -> DataFrame:
    return D.scan_block_range(v.blocks, 100, 900).select("number", "hash")


@query("s02_scan_watched_logs", "logs", f"SELECT block_number, log_index, tx_hash, address FROM logs WHERE address IN (SELECT '0x' || substr(sha256('tok:' || k), 1, 40) FROM range(3) r(k)) AND topics[1] = '{TRANSFER}'")
def s02(v):
    from ledgerlake.plans.views import address

    watched = v.spark.range(3).select(address("tok", F.col("id")).alias("address"))
    return D.scan_watched_logs(v.logs, watched).select("block_number", "log_index", "tx_hash", "address")


@query("s05_read_table", "", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s05(v):
    return S.read_table(v.spark, v.sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s06_load_token_dim", "transfers token_metadata", "SELECT t.block_number, t.log_index, m.symbol, m.decimals FROM transfers t JOIN token_metadata m ON lower(m.address) = t.token_address")
def s06(v):
    dim = S.load_token_dim(v.token_metadata)
    return v.transfers.join(dim.withColumnRenamed("address", "token_address"), "token_address").select("block_number", "log_index", "symbol", "decimals")


@query("s08_plan_backfill_ranges", "blocks", "WITH h AS (SELECT max(number) AS head FROM blocks) SELECT s AS range_start, least(s + 50, head) AS range_end FROM h, unnest(range(0, head + 1, 51)) t(s)")
def s08(v):
    return S.plan_backfill_ranges(v.blocks.agg(F.lit(0).cast("long").alias("start"), F.max("number").alias("end"), F.max("number").alias("head")))


@query("s09_parent_anchor", "blocks canonical_blocks", "WITH b AS (SELECT number, hash FROM blocks WHERE number >= 14) SELECT * FROM b UNION ALL SELECT number, hash FROM canonical_blocks WHERE number = 13")
def s09(v):
    b = v.blocks.where("number >= 14").select("number", "hash")
    return S.parent_anchor(b, v.canonical_blocks.select("number", "hash"), 14)


_KIND = f"CASE topics[1] WHEN '{TRANSFER}' THEN 'TRANSFER' WHEN '{SWAP}' THEN 'SWAP' WHEN '{APPROVAL}' THEN 'APPROVE' WHEN '{MINT}' THEN 'MINT' ELSE 'CONTRACT_EVENT' END"
_T = lambda k: f"'0x' || lower(right(topics[{k}], 40))"
_FROM = f"CASE k WHEN 'MINT' THEN '{ZERO_ADDRESS}' WHEN 'CONTRACT_EVENT' THEN lower(address) ELSE {_T(2)} END"
_TO = f"CASE k WHEN 'MINT' THEN {_T(2)} WHEN 'CONTRACT_EVENT' THEN 'multiple' ELSE {_T(3)} END"


@query("c01_classify_log", "logs", f"SELECT block_number, log_index, tx_hash, {_KIND} AS activity_type FROM logs")
def c01(v):
    return v.logs.select("block_number", "log_index", "tx_hash", chain.classify_log(F.col("topics")).alias("activity_type"))


@query("c02_topic_address", "logs", f"WITH c AS (SELECT *, {_KIND} AS k FROM logs) SELECT block_number, log_index, tx_hash, {_FROM} AS from_address, {_TO} AS to_address FROM c")
def c02(v):
    t = F.col("topics")
    return v.logs.select("block_number", "log_index", "tx_hash", chain.log_sender(t, F.col("address")).alias("from_address"), chain.log_receiver(t).alias("to_address"))


@query("c03_decode_uint256", "logs", "SELECT block_number, log_index, tx_hash, ('0x' || ltrim(substr(data, 3), '0'))::BIGINT::VARCHAR AS amount FROM logs")
def c03(v):
    return v.logs.select("block_number", "log_index", "tx_hash", chain.uint256_text(F.col("data")).alias("amount"))


@query("c03_decode_uint256_wide", "blocks")
def c03b(v):
    return v.blocks.select("number", u256.to_text(chain.decode_uint256(F.col("hash"))).alias("amount"))


@query("c04_abi_words", "logs", "SELECT block_number, log_index, tx_hash, substr(data, 3, 64) AS word1, '0' || substr(data, 4, 63) AS word2, 2 AS n FROM logs")
def c04(v):
    two = F.concat(F.col("data"), F.lit("0"), F.substring("data", 4, 63), F.lit("ffff"))
    w = chain.abi_words(two)
    return v.logs.select("block_number", "log_index", "tx_hash", w[0].alias("word1"), w[1].alias("word2"), F.size(w).alias("n"))


@query("c05_parse_numeric", "", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN event_id || '000' WHEN 3 THEN event_id || '500' END AS value,
 CASE event_id % 6 WHEN 4 THEN 'not a whole number' WHEN 5 THEN 'empty' END AS error FROM events""")
def c05(v):
    e = F.col("event_id")
    s = e.cast("string")
    k = e % 6
    text = (
        F.when(k == 0, s).when(k == 1, F.concat(F.lit("0x"), F.hex(e))).when(k == 2, F.concat(s, F.lit("e3")))
        .when(k == 3, F.concat(s, F.lit(".5E+3"))).when(k == 4, F.concat(s, F.lit(".5e0"))).otherwise("")
    )
    return v.events.select("event_id", chain.parse_numeric(text).alias("p")).select("event_id", "p.value", "p.error")


@query("c06_normalize_address", "transactions", "SELECT block_number, tx_index, CASE WHEN block_number % 7 = 0 THEN '0xunknown' ELSE from_address END AS sender, coalesce(to_address, '0xcontract_creation') AS receiver FROM transactions")
def c06(v):
    s = F.when(F.col("block_number") % 7 != 0, F.upper("from_address"))
    return v.transactions.select("block_number", "tx_index", chain.normalize_sender(s).alias("sender"), chain.normalize_receiver(F.upper("to_address")).alias("receiver"))


@query("c07_label_entity", "transfers entity_labels", "SELECT block_number, log_index, tx_hash, CASE WHEN label IS NULL THEN activity_type ELSE 'FAUCET_CLAIM' END AS activity_type, label AS symbol FROM transfers LEFT JOIN entity_labels ON from_address = address")
def c07(v):
    return D.label_entity(v.transfers, v.entity_labels).select("block_number", "log_index", "tx_hash", "activity_type", "symbol")


_STATIC = "CASE lower(token_address) " + " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in SYMBOLS.items()) + " END"
_SYM = f"coalesce(nullif(label, ''), {_STATIC}, nullif(symbol, ''), substr(token_address, 1, 10) || '...')"
_MIXED = f"SELECT * REPLACE (CASE WHEN block_number % 13 = 0 THEN '{ZERO_ADDRESS}' WHEN block_number % 13 = 1 THEN '0x1c7d4b196cb0c7b01d743fbc6116a902379c7238' ELSE token_address END AS token_address) FROM transfers"


def _mixed(v: Views) -> DataFrame:
    n = F.col("block_number") % 13
    return v.transfers.withColumn("token_address", F.when(n == 0, ZERO_ADDRESS).when(n == 1, "0x1c7d4b196cb0c7b01d743fbc6116a902379c7238").otherwise(F.col("token_address")))


@query("c08_resolve_symbol", "transfers entity_labels token_metadata", f"WITH t AS ({_MIXED}) SELECT block_number, log_index, tx_hash, {_SYM} AS symbol FROM t LEFT JOIN entity_labels l ON from_address = l.address LEFT JOIN token_metadata m ON token_address = m.address")
def c08(v):
    return D.resolve_symbol(D.label_entity(_mixed(v), v.entity_labels), v.token_metadata).select("block_number", "log_index", "tx_hash", "symbol")


@query("c09_resolve_decimals", "transfers token_metadata", f"WITH t AS ({_MIXED}) SELECT block_number, log_index, tx_hash, coalesce(decimals, 18)::INTEGER AS decimals FROM t LEFT JOIN token_metadata m ON token_address = m.address")
def c09(v):
    return D.resolve_decimals(_mixed(v), v.token_metadata).select("block_number", "log_index", "tx_hash", "decimals")


_TXA = f"""SELECT block_number, tx_hash, (19999 + row_number() OVER (PARTITION BY block_number ORDER BY tx_index))::INTEGER AS log_index, lower(from_address) AS from_address,
 coalesce(to_address, '0xcontract_creation') AS to_address, value::VARCHAR AS amount, '{ZERO_ADDRESS}' AS token_address, kind AS activity_type, CASE kind WHEN 'FAUCET_CLAIM' THEN label WHEN 'DEPLOY' THEN 'EVM' ELSE 'ETH' END AS symbol
 FROM (SELECT x.*, l.label, CASE WHEN l.label IS NOT NULL THEN 'FAUCET_CLAIM' WHEN to_address IS NULL THEN 'DEPLOY' WHEN value > 0 AND NOT EXISTS (SELECT 1 FROM logs g WHERE g.block_number = x.block_number AND g.tx_hash = x.tx_hash) THEN 'ETH_TRANSFER' END AS kind
 FROM transactions x LEFT JOIN entity_labels l ON x.from_address = l.address) WHERE kind IS NOT NULL"""
_ACT = ["block_number", "tx_hash", "log_index", "from_address", "to_address", "amount", "token_address", "activity_type", "symbol"]


@query("c10_tx_activities", "transactions logs entity_labels", f"SELECT block_number, tx_hash, from_address, to_address, amount, activity_type, symbol FROM ({_TXA})")
def c10(v):
    return D.tx_activities(v.transactions, v.logs, v.entity_labels).select("block_number", "tx_hash", "from_address", "to_address", "amount", "activity_type", "symbol")


@query("c11_synthetic_log_index", "transactions logs entity_labels", f"SELECT block_number, tx_hash, log_index FROM ({_TXA})")
def c11(v):
    return D.tx_activities(v.transactions, v.logs, v.entity_labels).select("block_number", "tx_hash", "log_index")


_FEE = "CASE WHEN b.number % 10 > 0 THEN 1000000000 + b.number END"


def headers(v: Views) -> DataFrame:
    txs = v.transactions.groupBy(F.col("block_number").alias("number")).agg(F.collect_list("tx_hash").alias("transactions"))
    rows = v.canonical_blocks.join(txs, "number", "left").withColumn("transactions", F.coalesce("transactions", F.array().cast("array<string>")))
    return rows.withColumn("base_fee_per_gas", F.when(F.col("number") % 10 > 0, 1000000000 + F.col("number")))


@query("c12_block_projection", "canonical_blocks transactions", f"SELECT b.number, hash, parent_hash, timestamp, gas_limit, gas_used, ({_FEE})::VARCHAR AS base_fee_per_gas, count(x.tx_hash)::INTEGER AS transaction_count FROM canonical_blocks b LEFT JOIN transactions x ON x.block_number = b.number GROUP BY ALL")
def c12(v):
    return D.block_projection(headers(v)).withColumn("base_fee_per_gas", F.col("base_fee_per_gas").cast("string"))


_LOGA = f"""SELECT block_number, tx_hash, log_index, from_address, to_address, amount, token_address, CASE WHEN l.label IS NULL THEN k ELSE 'FAUCET_CLAIM' END AS activity_type,
 coalesce(nullif(l.label, ''), {_STATIC}, nullif(m.symbol, ''), substr(token_address, 1, 10) || '...') AS symbol FROM (SELECT block_number, tx_hash, log_index, {_FROM} AS from_address, {_TO} AS to_address,
 ('0x' || ltrim(substr(data, 3), '0'))::BIGINT::VARCHAR AS amount, address AS token_address, k FROM (SELECT *, {_KIND} AS k FROM logs)) a LEFT JOIN entity_labels l ON a.from_address = l.address LEFT JOIN token_metadata m ON a.token_address = m.address"""


@query("c13_block_activities", "transactions logs entity_labels token_metadata", f"SELECT {', '.join(_ACT)} FROM ({_LOGA}) UNION ALL SELECT {', '.join(_ACT)} FROM ({_TXA})")
def c13(v):
    return D.block_activities(v.logs, v.transactions, v.entity_labels, v.token_metadata).select(*_ACT)


@query("c14_densify_range", "logs", "WITH g AS (SELECT block_number, count(*) AS n, min(log_index) AS first_index FROM logs GROUP BY 1) SELECT number, coalesce(n, 0) AS n, first_index FROM range((SELECT min(block_number) FROM logs), (SELECT max(block_number) + 1 FROM logs)) r(number) LEFT JOIN g ON g.block_number = number")
def c14(v):
    low, high = v.logs.agg(F.min("block_number"), F.max("block_number")).head()
    rows = D.densify_range(v.logs.select("block_number", "log_index", "tx_hash", "address"), low, high)
    return rows.select("number", F.size("logs").cast("long").alias("n"), F.try_element_at("logs", F.lit(1)).getField("log_index").alias("first_index"))


@query("c15_format_amount", "transfers token_metadata", """WITH a AS (SELECT block_number, log_index, tx_hash, CASE WHEN block_number % 9 = 0 THEN '0' WHEN block_number % 9 = 1 THEN amount || '00000000000000000000' ELSE amount::VARCHAR END AS amount, coalesce(decimals, 18) AS d FROM transfers t LEFT JOIN token_metadata m ON m.address = t.token_address),
 p AS (SELECT *, lpad(amount, greatest(length(amount), d + 1)::INTEGER, '0') AS s FROM a), w AS (SELECT *, substr(s, 1, length(s) - d) AS whole, substr(right(s, d) || '0000', 1, 4) AS places FROM p)
 SELECT block_number, log_index, tx_hash, CASE WHEN amount = '0' THEN '0.0000' ELSE CASE WHEN length(whole) > 12 THEN substr(whole, 1, 6) || '...' || right(whole, 3) ELSE whole END || '.' || places END AS shown FROM w""")
def c15(v):
    n = F.col("block_number") % 9
    t = D.resolve_decimals(v.transfers, v.token_metadata)
    amount = F.when(n == 0, "0").when(n == 1, F.concat(F.col("amount").cast("string"), F.lit("0" * 20))).otherwise(F.col("amount").cast("string"))
    return t.select("block_number", "log_index", "tx_hash", chain.format_amount(amount, F.col("decimals")).alias("shown"))


@query("c16_short_hash", "blocks", "SELECT number, substr(hash, 1, 8) AS h8, substr(hash, 1, 10) || '...' AS h10, substr(hash, 1, 16) AS h16 FROM blocks")
def c16(v):
    h = F.col("hash")
    return v.blocks.select("number", chain.short_hash(h, 8).alias("h8"), chain.short_hash(h, 10, True).alias("h10"), chain.short_hash(h, 16).alias("h16"))


@query("c17_format_ts", "blocks", "SELECT number, strftime(make_timestamp(processed_at_ms * 1000), '%H:%M:%S') AS clock, strftime(make_timestamp(processed_at_ms * 1000), '%Y-%m-%d %H:%M:%S') AS day FROM blocks")
def c17(v):
    at = F.timestamp_millis("processed_at_ms")
    return v.blocks.select("number", F.date_format(at, "HH:mm:ss").alias("clock"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("day"))


_FLOWS = "SELECT block_number, log_index, tx_hash, CASE block_number % 5 WHEN 0 THEN '0x742d' WHEN 1 THEN '0x8787' WHEN 2 THEN '0xE592' ELSE substr(from_address, 1, 6) END || substr(from_address, 7) AS f, CASE block_number % 7 WHEN 3 THEN '0xe592' || substr(to_address, 7) ELSE to_address END AS t, CASE block_number % 11 WHEN 0 THEN '0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48' ELSE token_address END AS k FROM transfers"


@query("c18_tag_flow", "transfers", f"WITH x AS ({_FLOWS}) SELECT block_number, log_index, tx_hash, CASE WHEN lower(f) LIKE '0x742d%' THEN 'MEV Bot' WHEN lower(f) LIKE '0x8787%' THEN 'Flashloan' WHEN lower(f) LIKE '0xe592%' OR lower(t) LIKE '0xe592%' THEN 'Swap' ELSE 'User' END AS tag, CASE lower(k) " + " ".join(f"WHEN '{a.lower()}' THEN '{s}'" for a, s in FLOW_TOKENS.items()) + " ELSE 'Unknown' END AS token FROM x")
def c18(v):
    n, f, t = F.col("block_number"), F.col("from_address"), F.col("to_address")
    head = F.when(n % 5 == 0, "0x742d").when(n % 5 == 1, "0x8787").when(n % 5 == 2, "0xE592").otherwise(F.substring(f, 1, 6))
    sender = F.concat(head, F.substring(f, 7, 100))
    receiver = F.when(n % 7 == 3, F.concat(F.lit("0xe592"), F.substring(t, 7, 100))).otherwise(t)
    token = F.when(n % 11 == 0, "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48").otherwise(F.col("token_address"))
    return v.transfers.select("block_number", "log_index", "tx_hash", chain.tag_flow(sender, receiver).alias("tag"), chain.flow_token(token).alias("token"))


@query("c19_json_metadata", "", "SELECT event_id, '/' || event_type AS path FROM events")
def c19(v):
    rows = v.events.select("event_id", chain.visit_metadata(F.concat(F.lit("/"), F.col("event_type"))).alias("metadata"))
    return rows.where(F.get_json_object("metadata", "$.recorded_v") == "v1").select("event_id", F.get_json_object("metadata", "$.path").alias("path"))


@query("c20_safe_diff", "", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id - event_id WHEN 1 THEN 9223372036854775807 ELSE (-9223372036854775807)::BIGINT - 1 END AS diff FROM events")
def c20(v):
    e, big = F.col("event_id"), F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    a = F.when(e % 3 == 0, F.col("user_id").cast("decimal(20,0)")).when(e % 3 == 1, big).otherwise(F.lit(0).cast("decimal(20,0)"))
    b = F.when(e % 3 == 0, e.cast("decimal(20,0)")).when(e % 3 == 1, F.lit(0).cast("decimal(20,0)")).otherwise(big)
    return v.events.select("event_id", chain.safe_diff(a, b).alias("diff"))


@query("c21_epoch_latency", "blocks", "SELECT number, round(greatest(processed_at_ms / 1000.0 - timestamp, 0), 6)::DOUBLE AS latency FROM blocks")
def c21(v):
    return v.blocks.select("number", _r(chain.epoch_latency(F.col("processed_at_ms"), F.col("timestamp"))).alias("latency"))


_LEAD = "SELECT number, lead(number) OVER (ORDER BY number) AS next FROM blocks"


@query("w01_gap_list", "blocks", f"SELECT number + 1 AS gap_start, next - 1 AS gap_end, next - number - 1 AS gap_size FROM ({_LEAD}) WHERE next - number > 1")
def w01(v):
    return X.gap_list(v.blocks)


@query("w02_gap_flag", "blocks", f"SELECT count(*) FILTER (next <> number + 1) AS gaps, CASE WHEN count(*) FILTER (next <> number + 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_LEAD})")
def w02(v):
    return X.gap_flag(v.blocks)


@query("w03_chain_break", "blocks", "WITH p AS (SELECT number, parent_hash, lag(hash) OVER w AS prev_hash, lag(number) OVER w AS pn FROM blocks WINDOW w AS (ORDER BY number)) SELECT number, parent_hash, prev_hash FROM p WHERE pn = number - 1 AND parent_hash <> prev_hash")
def w03(v):
    return X.chain_breaks(v.blocks)


@query("w04_timestamp_anomaly", "blocks", "WITH p AS (SELECT number, processed_at_ms, lag(processed_at_ms) OVER w AS pm, lag(number) OVER w AS prev_number FROM blocks WINDOW w AS (ORDER BY number)) SELECT number, prev_number, round((pm - processed_at_ms) / 1000.0::DOUBLE, 6) AS seconds_early FROM p WHERE pm - processed_at_ms > 5000")
def w04(v):
    return X.timestamp_anomalies(v.blocks, width=1000).withColumn("seconds_early", _r("seconds_early"))


_SAME = "SELECT number, CASE WHEN number % 10 = 4 THEN timestamp - 12 ELSE timestamp END AS timestamp, transaction_count FROM canonical_blocks"


@query("w05_chain_tps", "canonical_blocks", f"WITH b AS ({_SAME}), p AS (SELECT *, lag(timestamp) OVER (ORDER BY number) AS pt FROM b), o AS (SELECT *, CASE WHEN pt IS NULL THEN 0.0::DOUBLE WHEN timestamp <> pt THEN round(transaction_count / (timestamp - pt)::DOUBLE, 2) END AS own FROM p) SELECT number, last_value(own IGNORE NULLS) OVER (ORDER BY number) AS tps FROM o")
def w05(v):
    b = v.canonical_blocks.withColumn("timestamp", F.when(F.col("number") % 10 == 4, F.col("timestamp") - 12).otherwise(F.col("timestamp")))
    return X.chain_tps(b, width=1000)


@query("w06_heat", "", """WITH m AS (SELECT user_id, event_id, value / 20 AS tps, avg(value / 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING) AS mean, coalesce(avg(value / 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0) AS before FROM events),
 n AS (SELECT *, CASE WHEN tps > 2 * mean THEN tps ELSE mean END AS now FROM m)
 SELECT user_id, event_id, round(mean, 9) AS mean, round(least(mean / 5 * 100, 100), 9) AS heat, tps > 2 * before OR tps > 2 AS wake, CASE WHEN now >= 5 THEN 200 WHEN now >= 2 THEN 1000 WHEN now >= 0.5 THEN 5000 ELSE 30000 END AS pace_ms FROM n""")
def w06(v):
    rows = X.heat(v.events.withColumn("tps", F.col("value") / 20), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", F.round("mean", 9).alias("mean"), F.round("heat", 9).alias("heat"), "wake", "pace_ms")


def requests(v: Views) -> DataFrame:
    return v.events.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("node"), "ts")


_RQ = "SELECT event_id AS request_id, user_id % 5 AS node, ts FROM events"


@query("w07_quota_mode_sliding", "", f"WITH r AS ({_RQ}), u AS (SELECT request_id, node, count(*) OVER (PARTITION BY node ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS used FROM r), f AS (SELECT *, used / 6.0::DOUBLE AS fraction FROM u) SELECT request_id, node, used, round(fraction, 6) AS fraction, CASE WHEN fraction >= 0.8 THEN 'Eco' WHEN fraction >= 0.5 THEN 'Balanced' ELSE 'Aggressive' END AS mode, round(CASE WHEN fraction >= 0.8 THEN 0.1 WHEN fraction >= 0.5 THEN 1 - (fraction - 0.5) / 0.3 * 0.9 ELSE 1 END * 15, 6)::DOUBLE AS rate FROM f")
def w07(v):
    rows = X.quota_sliding(requests(v), 6, 3600)
    return rows.withColumn("fraction", _r("fraction")).withColumn("rate", _r("rate"))


_USED = f"SELECT *, row_number() OVER (PARTITION BY node, ts::DATE ORDER BY ts, request_id) AS used FROM ({_RQ})"


@query("w08_quota_daily", "", f"SELECT request_id, node, used::INTEGER AS used, CASE WHEN used / 70.0 >= 0.9 THEN 2 WHEN used / 70.0 >= 0.8 THEN 1 ELSE 0 END AS status FROM ({_USED})")
def w08(v):
    return X.quota_daily(requests(v), 70)


@query("w09_quota_guard_mode", "", f"SELECT node, ts::DATE AS day, CASE WHEN used / 60.0 >= 1 THEN 'EXHAUSTED' WHEN used / 60.0 > 0.9 THEN 'STRICT' WHEN used / 60.0 > 0.85 THEN 'THROTTLING' ELSE 'NORMAL' END AS mode, count(*) AS requests, count(*) FILTER (used >= 60) AS denied FROM ({_USED}) GROUP BY ALL")
def w09(v):
    return X.quota_guard(requests(v), 60)


def counters(v: Views) -> DataFrame:
    value = F.floor(F.col("value") * 10) + (F.col("event_id") % 1000) * 3
    return v.events.select(F.col("event_type").alias("series"), "ts", F.col("event_id").alias("sample_id"), value.cast("double").alias("value"))


_CN = "SELECT event_type AS series, ts, event_id AS sample_id, (floor(value * 10) + (event_id % 1000) * 3)::DOUBLE AS value FROM events"
_DELTA = f"SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, sample_id) AS p FROM ({_CN}))"


@query("w10_counter_rate", "", f"SELECT series, date_trunc('hour', ts) AS start, sum(delta)::DOUBLE AS increase, round(sum(delta) / 3600, 6)::DOUBLE AS rate FROM ({_DELTA}) GROUP BY ALL")
def w10(v):
    return X.counter_increase(counters(v), ["series"], "1 hour", 3600).withColumn("rate", _r("rate"))


@query("w11_over_time", "", f"SELECT series, date_trunc('hour', ts) AS start, round(avg(value), 6) AS mean, arg_max(value, (ts, sample_id)) AS last FROM ({_CN}) GROUP BY ALL")
def w11(v):
    return X.over_time(counters(v), ["series"], "1 hour").withColumn("mean", _r("mean"))


@query("w12_two_second_rate", "", "WITH c AS (SELECT user_id AS series, event_id AS tick, event_id * 3 AS value FROM events) SELECT series, tick, value, coalesce((value - lag(value) OVER (PARTITION BY series ORDER BY tick)) // 2, 0)::BIGINT AS rate FROM c")
def w12(v):
    return X.two_second_rate(v.events.select(F.col("user_id").alias("series"), F.col("event_id").alias("tick"), (F.col("event_id") * 3).alias("value")), ["series"])


@query("w13_sync_speed", "status_samples", "SELECT chain_id, sample_id, round((synced - lag(synced) OVER w) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0), 6) AS speed FROM status_samples WINDOW w AS (PARTITION BY chain_id ORDER BY ts, sample_id)")
def w13(v):
    return X.sync_speed(v.status_samples, ["chain_id"]).withColumn("speed", _r("speed"))
