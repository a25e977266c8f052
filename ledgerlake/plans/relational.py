"""Queries of the filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import chain
from ledgerlake.functions.fixed import BOTS
from ledgerlake.operators import relational as R
from ledgerlake.plans.base import query
from ledgerlake.plans.views import NOW, ZERO_HASH, Views



def _now():
    return F.lit(NOW).cast("timestamp")


_DAYS = "60 DAY"  #: the views' transfers are days apart: the windows of hours become days
LAT = "greatest(processed_at_ms / 1000.0 - timestamp, 0)"
_ms = lambda c: F.round(c, 6)


@query("f01_recent_window", "transfers", f"SELECT block_number, log_index, tx_hash, created_at FROM transfers WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 60 DAY")
def f01(v: Views) -> DataFrame:
    return R.recent_window(v.transfers, _now(), _DAYS).select("block_number", "log_index", "tx_hash", "created_at")


@query("f02_last_n_heights", "blocks", "SELECT number, hash FROM blocks WHERE number >= (SELECT max(number) FROM blocks) - 99")
def f02(v):
    return R.last_n_heights(v.blocks, 100).select("number", "hash")


_SENDERS = "SELECT * REPLACE (CASE WHEN block_number % 17 = 0 THEN '0xunknown' WHEN block_number % 19 = 1 THEN '0xDEAD' || substr(from_address, 7) WHEN block_number % 23 = 2 THEN '0x0000' || substr(from_address, 7) ELSE from_address END AS from_address) FROM transfers"


def _odd_senders(v: Views) -> DataFrame:
    n, a = F.col("block_number"), F.col("from_address")
    rest = F.substring(a, 7, 100)
    return v.transfers.withColumn("from_address", F.when(n % 17 == 0, "0xunknown").when(n % 19 == 1, F.concat(F.lit("0xDEAD"), rest)).when(n % 23 == 2, F.concat(F.lit("0x0000"), rest)).otherwise(a))


@query("f03_unknown_sender", "transfers", f"WITH t AS ({_SENDERS}) SELECT block_number, log_index, tx_hash, created_at FROM t WHERE from_address = '0xunknown'")
def f03(v):
    return R.unknown_sender(_odd_senders(v)).select("block_number", "log_index", "tx_hash", "created_at")


@query("f04_synthetic_filter", "transfers", f"WITH t AS ({_SENDERS}) SELECT block_number, log_index, from_address FROM t WHERE lower(from_address) LIKE '0xdead%' OR lower(from_address) LIKE '0x0000%'")
def f04(v):
    t = _odd_senders(v)
    return t.where(R.is_synthetic(F.col("from_address"))).select("block_number", "log_index", "from_address")


_ZEROED = f"SELECT * REPLACE (CASE WHEN number % 41 = 3 THEN '{ZERO_HASH}' ELSE parent_hash END AS parent_hash) FROM blocks"


def zeroed(v: Views) -> DataFrame:
    return v.blocks.withColumn("parent_hash", F.when(F.col("number") % 41 == 3, ZERO_HASH).otherwise(F.col("parent_hash")))


@query("f05_broken_parent", "blocks", f"WITH b AS ({_ZEROED}) SELECT number, hash FROM b WHERE parent_hash = '{ZERO_HASH}' AND number > 0")
def f05(v):
    return R.broken_parent(zeroed(v), ZERO_HASH).select("number", "hash")


_VISITS = """SELECT event_id AS request_id, '10.0.' || (user_id % 7) || '.' || (user_id % 11) || CASE WHEN event_id % 3 = 0 THEN ':' || (1000 + event_id % 50) ELSE '' END AS remote,
  CASE WHEN event_id % 5 = 0 THEN '203.0.113.' || (user_id % 9) || ', 10.0.0.1' WHEN event_id % 5 = 1 THEN ' 198.51.100.' || (user_id % 9) WHEN event_id % 5 = 2 THEN '' WHEN event_id % 97 = 3 THEN '127.0.0.1' END AS forwarded,
  CASE event_type WHEN 'view' THEN 'Mozilla/5.0 (X11)' WHEN 'click' THEN 'Mozilla/5.0 GoogleBot/2.1' WHEN 'error' THEN 'curl/8.0' ELSE 'Mozilla/5.0 (Mac)' END AS agent,
  CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method FROM events"""
_IP = "CASE WHEN coalesce(forwarded, '') <> '' THEN forwarded ELSE remote END"
_CLEAN = f"SELECT *, CASE WHEN regexp_matches(x, '^[^:,]*:[^:,]*$') THEN regexp_extract(x, '^([^:,]*):', 1) ELSE trim(string_split(trim(x), ',')[1]) END AS ip FROM (SELECT *, {_IP} AS x FROM visits)"


def visits(v: Views) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    return v.events.select(
        e.alias("request_id"),
        F.concat(F.lit("10.0."), s(u % 7), F.lit("."), s(u % 11), F.when(e % 3 == 0, F.concat(F.lit(":"), s(1000 + e % 50))).otherwise("")).alias("remote"),
        F.when(e % 5 == 0, F.concat(F.lit("203.0.113."), s(u % 9), F.lit(", 10.0.0.1"))).when(e % 5 == 1, F.concat(F.lit(" 198.51.100."), s(u % 9))).when(e % 5 == 2, "").when(e % 97 == 3, "127.0.0.1").alias("forwarded"),
        F.when(F.col("event_type") == "view", "Mozilla/5.0 (X11)").when(F.col("event_type") == "click", "Mozilla/5.0 GoogleBot/2.1").when(F.col("event_type") == "error", "curl/8.0").otherwise("Mozilla/5.0 (Mac)").alias("agent"),
        F.when(e % 4 == 0, "POST").otherwise("GET").alias("method"),
    )


@query("f06_bot_filter", "", f"WITH visits AS ({_VISITS}), c AS ({_CLEAN}) SELECT request_id, ip, agent FROM c WHERE contains(agent, 'Mozilla') AND NOT regexp_matches(agent, '{BOTS}') AND method = 'GET' AND ip <> '127.0.0.1'")
def f06(v):
    rows = visits(v).withColumn("ip", chain.client_ip(F.col("forwarded"), F.col("remote")))
    return rows.where(chain.is_visit(F.col("agent"), F.col("method"), F.col("ip"))).select("request_id", "ip", "agent")


@query("f07_client_ip", "", f"WITH visits AS ({_VISITS}), c AS ({_CLEAN}) SELECT request_id, ip FROM c")
def f07(v):
    return visits(v).select("request_id", chain.client_ip(F.col("forwarded"), F.col("remote")).alias("ip"))


@query("f08_not_null_guard", "blocks", "SELECT number, CASE WHEN number % 31 <> 4 THEN hash END AS hash FROM blocks WHERE number % 31 <> 4")
def f08(v):
    rows = v.blocks.select("number", F.when(F.col("number") % 31 != 4, F.col("hash")).alias("hash"))
    return rows.where(R.not_null(["number", "hash"]))


@query("j01_inner_minutes", "blocks transfers", "SELECT date_trunc('minute', make_timestamp(b.timestamp * 1000000)) AS minute, count(*) AS transfers FROM transfers t JOIN blocks b ON t.block_number = b.number GROUP BY 1")
def j01(v):
    rows = v.transfers.join(v.blocks, F.col("block_number") == F.col("number"))
    return rows.groupBy(F.date_trunc("minute", F.timestamp_seconds("timestamp")).alias("minute")).agg(F.count("*").alias("transfers"))


@query("j02_transfers_of_blocks", "blocks transfers", f"SELECT b.number, count(t.block_number) AS transfers, round(any_value({LAT}), 6) AS latency, round(any_value({LAT}) * greatest(count(t.block_number), 1), 6) AS weighted FROM blocks b LEFT JOIN transfers t ON t.block_number = b.number GROUP BY b.number")
def j02(v):
    rows = R.with_latency(R.transfers_of_blocks(v.blocks, v.transfers))
    return rows.select("number", "transfers", _ms("latency").alias("latency"), _ms(F.col("latency") * F.greatest("transfers", F.lit(1))).alias("weighted"))


@query("j03_known_parent", "blocks", "SELECT number, hash FROM blocks WHERE parent_hash IN (SELECT hash FROM blocks)")
def j03(v):
    parents = v.blocks.select(F.col("hash").alias("_h"))
    return v.blocks.join(parents, F.col("parent_hash") == F.col("_h"), "left_semi").select("number", "hash")


@query("j04_orphan_blocks", "blocks", "SELECT number, parent_hash FROM blocks WHERE number > 0 AND parent_hash NOT IN (SELECT hash FROM blocks)")
def j04(v):
    parents = v.blocks.where("hash IS NOT NULL").select(F.col("hash").alias("_h"))
    return v.blocks.where("number > 0 AND parent_hash IS NOT NULL").join(parents, F.col("parent_hash") == F.col("_h"), "left_anti").select("number", "parent_hash")


@query("j05_adjacent_blocks", "blocks", "SELECT a.number, b.hash AS prev_hash, a.timestamp - b.timestamp AS seconds FROM blocks a JOIN blocks b ON a.number = b.number + 1")
def j05(v):
    return R.previous_blocks(v.blocks, ["hash", "timestamp"]).select("number", "prev_hash", (F.col("timestamp") - F.col("prev_timestamp")).alias("seconds"))


@query("j06_dimension_lookup", "transfers token_metadata entity_labels", "SELECT block_number, log_index, tx_hash, m.symbol, l.label FROM transfers t LEFT JOIN token_metadata m ON t.token_address = m.address LEFT JOIN entity_labels l ON t.from_address = l.address")
def j06(v):
    m = v.token_metadata.select(F.col("address").alias("token_address"), "symbol")
    x = v.entity_labels.select(F.col("address").alias("from_address"), "label")
    return v.transfers.join(m, "token_address", "left").join(x, "from_address", "left").select("block_number", "log_index", "tx_hash", "symbol", "label")


@query("j07_cross_scalars", "blocks transfers", "SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM transfers) AS transfers")
def j07(v):
    return v.blocks.agg(F.count("*").alias("blocks")).crossJoin(v.transfers.agg(F.count("*").alias("transfers")))


_LOCAL = "SELECT * REPLACE (CASE WHEN number % 113 = 9 THEN '0xbad' || substr(hash, 6) ELSE hash END AS hash) FROM blocks UNION ALL SELECT * REPLACE (number + 1000000000 AS number) FROM blocks WHERE number % 1000 = 1"


def local_blocks(v: Views) -> DataFrame:
    bad = F.when(F.col("number") % 113 == 9, F.concat(F.lit("0xbad"), F.substring("hash", 6, 100))).otherwise(F.col("hash"))
    return v.blocks.withColumn("hash", bad).unionByName(v.blocks.where("number % 1000 = 1").withColumn("number", F.col("number") + 1000000000))


@query("j08_reconciliation", "blocks canonical_blocks", f"WITH l AS ({_LOCAL}) SELECT coalesce(l.number, c.number) AS number, CASE WHEN l.hash IS NULL THEN 'MISSING_LOCAL' WHEN c.hash IS NULL THEN 'MISSING_CANONICAL' WHEN l.hash = c.hash THEN 'MATCH' ELSE 'HASH_MISMATCH' END AS status FROM l FULL JOIN canonical_blocks c ON l.number = c.number")
def j08(v):
    return R.reconcile(local_blocks(v), v.canonical_blocks).select("number", "status")


@query("a01_table_counts", "blocks transfers transactions logs", "SELECT 'blocks' AS table_name, count(*) AS rows FROM blocks UNION ALL SELECT 'transfers', count(*) FROM transfers UNION ALL SELECT 'transactions', count(*) FROM transactions UNION ALL SELECT 'logs', count(*) FROM logs")
def a01(v):
    return R.table_counts({"blocks": v.blocks, "transfers": v.transfers, "transactions": v.transactions, "logs": v.logs})


@query("a02_snapshot_totals", "blocks transfers", "SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM transfers) AS transfers, (SELECT coalesce(min(number), 0) FROM blocks) AS min_height, (SELECT coalesce(max(number), 0) FROM blocks) AS max_height")
def a02(v):
    zero = F.lit(0).cast("long")
    b = v.blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.min("number"), zero).alias("min_height"), F.coalesce(F.max("number"), zero).alias("max_height"))
    return b.crossJoin(v.transfers.agg(F.count("*").alias("transfers")))


@query("a03_distinct_tokens", "transfers", "SELECT count(DISTINCT token_address) AS tokens FROM transfers")
def a03(v):
    return v.transfers.agg(F.countDistinct("token_address").alias("tokens"))


@query("a03_distinct_tokens_approx", "transfers", None)
def a03b(v):
    return v.transfers.agg(F.approx_count_distinct("token_address", 0.02).alias("tokens"))


@query("a04_unique_senders", "transfers", f"SELECT count(DISTINCT from_address) AS senders FROM transfers WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 60 DAY")
def a04(v):
    return R.recent_window(v.transfers, _now(), _DAYS).agg(F.countDistinct("from_address").alias("senders"))


@query("a05_token_stats", "transfers token_metadata", f"SELECT token_address, any_value(m.symbol) AS symbol, count(*) AS transfers, count(DISTINCT from_address) AS senders, max(block_number) AS max_block, max(created_at) AS last_at FROM transfers t LEFT JOIN token_metadata m ON m.address = t.token_address WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 60 DAY GROUP BY token_address")
def a05(v):
    stats = R.token_stats(R.recent_window(v.transfers, _now(), _DAYS))
    return stats.join(v.token_metadata.select(F.col("address").alias("token_address"), "symbol"), "token_address", "left").orderBy(F.desc("transfers"), "token_address")


@query("a06_token_transfer_counts", "transfers", "SELECT token_address, count(*) AS transfers, max(block_number) AS max_block FROM transfers GROUP BY 1 ORDER BY transfers DESC, token_address LIMIT 10")
def a06(v):
    rows = v.transfers.groupBy("token_address").agg(F.count("*").alias("transfers"), F.max("block_number").alias("max_block"))
    return rows.orderBy(F.desc("transfers"), "token_address").limit(10)


@query("a07_token_timeseries", "transfers", "SELECT token_address, date_trunc('week', created_at) AS start, count(*) AS transfers FROM transfers WHERE token_address = '0x' || substr(sha256('tok:3'), 1, 40) GROUP BY 1, 2")
def a07(v):
    from ledgerlake.plans.views import address

    rows = v.transfers.where(F.col("token_address") == address("tok", F.lit(3)))
    week = F.window("created_at", "7 days", "7 days", "4 days")  # from Mondays
    return rows.groupBy("token_address", week.alias("w")).agg(F.count("*").alias("transfers")).select("token_address", F.col("w.start").alias("start"), "transfers")


@query("a08_token_share", "transfers", "SELECT token_address, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM transfers), 2) AS percent FROM transfers GROUP BY 1")
def a08(v):
    return R.share(v.transfers, "token_address")


@query("a09_token_volume", "transfers", "SELECT token_address, sum(amount)::VARCHAR AS volume, count(*) AS n FROM transfers GROUP BY 1")
def a09(v):
    return R.token_volume(v.transfers, "token_address")


@query("a10_activity_type_counts", "transfers", "SELECT activity_type, count(*) AS n FROM transfers GROUP BY 1")
def a10(v):
    return v.transfers.groupBy("activity_type").agg(F.count("*").alias("n"))


@query("a11_gas_leaderboard", "transactions", "WITH g AS (SELECT block_number, coalesce(lower(to_address), '0xcontract_creation') AS receiver, sum(gas)::BIGINT AS gas, sum(gas::HUGEINT * gas_price)::VARCHAR AS fee_wei FROM transactions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block_number ORDER BY gas DESC, receiver) AS place FROM g) SELECT block_number, place, receiver, gas, fee_wei FROM r WHERE place <= 5")
def a11(v):
    return R.gas_leaderboard(v.transactions)


_LAST100 = f"SELECT *, {LAT} AS latency FROM blocks WHERE number >= (SELECT max(number) FROM blocks) - 99"


@query("a12_latency_summary", "blocks", f"WITH b AS ({_LAST100}) SELECT count(*) AS n, round(min(latency), 6) AS least, round(max(latency), 6) AS most, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99 FROM b")
def a12(v):
    rows = R.with_latency(R.last_n_heights(v.blocks, 100))
    p = F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = rows.agg(F.count("*").alias("n"), _ms(F.min("latency")).alias("least"), _ms(F.max("latency")).alias("most"), _ms(F.avg("latency")).alias("mean"), p.alias("p"))
    return rows.select("n", "least", "most", "mean", *[_ms(F.col("p")[k]).alias(f"p{x}") for k, x in enumerate((50, 95, 99))])


@query("a13_latency_by_100", "blocks", f"SELECT number // 100 AS hundred, min(number) AS first, max(number) AS last, count(*) AS n, round(avg({LAT}), 6) AS mean, round(min({LAT}), 6) AS least, round(max({LAT}), 6) AS most FROM blocks WHERE number >= (SELECT max(number) FROM blocks) - 999 GROUP BY 1")
def a13(v):
    rows = R.with_latency(R.last_n_heights(v.blocks, 1000)).groupBy(F.floor(F.col("number") / 100).alias("hundred"))
    return rows.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("n"), _ms(F.avg("latency")).alias("mean"), _ms(F.min("latency")).alias("least"), _ms(F.max("latency")).alias("most"))


@query("a14_write_throughput", "blocks", "SELECT count(*) AS n, (max(processed_at_ms) - min(processed_at_ms)) / 1000.0::DOUBLE AS seconds, round(count(*) / nullif((max(processed_at_ms) - min(processed_at_ms)) / 1000.0::DOUBLE, 0), 6) AS per_second FROM blocks")
def a14(v):
    rows = v.blocks.agg(F.count("*").alias("n"), ((F.max("processed_at_ms") - F.min("processed_at_ms")) / 1000.0).alias("seconds"))
    return rows.withColumn("per_second", _ms(F.try_divide("n", "seconds")))


@query("a15_transfers_per_block", "blocks transfers", "WITH c AS (SELECT block_number, count(*) AS n FROM transfers GROUP BY 1), j AS (SELECT b.number, coalesce(c.n, 0) AS n FROM blocks b LEFT JOIN c ON b.number = c.block_number) SELECT count(*) AS blocks, sum(n)::BIGINT AS transfers, round(sum(n) / count(*), 6) AS mean, (sum(n) // count(*))::BIGINT AS whole_mean FROM j")
def a15(v):
    rows = R.transfers_of_blocks(v.blocks, v.transfers).agg(F.count("*").alias("blocks"), F.sum("transfers").alias("transfers"))
    return rows.select("blocks", "transfers", _ms(F.try_divide("transfers", "blocks")).alias("mean"), F.floor(F.try_divide("transfers", "blocks")).alias("whole_mean"))


@query("a16_avg_latency", "blocks", f"SELECT round(avg({LAT}), 2) AS mean, count(*) FILTER ({LAT} > 1) AS slow FROM blocks")
def a16(v):
    return R.with_latency(v.blocks).agg(F.round(F.avg("latency"), 2).alias("mean"), F.count_if(F.col("latency") > 1).alias("slow"))


@query("a17_latency_per_minute", "blocks", f"WITH b AS (SELECT *, make_timestamp(processed_at_ms * 1000) AS done FROM blocks), r AS (SELECT * FROM b WHERE done > (SELECT max(done) FROM b) - INTERVAL 1 HOUR) SELECT date_trunc('minute', done) AS minute, count(*) AS n, round(avg({LAT}), 6) AS mean, round(max({LAT}), 6) AS most FROM r GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def a17(v):
    rows = R.with_latency(v.blocks).withColumn("at", F.timestamp_millis("processed_at_ms"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("at").alias("_now")))).where(F.col("at") > F.col("_now") - F.expr("INTERVAL 1 HOUR"))
    return rows.groupBy(F.date_trunc("minute", "at").alias("minute")).agg(F.count("*").alias("n"), _ms(F.avg("latency")).alias("mean"), _ms(F.max("latency")).alias("most")).orderBy(F.desc("minute")).limit(20)


@query("a18_blocks_per_minute", "blocks", "SELECT date_trunc('minute', make_timestamp(timestamp * 1000000)) AS minute, count(*) AS n FROM blocks GROUP BY 1")
def a18(v):
    rows = v.blocks.withColumn("at", F.timestamp_seconds("timestamp"))
    return rows.groupBy(F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


@query("a19_duplicates_having", "doubled_blocks", "SELECT number, count(*) AS n FROM doubled_blocks GROUP BY number HAVING count(*) > 1 ORDER BY n DESC, number LIMIT 10")
def a19(v):
    return v.doubled_blocks.groupBy("number").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "number").limit(10)


@query("a20_node_request_stats", "", "SELECT user_id AS node, event_type AS method, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1, 2")
def a20(v):
    rows = v.events.groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("method"))
    return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failures"), _ms(F.avg("value")).alias("mean_ms"), _ms(F.percentile("value", 0.95)).alias("p95_ms"))


@query("a21_db_error_scan", "", "SELECT 'timeout ' || (user_id % 5) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def a21(v):
    failed = F.concat(F.lit('level=error msg=db_fail err="timeout '), (F.col("user_id") % 5).cast("string"), F.lit('" at='), F.col("event_id").cast("string"))
    return R.db_errors(v.events.select(F.when(F.col("event_type") == "error", failed).otherwise(F.lit('level=info msg=ok err="none"')).alias("value")))


@query("a21_foreign_peers", "", "SELECT CASE WHEN user_id % 4 = 0 THEN '127.0.0.' || user_id WHEN user_id % 4 = 1 THEN '192.168.1.' || user_id ELSE '203.0.113.' || user_id END AS peer, count(*) AS n FROM events WHERE event_type <> 'error' AND user_id % 4 > 1 GROUP BY 1")
def a21b(v):
    u = F.col("user_id").cast("string")
    peer = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("127.0.0."), u)).when(F.col("user_id") % 4 == 1, F.concat(F.lit("192.168.1."), u)).otherwise(F.concat(F.lit("203.0.113."), u))
    rows = v.events.select(F.when(F.col("event_type") == "error", "TIME_WAIT").otherwise("ESTABLISHED").alias("state"), F.lit(5432).alias("local_port"), peer.alias("peer"))
    return R.foreign_peers(rows, 5432)


_REQ = "SELECT event_id AS request_id, CASE WHEN (event_id // 2001) % 2 = 0 AND event_id % 20 > 0 THEN '10.9.9.9' ELSE '10.0.0.' || user_id END AS ip FROM events"


@query("a22_admin_ip", "", f"WITH r AS ({_REQ}), c AS (SELECT request_id // 2001 AS window_id, ip, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT window_id, sum(n)::BIGINT AS total FROM c GROUP BY 1) SELECT window_id, ip, n, total FROM c JOIN t USING (window_id) WHERE total >= 100 AND n > 0.9 * total")
def a22(v):
    hot = (F.floor(F.col("event_id") / 2001) % 2 == 0) & (F.col("event_id") % 20 > 0)
    return R.admin_ips(v.events.select(F.col("event_id").alias("request_id"), F.when(hot, "10.9.9.9").otherwise(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("ip")))


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, float("inf")]


@query("a23_histogram_quantile", "", """WITH le AS (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 'inf'::DOUBLE]) AS le),
b AS (SELECT event_type AS series, le, count(*) FILTER (value <= le) AS n FROM events, le GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(n) OVER s, 0) AS before, coalesce(lag(le) OVER s, 0) AS low, max(n) OVER (PARTITION BY series) * 0.95::DOUBLE AS rank FROM b WINDOW s AS (PARTITION BY series ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY le) AS k FROM w WHERE n >= rank)
SELECT series, round(CASE WHEN le = 'inf' THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS value FROM f WHERE k = 1""")
def a23(v):
    flags = [F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(_BOUNDS)]
    wide = v.events.groupBy(F.col("event_type").alias("series")).agg(*flags)
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(_BOUNDS)])
    long = wide.select("series", F.explode(cells).alias("c")).select("series", "c.le", "c.n")
    return R.histogram_quantile(long, 0.95).select("series", _ms("value").alias("value"))


@query("a24_linkage_list", "blocks", "WITH t AS (SELECT * FROM blocks ORDER BY number DESC LIMIT 10), l AS (SELECT *, lead(number) OVER (ORDER BY number DESC) AS pn, lead(hash) OVER (ORDER BY number DESC) AS ph FROM t) SELECT string_agg(number || '→' || pn, ', ' ORDER BY number DESC) FILTER (pn IS NOT NULL) AS links, bool_and(pn IS NULL OR (number = pn + 1 AND parent_hash = ph)) AS passed FROM l")
def a24(v):
    return R.linkage_list(v.blocks)


@query("l01_latest_blocks", "blocks", "SELECT number, hash, timestamp FROM blocks ORDER BY number DESC LIMIT 10")
def l01(v):
    return R.latest(v.blocks.select("number", "hash", "timestamp"), ["number"], 10)


@query("l02_latest_transfers", "transfers", "SELECT block_number, log_index, tx_hash, from_address, to_address, token_address, amount, activity_type, created_at FROM transfers ORDER BY block_number DESC, log_index DESC, tx_hash DESC, from_address DESC, to_address DESC, token_address DESC, amount DESC, activity_type DESC, created_at DESC LIMIT 10")
def l02(v):
    return R.latest(v.transfers, ["block_number", "log_index", *R.ALL_TRANSFER_KEYS], 10)


@query("l03_slowest_blocks", "blocks", f"SELECT number, round({LAT}, 6) AS latency FROM blocks ORDER BY {LAT} DESC, number LIMIT 10")
def l03(v):
    return R.with_latency(v.blocks).orderBy(F.desc("latency"), "number").limit(10).select("number", _ms("latency").alias("latency"))


@query("l04_latency_outliers", "blocks", f"WITH b AS ({_LAST100}) SELECT number, round(latency, 6) AS latency FROM b WHERE latency > 5 ORDER BY latency DESC, number LIMIT 10")
def l04(v):
    rows = R.with_latency(R.last_n_heights(v.blocks, 100)).where("latency > 5")
    return rows.orderBy(F.desc("latency"), "number").limit(10).select("number", _ms("latency").alias("latency"))


@query("l05_hot_view", "transfers", "SELECT block_number, log_index, tx_hash, amount FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, block_number DESC, log_index DESC, tx_hash DESC, from_address DESC, to_address DESC, amount DESC, activity_type DESC) AS k FROM transfers) WHERE k <= 50")
def l05(v):
    hot = R.latest(v.transfers, ["created_at", "block_number", "log_index", "tx_hash", "from_address", "to_address", "amount", "activity_type"], 50000)
    return R.latest(hot, ["created_at", "block_number", "log_index", "tx_hash", "from_address", "to_address", "amount", "activity_type"], 50).select("block_number", "log_index", "tx_hash", "amount")


@query("l06_sorted_batch", "blocks", "SELECT CASE WHEN number % 50 > 0 THEN number END AS number, hash FROM blocks")
def l06(v):
    rows = v.blocks.select(F.when(F.col("number") % 50 > 0, F.col("number")).alias("number"), "hash")
    return rows.orderBy(F.col("number").asc_nulls_first(), "hash")


@query("u01_union_all", "blocks transfers", "SELECT 'blocks' AS table_name, count(*) AS rows FROM blocks UNION ALL SELECT 'transfers', count(*) FROM transfers")
def u01(v):
    return R.table_counts({"blocks": v.blocks, "transfers": v.transfers})


@query("u02_missing_numbers", "blocks", "SELECT unnest(range((SELECT min(number) FROM blocks), (SELECT max(number) FROM blocks) + 1)) AS number EXCEPT SELECT number FROM blocks")
def u02(v):
    return R.missing_numbers(v.blocks)
