"""Chain-shaped views of the star-schema tables: what the queries read, as DataFrames and as the same SQL for a comparison.

orders stand for blocks and transactions, lineitem for logs and transfers, events for requests and metric samples. Faults
(self references, broken links, gaps, late processing, repeated keys) come from arithmetic on the keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.fixed import APPROVAL, MINT, SWAP, TRANSFER

ZERO_HASH = "0x" + "0" * 64
NOW = "2001-11-05 00:00:00"  #: the views' present for windows over created_at


def h(*parts: Column | str) -> Column:
    """SHA-256 of the joined parts, as lower-case hex."""
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def address(kind: str, key: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(h(f"{kind}:", key), 1, 40))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def by_block(self) -> Views:
        """The same views over orders and lineitem that are dealt by their block first, while their rows are narrow."""
        return _ByBlock(self.spark, self.sf_dir)

    def _blocks(self, faults: bool) -> DataFrame:
        n = F.col("number")
        rows = self.table("orders").select(F.col("o_orderkey").alias("number"))
        if faults:
            rows = rows.where(n % 97 != 13)
        own, parent = F.concat(F.lit("0x"), h("blk:", n)), F.concat(F.lit("0x"), h("blk:", n - 1))
        linked = F.when(n == 0, F.lit(ZERO_HASH))
        if faults:
            linked = linked.when(n % 211 == 5, own).when(n % 101 == 7, F.concat(F.lit("0x"), h("fork:", n - 1)))
        time = 1700000000 + 12 * n
        late = F.when(n % 307 == 11, 30000).otherwise(0) if faults else F.lit(0)
        return rows.select(
            "number",
            own.alias("hash"),
            linked.otherwise(parent).alias("parent_hash"),
            time.alias("timestamp"),
            (time * 1000 + (n * 7919) % 9000 - late).alias("processed_at_ms"),
            F.lit(30000000).cast("long").alias("gas_limit"),
            ((n * 104729) % 30000000).alias("gas_used"),
            (n % 5).cast("int").alias("transaction_count"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        return self._blocks(True)

    @cached_property
    def canonical_blocks(self) -> DataFrame:
        return self._blocks(False)

    @cached_property
    def doubled_blocks(self) -> DataFrame:
        return self.blocks.unionByName(self.blocks.where("number % 503 = 0"))

    @cached_property
    def transfers(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("block_number"),
            F.col("l_linenumber").cast("int").alias("log_index"),
            F.concat(F.lit("0x"), h("tx:", F.col("l_orderkey"), ":", F.col("l_linenumber"))).alias("tx_hash"),
            address("acct", F.col("l_suppkey")).alias("from_address"),
            address("acct", F.col("l_partkey")).alias("to_address"),
            address("tok", F.col("l_partkey") % 7).alias("token_address"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
            F.when(F.col("l_returnflag") == "A", "SWAP").when(F.col("l_returnflag") == "R", "APPROVE").otherwise("TRANSFER").alias("activity_type"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        k = F.col("log_index") % 5
        topic0 = F.when(k == 0, TRANSFER).when(k == 1, APPROVAL).when(k == 2, SWAP).when(k == 3, MINT).otherwise(F.concat(F.lit("0x"), h("other")))
        pad = lambda c: F.concat(F.lit("0x"), F.lpad(F.substring(c, 3, 40), 64, "0"))
        return self.transfers.select(
            "block_number",
            "log_index",
            "tx_hash",
            F.col("token_address").alias("address"),
            F.array(topic0, pad("from_address"), pad("to_address")).alias("topics"),
            F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("amount")), 64, "0")).alias("data"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        rows = self.table("orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("block_number"), F.col("o_custkey").alias("c"), F.explode(F.expr("sequence(1, int(o_orderkey % 5))")).alias("tx_index"))
        n, i = F.col("block_number"), F.col("tx_index")
        return rows.select(
            "block_number",
            "tx_index",
            F.concat(F.lit("0x"), h("tx:", n, ":", i)).alias("tx_hash"),
            address("acct", F.col("c")).alias("from_address"),
            F.when((n + i) % 11 != 0, address("acct", F.col("c") + i)).alias("to_address"),
            ((n * 31 + i) % 3).alias("value"),
            (21000 + (n * 17 + i * 13) % 100000).alias("gas"),
            (1000000000 + (n * 7919 + i) % 1000000007).alias("gas_price"),
        )

    @cached_property
    def token_metadata(self) -> DataFrame:
        decimals = [6, 8, 18, 18, None]
        rows = self.spark.createDataFrame([(k, f"T{k}", d) for k, d in enumerate(decimals)], "k long, symbol string, decimals int")
        return rows.select(address("tok", F.col("k")).alias("address"), "symbol", "decimals")

    @cached_property
    def entity_labels(self) -> DataFrame:
        rows = self.spark.createDataFrame([(3, "Faucet A"), (7, "Faucet B"), (11, "Faucet C")], "k long, label string")
        return rows.select(address("acct", F.col("k")).alias("address"), "label")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def status_samples(self) -> DataFrame:
        e = F.col("event_id")
        latest = 1000 + e
        fetched = latest - e % 7
        synced = fetched - e % 13
        return self.events.select(
            (F.col("user_id") % 3).alias("chain_id"),
            "ts",
            e.alias("sample_id"),
            latest.alias("latest"),
            F.when(e % 89 == 3, synced - 5).otherwise(fetched).alias("fetched"),
            F.when(e % 97 == 5, latest + 8).otherwise(synced).alias("synced"),
            (e % 200).alias("jobs_depth"),
            (e % 160).alias("results_depth"),
            F.lit(160).cast("long").alias("capacity"),
            (F.col("value") / 100).alias("bps"),
        )


class _ByBlock(Views):
    def table(self, name: str) -> DataFrame:
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        rows = super().table(name)
        return rows if key is None else rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)


_TX = "'0x' || sha256('tx:' || {} || ':' || {})"
_ADDR = "'0x' || substr(sha256('{}:' || ({})), 1, 40)"
_OWN, _PARENT = "'0x' || sha256('blk:' || number)", "'0x' || sha256('blk:' || (number - 1))"
_REST = "30000000::BIGINT AS gas_limit, (number * 104729) % 30000000 AS gas_used, (number % 5)::INTEGER AS transaction_count"

SQL = {
    "blocks": f"SELECT number, {_OWN} AS hash, CASE WHEN number = 0 THEN '{ZERO_HASH}' WHEN number % 211 = 5 THEN {_OWN} WHEN number % 101 = 7 THEN '0x' || sha256('fork:' || (number - 1)) ELSE {_PARENT} END AS parent_hash, 1700000000 + 12 * number AS timestamp, (1700000000 + 12 * number) * 1000 + (number * 7919) % 9000 - CASE WHEN number % 307 = 11 THEN 30000 ELSE 0 END AS processed_at_ms, {_REST} FROM (SELECT o_orderkey AS number FROM orders) WHERE number % 97 <> 13",
    "canonical_blocks": f"SELECT number, {_OWN} AS hash, CASE WHEN number = 0 THEN '{ZERO_HASH}' ELSE {_PARENT} END AS parent_hash, 1700000000 + 12 * number AS timestamp, (1700000000 + 12 * number) * 1000 + (number * 7919) % 9000 AS processed_at_ms, {_REST} FROM (SELECT o_orderkey AS number FROM orders)",
    "doubled_blocks": "SELECT * FROM blocks UNION ALL SELECT * FROM blocks WHERE number % 503 = 0",
    "transfers": f"SELECT l_orderkey AS block_number, l_linenumber::INTEGER AS log_index, {_TX.format('l_orderkey', 'l_linenumber')} AS tx_hash, {_ADDR.format('acct', 'l_suppkey')} AS from_address, {_ADDR.format('acct', 'l_partkey')} AS to_address, {_ADDR.format('tok', 'l_partkey % 7')} AS token_address, round(l_extendedprice * 100)::BIGINT AS amount, CASE l_returnflag WHEN 'A' THEN 'SWAP' WHEN 'R' THEN 'APPROVE' ELSE 'TRANSFER' END AS activity_type, l_shipdate AS created_at FROM lineitem",
    "logs": f"SELECT block_number, log_index, tx_hash, token_address AS address, [CASE log_index % 5 WHEN 0 THEN '{TRANSFER}' WHEN 1 THEN '{APPROVAL}' WHEN 2 THEN '{SWAP}' WHEN 3 THEN '{MINT}' ELSE '0x' || sha256('other') END, '0x' || lpad(substr(from_address, 3), 64, '0'), '0x' || lpad(substr(to_address, 3), 64, '0')] AS topics, '0x' || lpad(lower(to_hex(amount)), 64, '0') AS data FROM transfers",
    "transactions": f"SELECT block_number, tx_index, {_TX.format('block_number', 'tx_index')} AS tx_hash, {_ADDR.format('acct', 'c')} AS from_address, CASE WHEN (block_number + tx_index) % 11 <> 0 THEN {_ADDR.format('acct', 'c + tx_index')} END AS to_address, (block_number * 31 + tx_index) % 3 AS value, 21000 + (block_number * 17 + tx_index * 13) % 100000 AS gas, 1000000000 + (block_number * 7919 + tx_index) % 1000000007 AS gas_price FROM (SELECT o_orderkey AS block_number, o_custkey AS c, unnest(range(1, o_orderkey % 5 + 1))::INTEGER AS tx_index FROM orders)",
    "token_metadata": f"SELECT {_ADDR.format('tok', 'k')} AS address, symbol, decimals FROM (VALUES (0, 'T0', 6), (1, 'T1', 8), (2, 'T2', 18), (3, 'T3', 18), (4, 'T4', NULL)) v(k, symbol, decimals)",
    "entity_labels": f"SELECT {_ADDR.format('acct', 'k')} AS address, label FROM (VALUES (3, 'Faucet A'), (7, 'Faucet B'), (11, 'Faucet C')) v(k, label)",
    "status_samples": "SELECT user_id % 3 AS chain_id, ts, event_id AS sample_id, 1000 + event_id AS latest, CASE WHEN event_id % 89 = 3 THEN 1000 + event_id - event_id % 7 - event_id % 13 - 5 ELSE 1000 + event_id - event_id % 7 END AS fetched, CASE WHEN event_id % 97 = 5 THEN 1008 + event_id ELSE 1000 + event_id - event_id % 7 - event_id % 13 END AS synced, event_id % 200 AS jobs_depth, event_id % 160 AS results_depth, 160::BIGINT AS capacity, value / 100 AS bps FROM events",
}
NEEDS = {"doubled_blocks": ["blocks"], "logs": ["transfers"]}


def with_views(body: str, names: str) -> str:
    """A query over the named views; body may begin with more CTEs after 'WITH'."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
