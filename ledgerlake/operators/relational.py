"""Filters, joins, set operations, sorts and aggregates over blocks and transfers (F, J, A, L, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions import chain
from ledgerlake.functions.u256 import limbs_from_decimal, sum_limbs, to_text

ALL_TRANSFER_KEYS = ["tx_hash", "from_address", "to_address", "token_address", "amount", "activity_type", "created_at"]


def recent_window(df: DataFrame, now: Column, interval: str, column: str = "created_at") -> DataFrame:
    """rows later than now minus an interval."""
    return df.where(F.col(column) > now - F.expr(f"INTERVAL {interval}"))


def last_n_heights(df: DataFrame, n: int, number: str = "number") -> DataFrame:
    """rows at most n - 1 below the greatest height."""
    top = df.agg(F.max(number).alias("_top"))  # one row
    return df.crossJoin(F.broadcast(top)).where(F.col(number) >= F.col("_top") - (n - 1)).drop("_top")


def unknown_sender(transfers: DataFrame) -> DataFrame:
    """F03."""
    return transfers.where(F.col("from_address") == chain.UNKNOWN_SENDER).orderBy(F.desc("block_number"), F.desc("log_index"))


def is_synthetic(sender: Column) -> Column:
    """F04."""
    s = F.lower(sender)
    return s.startswith("0xdead") | s.startswith("0x0000")


def broken_parent(blocks: DataFrame, zero: str) -> DataFrame:
    """F05."""
    return blocks.where((F.col("parent_hash") == zero) & (F.col("number") > 0))


def not_null(columns: list[str]) -> Column:
    """true if no listed column is null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def latest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows that come last by keys."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def with_latency(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("latency", chain.epoch_latency(F.col("processed_at_ms"), F.col("timestamp")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row with the count of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()])


def transfers_of_blocks(blocks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Every block with the number of its transfers, none included; transfers are counted before they meet blocks."""
    counts = transfers.groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("transfers"))
    return blocks.join(counts, "number", "left").withColumn("transfers", F.coalesce("transfers", F.lit(0)))


def previous_blocks(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks with the columns of the block numbered one less, as prev_...; an equi-join, without a global order."""
    prev = blocks.select((F.col("number") + 1).alias("number"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return blocks.join(prev, "number")


def reconcile(local: DataFrame, canonical: DataFrame) -> DataFrame:
    """Number and status of every block of either side."""
    a = local.select("number", F.lower("hash").alias("local_hash"))
    b = canonical.select("number", F.lower("hash").alias("canonical_hash"))
    status = F.when(F.col("local_hash").isNull(), "MISSING_LOCAL").when(F.col("canonical_hash").isNull(), "MISSING_CANONICAL").when(F.col("local_hash") == F.col("canonical_hash"), "MATCH").otherwise("HASH_MISMATCH")
    return a.join(b, "number", "full_outer").select("number", "local_hash", "canonical_hash", status.alias("status"))


def missing_numbers(df: DataFrame, number: str = "number") -> DataFrame:
    """Numbers between the least and the greatest that no row has; each found gap is expanded where it was found."""
    from ledgerlake.operators.neighbors import with_neighbor

    rows = with_neighbor(df.select(F.col(number).alias("number")).distinct(), "number", ["number"], "next", ahead=True)
    gaps = rows.where(F.col("next.number") > F.col("number") + 1)
    return gaps.select(F.explode(F.sequence(F.col("number") + 1, F.col("next.number") - 1)).alias("number"))


def token_stats(transfers: DataFrame) -> DataFrame:
    """A05."""
    return transfers.groupBy("token_address").agg(
        F.count("*").alias("transfers"), F.countDistinct("from_address").alias("senders"), F.max("block_number").alias("max_block"), F.max("created_at").alias("last_at")
    )


def share(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each key; the window runs over the counts, a row a key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 2).alias("percent"))


def token_volume(transfers: DataFrame, key: str) -> DataFrame:
    """The exact sum of amounts (decimal strings of any 256-bit number) and the count by key."""
    rows = transfers.select(key, limbs_from_decimal(F.col("amount").cast("string")).alias("limbs"))
    return rows.groupBy(key).agg(to_text(sum_limbs(F.col("limbs"))).alias("volume"), F.count("*").alias("n"))


def gas_leaderboard(transactions: DataFrame, top: int = 5) -> DataFrame:
    """Per block, the receivers that used most gas, with exact fees."""
    fee = F.col("gas").cast("decimal(20,0)") * F.col("gas_price").cast("decimal(20,0)")
    rows = transactions.groupBy("block_number", chain.normalize_receiver(F.col("to_address")).alias("receiver")).agg(F.sum("gas").alias("gas"), F.sum(fee).alias("fee"))
    place = F.row_number().over(W.partitionBy("block_number").orderBy(F.desc("gas"), "receiver"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("block_number", "place", "receiver", "gas", F.col("fee").cast("string").alias("fee_wei"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """The quantile of each series from cumulative buckets (series, le, n), interpolated within its bucket; the last bound may be infinite."""
    w = W.partitionBy("series").orderBy("le")
    rows = buckets.withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    total = buckets.groupBy("series").agg(F.max("n").alias("total"))
    rows = rows.join(total, "series").withColumn("rank", F.col("total") * F.lit(q))
    first = rows.where((F.col("n") >= F.col("rank")) & (F.col("total") > 0)).groupBy("series").agg(F.min_by(F.struct("le", "low", "before", "n", "rank"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * F.try_divide(F.col("b.rank") - F.col("b.before"), F.col("b.n") - F.col("b.before"))
    return first.select("series", F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(inside).alias("value"))


def admin_ips(requests: DataFrame, window: int = 2001, least: int = 100, threshold: float = 0.9) -> DataFrame:
    """Per window of requests (by their id), the address with more than a share of them."""
    rows = requests.withColumn("window_id", F.floor(F.col("request_id") / window))
    counts = rows.groupBy("window_id", "ip").agg(F.count("*").alias("n"))
    totals = counts.groupBy("window_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "window_id").where((F.col("total") >= least) & (F.col("n") > threshold * F.col("total"))).select("window_id", "ip", "n", "total")


def db_errors(lines: DataFrame) -> DataFrame:
    """How often each database error occurs in log lines (value)."""
    hits = lines.where(F.col("value").contains("db_fail")).select(F.regexp_extract("value", 'err="([^"]*)"', 1).alias("error"))
    return hits.where("error <> ''").groupBy("error").agg(F.count("*").alias("n"))


def foreign_peers(connections: DataFrame, port: int) -> DataFrame:
    """Established connections to a port by peer, without local ones. connections: state, local_port, peer."""
    far = ~(F.col("peer").startswith("127.") | F.col("peer").startswith("100.") | F.col("peer").startswith("192.168."))
    return connections.where((F.col("state") == "ESTABLISHED") & (F.col("local_port") == port) & far).groupBy("peer").agg(F.count("*").alias("n"))


def linkage_list(blocks: DataFrame, n: int = 10) -> DataFrame:
    """A24: 'child→parent' of the newest n blocks, newest first, and whether each block is linked to the one before."""
    newest = blocks.orderBy(F.desc("number")).limit(n)
    rows = newest.withColumn("older", F.lead(F.struct("number", "hash")).over(W.orderBy(F.desc("number"))))  # n rows
    ok = F.col("older").isNull() | ((F.col("number") == F.col("older.number") + 1) & (F.col("parent_hash") == F.col("older.hash")))
    pair = F.struct((-F.col("number")).alias("k"), F.concat(F.col("number").cast("string"), F.lit("→"), F.col("older.number").cast("string")).alias("s"))
    return rows.agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col("older").isNotNull(), pair))), lambda x: x.s)).alias("links"), F.bool_and(ok).alias("passed"))
