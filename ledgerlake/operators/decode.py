"""Decoding of blocks: logs and transactions become activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions import chain
from ledgerlake.functions.fixed import FAUCETS, SYMBOLS, TRANSFER, WATCHED, ZERO_ADDRESS

ACTIVITY = ["block_number", "tx_hash", "log_index", "from_address", "to_address", "amount", "token_address", "activity_type"]


def scan_block_range(df: DataFrame, start: int, end: int, number: str = "number") -> DataFrame:
    """Both ends included."""
    return df.where(F.col(number).between(start, end))


def scan_watched_logs(logs: DataFrame, addresses: list[str] | DataFrame | None = None) -> DataFrame:
    """Transfer logs of watched addresses; all logs if none are watched. None: the usual tokens. A frame of addresses is joined."""
    if isinstance(addresses, DataFrame):
        watched = addresses.select(F.lower("address").alias("_watched")).distinct()
        return logs.where(F.lower(chain.topic(F.col("topics"), 1)) == TRANSFER).join(watched, F.lower("address") == F.col("_watched"), "left_semi")
    addresses = WATCHED if addresses is None else addresses
    if not addresses:
        return logs
    return logs.where(F.lower("address").isin([a.lower() for a in addresses]) & (F.lower(chain.topic(F.col("topics"), 1)) == TRANSFER))


def log_activities(logs: DataFrame) -> DataFrame:
    """An activity for each log with topics."""
    t = F.col("topics")
    return logs.where(F.size(t) >= 1).select(
        "block_number",
        "tx_hash",
        "log_index",
        chain.log_sender(t, F.col("address")).alias("from_address"),
        chain.log_receiver(t).alias("to_address"),
        chain.uint256_text(F.col("data")).alias("amount"),
        F.lower("address").alias("token_address"),
        chain.classify_log(t).alias("activity_type"),
    )


SMALL = 100_000  #: rows of a dimension that is sent to all tasks (some 100 bytes each)


def dimension(rows: DataFrame) -> DataFrame:
    """rows, sent to all tasks of the join they enter if there are at most SMALL of them; Spark chooses beyond that."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def label_frame(spark) -> DataFrame:
    """The fixed labels of senders: at most a handful of rows."""
    return spark.createDataFrame([(a.lower(), x) for a, x in FAUCETS.items()], "address string, label string")


def label_entity(activities: DataFrame, labels: DataFrame) -> DataFrame:
    """Activities of labelled senders become claims that carry the label as symbol; others get a null symbol."""
    known = labels.select(F.lower("address").alias("_labelled"), "label")
    out = activities.join(dimension(known), F.lower("from_address") == F.col("_labelled"), "left")
    kept = [c for c in activities.columns if c not in ("activity_type", "symbol")]
    return out.select(*kept, F.when(F.col("label").isNotNull(), "FAUCET_CLAIM").otherwise(F.col("activity_type")).alias("activity_type"), F.col("label").alias("symbol"))


def static_symbol(token: Column) -> Column:
    entries = [x for a, s in SYMBOLS.items() for x in (F.lit(a), F.lit(s))]
    return F.try_element_at(F.create_map(*entries), F.lower(token))


def resolve_symbol(activities: DataFrame, metadata: DataFrame) -> DataFrame:
    """The label, else the fixed table, else the metadata, else ETH for the zero address, else the address shortened."""
    dim = metadata.select(F.lower("address").alias("_token"), F.col("symbol").alias("_symbol"))
    out = activities.join(dimension(dim), F.lower("token_address") == F.col("_token"), "left")
    filled = lambda c: F.nullif(c, F.lit(""))
    native = F.when(F.lower("token_address") == ZERO_ADDRESS, "ETH")
    symbol = F.coalesce(filled(F.col("symbol")), static_symbol(F.col("token_address")), filled(F.col("_symbol")), native, chain.short_symbol(F.col("token_address")))
    return out.select(*[c for c in activities.columns if c != "symbol"], symbol.alias("symbol"))


def resolve_decimals(activities: DataFrame, metadata: DataFrame) -> DataFrame:
    """18 where the metadata has none."""
    dim = metadata.select(F.lower("address").alias("_token"), F.col("decimals").alias("_decimals"))
    out = activities.join(dimension(dim), F.lower("token_address") == F.col("_token"), "left")
    decimals = F.when(F.lower("token_address") == ZERO_ADDRESS, 18).otherwise(F.coalesce("_decimals", F.lit(18)))
    return out.select(*activities.columns, decimals.cast("int").alias("decimals"))


def packed(text: Column) -> Column:
    """Lower-case hex (0x..., whole bytes) as bytes, which take half the room in a shuffle, and any other text as it is. See unpacked()."""
    plain = text.rlike(r"\A0x[0-9a-f]+\z") & (F.length(text) % 2 == 0)
    return F.struct(F.when(plain, F.unhex(F.substring(text, 3, 2_147_483_647))).alias("bytes"), F.when(~plain, text).alias("text"))


def unpacked(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(value["bytes"]))), value["text"])


def tx_activities(transactions: DataFrame, logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims, deployments and plain transfers of transactions, numbered from 20000 in each block.

    Transactions and the hashes of logs are dealt by their block, once and packed; whether a transaction has logs and its number
    are both found there. What can't become an activity isn't dealt.
    """
    known = labels.select(F.lower("address").alias("_labelled"), "label")
    rows = transactions.join(dimension(known), F.lower("from_address") == F.col("_labelled"), "left")
    rows = rows.where(F.col("label").isNotNull() | F.col("to_address").isNull() | (F.col("value") > 0))
    rows = rows.select("block_number", packed(F.col("tx_hash")).alias("_tx"), "tx_index", packed(F.col("from_address")).alias("_from"), packed(F.col("to_address")).alias("_to"), "value", "label", F.lit(False).alias("_log"))
    with_logs = logs.where((F.size("topics") >= 1) & F.col("tx_hash").isNotNull() & F.col("block_number").isNotNull())
    with_logs = with_logs.select("block_number", packed(F.col("tx_hash")).alias("_tx"), F.lit(True).alias("_log"))
    both = rows.unionByName(with_logs, allowMissingColumns=True).repartition("block_number")
    both = both.withColumn("_logged", F.max("_log").over(W.partitionBy("block_number", "_tx"))).where("NOT _log")
    both = both.select("block_number", unpacked(F.col("_tx")).alias("tx_hash"), "tx_index", unpacked(F.col("_from")).alias("from_address"), unpacked(F.col("_to")).alias("to_address"), "value", "label", "_logged")
    plain = (F.col("value") > 0) & ~F.col("_logged") & F.col("to_address").isNotNull()
    kind = F.when(F.col("label").isNotNull(), "FAUCET_CLAIM").when(F.col("to_address").isNull(), "DEPLOY").when(plain, "ETH_TRANSFER")
    symbol = F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("to_address").isNull(), "EVM").otherwise("ETH")
    both = both.withColumn("activity_type", kind).withColumn("symbol", symbol).where("activity_type IS NOT NULL")
    number = F.row_number().over(W.partitionBy("block_number").orderBy("tx_index", "tx_hash"))
    return both.select(
        "block_number",
        "tx_hash",
        (F.lit(19999) + number).cast("int").alias("log_index"),
        chain.normalize_sender(F.col("from_address")).alias("from_address"),
        chain.normalize_receiver(F.col("to_address")).alias("to_address"),
        F.col("value").cast("string").alias("amount"),
        F.lit(ZERO_ADDRESS).alias("token_address"),
        "activity_type",
        "symbol",
    )


def block_projection(headers: DataFrame) -> DataFrame:
    """Rows for the blocks table from headers with their transactions."""
    return headers.select(
        "number", "hash", "parent_hash", "timestamp", "gas_limit", "gas_used",
        F.col("base_fee_per_gas").cast("decimal(38,0)").alias("base_fee_per_gas"),
        F.size("transactions").cast("int").alias("transaction_count"),
    )


def block_activities(logs: DataFrame, transactions: DataFrame, labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """All activities, from logs and from transactions, with symbols."""
    from_logs = resolve_symbol(label_entity(log_activities(logs), labels), metadata)
    return from_logs.unionByName(tx_activities(transactions, logs, labels))


def densify_range(logs: DataFrame, start: int, end: int) -> DataFrame:
    """C14: a row for each number of the range, with its logs in order."""
    spark = logs.sparkSession
    own = [c for c in logs.columns if c != "block_number"]
    grouped = scan_block_range(logs, start, end, "block_number").groupBy(F.col("block_number").alias("number")).agg(F.array_sort(F.collect_list(F.struct("log_index", *[c for c in own if c != "log_index"]))).alias("logs"))
    every = spark.range(start, end + 1).select(F.col("id").alias("number"))
    empty = F.array().cast(grouped.schema["logs"].dataType)
    return every.join(grouped, "number", "left").select("number", F.coalesce("logs", empty).alias("logs"))
