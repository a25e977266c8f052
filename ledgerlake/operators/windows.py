"""Analytic operators over ordered blocks, samples and counters (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.operators.neighbors import WIDTH, carried_forward, with_halo, with_neighbor, with_position
from ledgerlake.operators.relational import previous_blocks


def gap_list(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """gap_start, gap_end, gap_size."""
    rows = with_neighbor(blocks.select("number").distinct(), "number", ["number"], "next", ahead=True, width=width)
    rows = rows.where(F.col("next.number") - F.col("number") > 1)
    return rows.select((F.col("number") + 1).alias("gap_start"), (F.col("next.number") - 1).alias("gap_end"), (F.col("next.number") - F.col("number") - 1).alias("gap_size"))


def gap_flag(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """How many numbers aren't followed by the next one, and whether there are none."""
    n = gap_list(blocks, width).agg(F.count("*").alias("gaps"))
    return n.select("gaps", F.when(F.col("gaps") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def chain_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash isn't the hash of the block numbered one less."""
    return previous_blocks(blocks, ["hash"]).where(F.col("parent_hash") != F.col("prev_hash")).select("number", "parent_hash", "prev_hash")


def timestamp_anomalies(blocks: DataFrame, seconds: float = 5, width: int = WIDTH) -> DataFrame:
    """Blocks processed more than some seconds before the block that comes before them."""
    rows = with_neighbor(blocks, "number", ["number", "processed_at_ms"], "prev", width=width)
    early = (F.col("prev.processed_at_ms") - F.col("processed_at_ms")) / 1000.0
    return rows.where(early > seconds).select("number", F.col("prev.number").alias("prev_number"), early.alias("seconds_early"))


def chain_tps(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Transactions per second since the block before; the first block has 0, blocks of one second repeat the last value."""
    rows = with_neighbor(blocks.select("number", "timestamp", "transaction_count"), "number", ["timestamp"], "prev", width=width)
    seconds = F.col("timestamp") - F.col("prev.timestamp")
    own = F.when(F.col("prev").isNull(), F.lit(0.0)).when(seconds != 0, F.round(F.col("transaction_count") / seconds, 2))
    return carried_forward(rows, "number", own, "tps", width=width).select("number", "tps")


DAY_US = 86_400_000_000  #: width of ranges of time in microseconds


def _key_of(rows: DataFrame, column: str) -> tuple[Column, int]:
    """A whole number in the order of a time or whole number, and the width of its ranges."""
    return (F.unix_micros(column), DAY_US) if rows.schema[column].dataType.typeName() == "timestamp" else (F.col(column).cast("long"), WIDTH)


def heat(samples: DataFrame, by: list[str], order: list[str], value: str = "tps", size: int = 60, block: int = 4096) -> DataFrame:
    """Mean of the last samples, heat from 0 to 100, wake-up and pace in milliseconds. order: a timestamp or whole number, and what parts equal ones.

    A series is cut into blocks of its positions, each with the last `size` samples before it.
    """
    key, width = _key_of(samples, order[0])
    rows = with_position(samples.withColumn("_key", key), "_key", "_place", by=by, ties=order[1:], width=width)
    rows = with_halo(rows, "_place", size, width=block)
    w = W.partitionBy(*by, "_part").orderBy("_place")
    rows = rows.withColumn("mean", F.avg(value).over(w.rowsBetween(-(size - 1), 0)))
    rows = rows.withColumn("before", F.coalesce(F.avg(value).over(w.rowsBetween(-size, -1)), F.lit(0.0))).where("_own")
    now = F.when(F.col(value) > 2 * F.col("mean"), F.col(value)).otherwise(F.col("mean"))
    pace = F.when(now >= 5.0, 200).when(now >= 2.0, 1000).when(now >= 0.5, 5000).otherwise(30000)
    return rows.select(*by, *order, value, "mean", F.least(F.col("mean") / 5.0 * 100, F.lit(100.0)).alias("heat"), ((F.col(value) > 2 * F.col("before")) | (F.col(value) > 2.0)).alias("wake"), pace.alias("pace_ms"))


def throttle_mode(fraction: Column) -> Column:
    return F.when(fraction >= 0.8, "Eco").when(fraction >= 0.5, "Balanced").otherwise("Aggressive")


def recommended_rate(fraction: Column, most: float) -> Column:
    scale = F.when(fraction >= 0.8, 0.10).when(fraction >= 0.5, 1.0 - (fraction - 0.5) / (0.8 - 0.5) * 0.90).otherwise(1.0)
    return scale * most


def quota_sliding(requests: DataFrame, limit: int, seconds: int = 60, most: float = 15.0) -> DataFrame:
    """Each request's share of its node's quota in the trailing window, the mode and the rate that follow. requests: node, ts, request_id."""
    rows = with_halo(requests.withColumn("_ms", F.unix_millis("ts")), "_ms", seconds * 1000, width=3_600_000)
    w = W.partitionBy("node", "_part").orderBy("_ms").rangeBetween(-seconds * 1000 + 1, 0)
    rows = rows.withColumn("used", F.count("*").over(w)).where("_own")
    fraction = F.col("used") / limit
    return rows.select("request_id", "node", "used", fraction.alias("fraction"), throttle_mode(fraction).alias("mode"), recommended_rate(fraction, most).alias("rate"))


def daily_use(requests: DataFrame) -> DataFrame:
    """requests with their number in the node's day (UTC)."""
    w = W.partitionBy("node", F.to_date("ts")).orderBy("ts", "request_id")
    return requests.withColumn("used", F.row_number().over(w))


def quota_daily(requests: DataFrame, limit: int = 300000) -> DataFrame:
    """0 safe, 1 from 80 %, 2 from 90 % of the daily quota."""
    share = F.col("used") / limit
    return daily_use(requests).select("request_id", "node", "used", F.when(share >= 0.90, 2).when(share >= 0.80, 1).otherwise(0).alias("status"))


def guard_mode(ratio: Column) -> Column:
    return F.when(ratio >= 1.0, "EXHAUSTED").when(ratio > 0.90, "STRICT").when(ratio > 0.85, "THROTTLING").otherwise("NORMAL")


def quota_guard(requests: DataFrame, limit: int) -> DataFrame:
    """Per node, day and mode: requests; requests at or beyond the quota are denied."""
    rows = daily_use(requests).withColumn("mode", guard_mode(F.col("used") / limit))
    return rows.groupBy("node", F.to_date("ts").alias("day"), "mode").agg(F.count("*").alias("requests"), F.count_if(F.col("used") >= limit).alias("denied"))


def counter_deltas(samples: DataFrame, by: list[str], value: str = "value", order: list[str] = ["ts", "sample_id"]) -> DataFrame:  # noqa: B006
    """samples with the growth of their counter since the one before; a counter that fell has begun anew."""
    key, width = _key_of(samples, order[0])
    rows = with_neighbor(samples.withColumn("_key", key), "_key", [value], "prev", by=by, ties=order[1:], width=width)
    prev = F.col(f"prev.{value}")
    return rows.withColumn("delta", F.when(prev.isNull(), F.lit(0.0)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)).drop("_key", "prev")


def counter_increase(samples: DataFrame, by: list[str], window: str, seconds: int) -> DataFrame:
    """Growth and rate of each series in each window of time, without extrapolation."""
    rows = counter_deltas(samples, by).groupBy(*by, F.window("ts", window).alias("w")).agg(F.sum("delta").alias("increase"))
    return rows.select(*by, F.col("w.start").alias("start"), "increase", (F.col("increase") / seconds).alias("rate"))


def over_time(samples: DataFrame, by: list[str], window: str) -> DataFrame:
    """Mean and last value of each window of time."""
    rows = samples.groupBy(*by, F.window("ts", window).alias("w"))
    return rows.agg(F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "sample_id")).alias("last")).select(*by, F.col("w.start").alias("start"), "mean", "last")


def two_second_rate(samples: DataFrame, by: list[str]) -> DataFrame:
    """Half the growth since the sample before, whole numbers."""
    rows = with_neighbor(samples, "tick", ["value"], "prev", by=by)
    prev = F.col("prev.value")
    return rows.withColumn("rate", F.when(prev.isNull(), F.lit(0)).otherwise(F.floor((F.col("value") - prev) / 2)).cast("long")).drop("prev")


def sync_speed(samples: DataFrame, by: list[str]) -> DataFrame:
    """Blocks per second between samples; null for the first and for samples of one instant."""
    rows = with_neighbor(samples.withColumn("_us", F.unix_micros("ts")), "_us", ["synced", "_us"], "prev", by=by, ties=["sample_id"], width=DAY_US)
    seconds = (F.col("_us") - F.col("prev._us")) / 1e6
    return rows.select(*by, "sample_id", F.try_divide(F.col("synced") - F.col("prev.synced"), seconds).alias("speed"))
