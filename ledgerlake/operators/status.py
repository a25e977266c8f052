"""Status and derived metrics over samples of heights, queues and rates (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.neighbors import running_max


def latest_height() -> Column:
    return F.when(F.col("latest") > 0, F.col("latest")).when(F.col("fetched") > 0, F.col("fetched")).otherwise(F.col("synced"))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, F.when(whole > 0, whole)), F.lit(0.0))


def sync_status(samples: DataFrame) -> DataFrame:
    """Heights, lag and progress of each sample."""
    rows = samples.withColumn("head", latest_height())
    return rows.select(
        "chain_id", "sample_id", "head",
        F.greatest(F.col("head") - F.col("synced"), F.lit(0)).alias("lag"),
        (F.col("head") - F.col("fetched")).alias("fetch_lag"),
        percent(F.col("fetched"), F.col("head")).alias("fetch_percent"),
        percent(F.col("synced"), F.col("head")).alias("sync_percent"),
    )


def state_label(samples: DataFrame, running: str = "running") -> DataFrame:
    """The state's name and health."""
    lag = F.greatest(latest_height() - F.col("synced"), F.lit(0))
    state = F.when(F.col("results_depth") > F.floor(F.col("capacity") * 80 / 100), "pressure_limit").when((lag > 1000) & (F.col("bps") < 1), "stalled").otherwise(running)
    return samples.select("chain_id", "sample_id", state.alias("state"), (state != "stalled").alias("healthy"))


def latest_status(samples: DataFrame) -> DataFrame:
    """The newest synced height and lag of each chain, 0 where unknown."""
    newest = samples.groupBy("chain_id").agg(F.max_by(F.struct("synced", (F.col("latest") - F.col("synced")).alias("lag")), F.struct("ts", "sample_id")).alias("s"))
    return newest.select("chain_id", F.coalesce("s.synced", F.lit(0)).alias("last_synced_block"), F.coalesce("s.lag", F.lit(0)).alias("sync_lag"))


def latency_text(samples: DataFrame, now: Column, processed: DataFrame, block_seconds: float = 12.0) -> DataFrame:
    """How far behind each sample is, in words and seconds. processed: number, processed_at (a timestamp)."""
    lag = F.col("latest") - F.col("synced")
    rows = samples.join(processed.select(F.col("number").alias("synced"), "processed_at"), "synced", "left")
    elapsed = (F.unix_millis(now) - F.unix_millis("processed_at")) / 1000.0
    none = (F.col("latest") <= 0) | (F.col("synced") <= 0)
    seconds = F.when(none, F.lit(0.0)).when(lag > 100, lag * block_seconds).otherwise(F.coalesce(elapsed, lag * block_seconds))
    text = F.when(none, "0s").when(lag > 100, F.format_string("Catching up... (%d blocks behind)", lag)).otherwise(F.format_string("%.2fs", seconds))
    return rows.select("chain_id", "sample_id", text.alias("latency_text"), seconds.alias("latency_seconds"))


def catch_up(rows: DataFrame) -> DataFrame:
    """The documented estimate, the time to drain the lag at the rate, progress, and whether it is real time. rows: chain_id, start, lag, head, rate."""
    rate = F.nullif(F.col("rate"), F.lit(0.0))
    return rows.select(
        "chain_id", "start",
        F.try_divide(F.col("lag") * 12.0, rate * 60.0).alias("eta_documented"),
        F.try_divide(F.col("lag").cast("double"), rate).alias("eta_seconds"),
        percent(F.col("head") - F.col("lag"), F.col("head")).alias("percent"),
        (F.col("lag") < 10).alias("real_time"),
    )


def sustained(samples: DataFrame, condition: Column, seconds: int, out: str) -> DataFrame:
    """Whether a condition has held for all of the trailing time, which the samples must reach back over: no failure since then.

    The last failure is a running maximum, so each sample is looked at once, however many a window holds."""
    rows = samples.withColumn("_ms", F.unix_millis("ts"))
    rows = rows.withColumn("_failed", F.when(~F.coalesce(condition, F.lit(False)), F.col("_ms")))
    began = rows.groupBy("chain_id").agg(F.min("_ms").alias("_began"))
    rows = running_max(rows, "_ms", "_failed", "_last", by=["chain_id"], width=3_600_000).join(began, "chain_id", "left")
    held = F.coalesce(F.col("_last") < F.col("_ms") - seconds * 1000, F.lit(True)) & (F.col("_ms") - F.col("_began") >= seconds * 1000)
    return rows.withColumn(out, held).drop("_ms", "_failed", "_last", "_began")


def ingestion_rate(records: Column, seconds: Column) -> Column:
    """M07."""
    return F.coalesce(F.round(F.try_divide(records, seconds), 2), F.lit(0.0))


def display_tps(samples: DataFrame, tps: Column) -> DataFrame:
    """0 while more than ten blocks behind."""
    return samples.withColumn("display_tps", F.when(F.col("latest") - F.col("synced") > 10, F.lit(0.0)).otherwise(tps))


def health_rollup(components: DataFrame) -> DataFrame:
    """Overall health by sample. components: sample_id, component, value, total (both may be null)."""
    status = (
        F.when(F.col("value").isNull(), "unhealthy")
        .when((F.col("component") == "nodes") & (F.col("value") < F.col("total")), "degraded")
        .when((F.col("component") == "ordering") & (F.col("value") > 500), "degraded")
        .otherwise("healthy")
    )
    rows = components.withColumn("status", status)
    return rows.groupBy("sample_id").agg(
        F.bool_and(F.col("status") == "healthy").alias("healthy"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.count_if(F.col("status") == "unhealthy").alias("unhealthy"),
    )


def debug_snapshot(blocks: DataFrame, transfers: DataFrame, head: int, n: int = 5) -> DataFrame:
    """One row with the gap to the chain, and the newest n blocks and transfers."""
    b = blocks.orderBy(F.desc("number")).limit(n).agg(F.max("number").alias("stored"), F.sort_array(F.collect_list(F.struct("number", "hash")), asc=False).alias("blocks"))
    keys = ["block_number", "log_index", "tx_hash", "amount"]
    t = transfers.orderBy(*[F.desc(k) for k in keys]).limit(n).agg(F.sort_array(F.collect_list(F.struct(*keys)), asc=False).alias("transfers"))
    gap = F.lit(head) - F.coalesce("stored", F.lit(0))
    return b.crossJoin(t).select(gap.alias("reality_gap"), (gap < 10).alias("is_synced"), "blocks", "transfers")


def desync_pulse(samples: DataFrame, actual: DataFrame) -> DataFrame:
    """Samples whose recorded head isn't the chain's, with the distance to what was fetched. actual: sample_id, head."""
    rows = samples.join(actual, "sample_id")
    return rows.select("sample_id", (F.col("head") != F.col("latest")).alias("desynced"), (F.col("head") - F.col("fetched")).alias("distance"))
