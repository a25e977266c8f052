"""Data-quality and integrity jobs over blocks and transfers (Q)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions.chain import CREATION
from ledgerlake.functions.fixed import NETWORKS
from ledgerlake.operators.neighbors import WIDTH, with_neighbor
from ledgerlake.operators.relational import is_synthetic, not_null
from ledgerlake.operators.windows import chain_breaks


def _status(issues: Column) -> Column:
    return F.when(issues == 0, "PASS").otherwise("FAIL")


def hash_self_reference(blocks: DataFrame) -> DataFrame:
    """Q01: blocks that name themselves as parent."""
    return blocks.where(F.col("hash") == F.col("parent_hash")).select("number", "hash")


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    """Q02."""
    return blocks.agg((F.count("*") - F.countDistinct("number")).alias("issues"))


def gap_summary(blocks: DataFrame) -> DataFrame:
    """Q03: numbers missing between the least and the greatest."""
    missing = F.coalesce(F.max("number") - F.min("number") + 1 - F.countDistinct("number"), F.lit(0))
    return blocks.agg(missing.alias("missing")).select("missing", _status(F.col("missing")).alias("verdict"))


def linked_ratio(blocks: DataFrame) -> DataFrame:
    """Q04: blocks but the first whose parent is known, of all but the first."""
    first = F.broadcast(blocks.agg(F.min("number").alias("_first")))  # one row
    rows = blocks.crossJoin(first).where(F.col("number") > F.col("_first"))
    known = blocks.select(F.col("hash").alias("_h")).distinct()
    linked = rows.join(known, F.col("parent_hash") == F.col("_h"), "left").agg(F.count("*").alias("total"), F.count("_h").alias("linked"))
    return linked.select("linked", "total", F.when(F.col("linked") == F.col("total"), "PASS").otherwise("FAIL").alias("verdict"))


def orphans(blocks: DataFrame) -> DataFrame:
    known = blocks.where("hash IS NOT NULL").select(F.col("hash").alias("_h"))
    return blocks.where("number > 0 AND parent_hash IS NOT NULL").join(known, F.col("parent_hash") == F.col("_h"), "left_anti")


def synthetic_summary(transfers: DataFrame) -> DataFrame:
    """Q05."""
    rows = transfers.agg(F.count_if(is_synthetic(F.col("from_address"))).alias("synthetic"), F.count("*").alias("total"))
    return rows.select("synthetic", "total", F.round(F.try_divide(F.col("synthetic") * 100.0, F.col("total")), 2).alias("percent"), _status(F.col("synthetic")).alias("verdict"))


CHECKS = ["self_reference", "chain_break", "timestamp_anomaly", "orphan", "duplicate", "synthetic"]
#: What each check is worth of 100 points.
WEIGHTS = {"self_reference": 10, "chain_break": 20, "timestamp_anomaly": 15, "orphan": 20, "duplicate": 15, "synthetic": 20}


def ordered_checks(blocks: DataFrame, seconds: float = 5, width: int = WIDTH) -> DataFrame:
    """One row: the issues of the three checks that one pass over the blocks in the order of their numbers answers.

    A number is a new one where the row before has another, so distinct numbers need no shuffle of their own.
    """
    rows = with_neighbor(blocks.select("number", "hash", "parent_hash", "processed_at_ms"), "number", ["number", "processed_at_ms"], "prev", width=width)
    new = F.col("number").isNotNull() & ~F.col("number").eqNullSafe(F.col("prev.number"))
    return rows.agg(
        F.count_if(F.col("hash") == F.col("parent_hash")).alias("self_reference"),
        F.count_if((F.col("prev.processed_at_ms") - F.col("processed_at_ms")) / 1000.0 > seconds).alias("timestamp_anomaly"),
        (F.count("*") - F.count_if(new)).alias("duplicate"),
    )


def audit_report(blocks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Q07: check, issues, status; one row a check."""
    ordered = ["self_reference", "timestamp_anomaly", "duplicate"]
    issues = [F.struct(F.lit(c).alias("check_name"), F.col(c).alias("issues")) for c in ordered]
    count = lambda name, df: df.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check_name"), "issues")
    rows = [
        ordered_checks(blocks).select(F.inline(F.array(*issues))),
        count("chain_break", chain_breaks(blocks)),
        count("orphan", orphans(blocks)),
        synthetic_summary(transfers).select(F.lit("synthetic").alias("check_name"), F.col("synthetic").alias("issues")),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("status", _status(F.col("issues")))


def quality_score(report: DataFrame) -> DataFrame:
    """Q06: the points of passed checks, and a grade."""
    points = F.lit(0)
    for name, weight in WEIGHTS.items():
        points = points + F.when((F.col("check_name") == name) & (F.col("issues") == 0), weight).otherwise(0)
    score = report.agg(F.sum(points).alias("score"))
    return score.select("score", F.when(F.col("score") >= 95, "EXCELLENT").when(F.col("score") >= 85, "GOOD").otherwise("FAIL").alias("grade"))


def recent_chain_audit(blocks: DataFrame, n: int = 1000) -> DataFrame:
    """Q08: broken links and gaps among the newest n blocks; a window over at most n rows."""
    newest = blocks.orderBy(F.desc("number")).limit(n)
    w = W.orderBy("number")
    rows = newest.withColumn("prev", F.lag(F.struct("number", "hash")).over(w))
    follows = F.col("number") == F.col("prev.number") + 1
    out = rows.agg(
        F.count("*").alias("blocks"),
        F.max("number").alias("head"),
        F.count_if(F.col("prev").isNotNull() & ~follows).alias("sequence_gaps"),
        F.count_if(F.col("prev").isNotNull() & follows & (F.col("parent_hash") != F.col("prev.hash"))).alias("broken_links"),
    )
    issues = F.col("sequence_gaps") + F.col("broken_links")
    return out.select("*", F.when(F.col("blocks") < 2, "INSUFFICIENT").when(issues == 0, "PASS").otherwise("FAIL").alias("verdict"))


def sample_hash_audit(local: DataFrame, canonical: DataFrame, samples: int = 5, step: int = 10, lookback: int = 1000) -> DataFrame:
    """Q09: hashes at the greatest height and every `step` below it, against the canonical ones."""
    top = local.agg(F.max("number").alias("top"))  # one row
    heights = top.select("top", F.explode(F.expr(f"transform(sequence(0, {samples - 1}), k -> top - k * {step})")).alias("number")).where((F.col("number") >= F.col("top") - lookback) & (F.col("number") >= 0))
    rows = F.broadcast(heights.select("number"))  # as many rows as samples
    a = local.join(rows, "number").select("number", F.lower("hash").alias("local_hash"))
    b = canonical.join(rows, "number").select("number", F.lower("hash").alias("canonical_hash"))
    both = heights.select("number").join(a, "number", "left").join(b, "number", "left")
    status = F.when(F.col("local_hash").isNull(), "MISSING_LOCAL").when(F.col("canonical_hash").isNull(), "MISSING_CANONICAL").when(F.col("local_hash") == F.col("canonical_hash"), "MATCH").otherwise("HASH_MISMATCH")
    return both.select("number", status.alias("status"))


def repair_parent_hash(blocks: DataFrame, canonical: DataFrame, zero: str) -> DataFrame:
    """Q10: parent hashes of zeros replaced from the canonical block, where there is one."""
    good = canonical.select("number", F.col("parent_hash").alias("_good"))
    out = blocks.join(good, "number", "left")
    fixed = F.when((F.col("parent_hash") == zero) & (F.col("number") > 0), F.coalesce("_good", F.col("parent_hash"))).otherwise(F.col("parent_hash"))
    return out.select("number", fixed.alias("parent_hash"), *[c for c in blocks.columns if c not in ("number", "parent_hash")])


LOCAL_CHAIN = 31337


def detect_reorg(incoming: DataFrame, stored: DataFrame, chain_id: int = 1) -> DataFrame:
    """Q11: incoming blocks that contradict the stored block before them; none on a local chain."""
    if chain_id == LOCAL_CHAIN:
        return incoming.limit(0).select("number", "parent_hash", F.col("hash").alias("stored_hash"))
    prev = stored.select((F.col("number") + 1).alias("number"), F.col("hash").alias("stored_hash"))
    return incoming.join(prev, "number").where(F.lower("parent_hash") != F.lower("stored_hash")).select("number", "parent_hash", "stored_hash")


def common_ancestor(local: DataFrame, canonical: DataFrame, height: int, back: int = 1000) -> DataFrame:
    """Q12: the greatest number up to height, over 0 and within `back`, with equal hashes; null where there is none."""
    near = (F.col("number") <= height) & (F.col("number") > 0) & (F.col("number") >= height - back)
    a, b = local.where(near).select("number", F.lower("hash").alias("h")), canonical.where(near).select("number", F.lower("hash").alias("h"))
    return a.join(b, ["number", "h"]).agg(F.max("number").alias("ancestor"))


def rollback(blocks: DataFrame, transfers: DataFrame, ancestor: int, chain_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q13: blocks and transfers up to the ancestor, and the chain's checkpoint there."""
    point = blocks.sparkSession.createDataFrame([(chain_id, ancestor)], "chain_id long, last_synced_block long")
    return blocks.where(F.col("number") <= ancestor), transfers.where(F.col("block_number") <= ancestor), point


def prune_future(blocks: DataFrame, transfers: DataFrame, cursors: DataFrame, head: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q14: nothing beyond the head; cursors clamped to it."""
    clamped = cursors.withColumn("last_synced_block", F.least("last_synced_block", F.lit(head)))
    return blocks.where(F.col("number") <= head), transfers.where(F.col("block_number") <= head), clamped


def cascade_check(transfers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Q15: transfers without a block."""
    return transfers.join(blocks.select(F.col("number").alias("block_number")), "block_number", "left_anti")


def leap_sync(samples: DataFrame, head: str = "latest", stored: str = "synced", gap: int = 1000, reset: int = 100000) -> DataFrame:
    """Q16: what to do about each pair of heights, and the cursor that follows."""
    d = F.col(head) - F.col(stored)
    action = F.when(F.col(stored) > F.col(head), "PRUNE").when(d > reset, "RESET_REQUIRED").when(d > gap, "LEAP").otherwise("ALIGNED")
    cursor = F.when(F.col(stored) > F.col(head), F.col(head)).when(d > gap, F.col(head) - 1).otherwise(F.col(stored))
    return samples.withColumn("action", action).withColumn("cursor", cursor)


def height_snapshot(samples: DataFrame, tolerance: int = 5) -> DataFrame:
    """Q17: lag and drift, 0 at least, and whether the index is ahead of the chain by more than the tolerance."""
    lag, drift = F.greatest(F.col("latest") - F.col("synced"), F.lit(0)), F.greatest(F.col("synced") - F.col("latest"), F.lit(0))
    return samples.withColumn("lag", lag).withColumn("drift", drift).withColumn("is_time_travel", drift > tolerance)


def checkpoint_consistent(checkpoints: DataFrame, blocks: DataFrame) -> DataFrame:
    """Q18: whether checkpoints stay within the stored heights."""
    top = F.broadcast(blocks.agg(F.max("number").alias("max_number")))  # one row
    return checkpoints.crossJoin(top).select("chain_id", "last_synced_block", "max_number", (F.col("last_synced_block") <= F.coalesce("max_number", F.lit(0))).alias("consistent"))


def watermark_audit(samples: DataFrame) -> DataFrame:
    """Q19: fetched raised to synced, the state where the chain fell behind, and the invariants."""
    fixed = F.greatest("fetched", "synced")
    return samples.select(
        "chain_id", "sample_id", fixed.alias("fetched"),
        (F.col("fetched") < F.col("synced")).alias("inverted"),
        F.when((F.col("latest") > 0) & (F.col("latest") < F.col("synced")), "STALLED").otherwise("RUNNING").alias("state"),
        ((F.col("synced") <= F.col("fetched")) & (F.col("fetched") <= F.col("latest"))).alias("ordered"),
    )


def tear_detection(samples: DataFrame, idle_ms: int = 120_000, gap: int = 1000) -> DataFrame:
    """Q20: a healing plan for samples (latest, synced, expected, idle_ms) that stand still far behind the head."""
    torn = (F.col("idle_ms") >= idle_ms) & (F.col("latest") - F.col("synced") > gap) & (F.col("expected") < F.col("latest") - gap)
    return samples.where(torn).select("chain_id", "sample_id", (F.col("latest") - 1).alias("cursor"), (F.col("synced") + 1).alias("refetch_from"), F.col("latest").alias("refetch_to"))


def transfer_sanity(transfers: DataFrame) -> DataFrame:
    """Q21: a row for each field of a transfer that breaks its rule."""
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("^0x.{40}$")
    rules = {
        "from_address": plain("from_address") | F.col("from_address").isin("0xunknown", "0x0"),
        "to_address": plain("to_address") | F.coalesce(F.col("to_address"), F.lit("")).isin(CREATION, "0x0", "multiple", ""),
        "tx_hash": F.coalesce(F.col("tx_hash"), F.lit("")).rlike("^0x.{64}$"),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return transfers.select("block_number", "log_index", "tx_hash", F.explode(broken).alias("field"))


def constraint_audit(blocks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Q22: rows that break the tables' not-null, unique and reference constraints."""
    nulls = lambda df, cols: df.agg(F.count_if(~not_null(cols)).alias("issues"))
    extra = lambda df, cols: df.groupBy(*cols).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issues"))
    rows = {
        "blocks_not_null": nulls(blocks, ["number", "hash", "parent_hash", "timestamp"]),
        "blocks_unique_number": extra(blocks, ["number"]),
        "blocks_unique_hash": extra(blocks, ["hash"]),
        "transfers_not_null": nulls(transfers, ["block_number", "log_index", "tx_hash"]),
        "transfers_unique_key": extra(transfers, ["block_number", "log_index"]),
        "transfers_block_exists": cascade_check(transfers, blocks).agg(F.count("*").alias("issues")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("constraint_name"), "issues") for k, df in rows.items()])


def network_name(chain_id: Column) -> Column:
    out = None
    for k, name in NETWORKS.items():
        out = F.when(chain_id == k, name) if out is None else out.when(chain_id == k, name)
    return out.otherwise("unknown")


def chain_id_guard(rows: DataFrame, expected: int) -> DataFrame:
    """Q23: rows as they are; the job fails where a row belongs to another chain."""
    wrong = F.coalesce(F.col("chain_id") != expected, F.lit(True))
    text = F.concat(F.lit(f"expected chain {expected}, found "), F.coalesce(F.col("chain_id").cast("string"), F.lit("none")))
    return rows.where(F.when(wrong, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def content_digest(rows: DataFrame) -> DataFrame:
    """Q24: count and an order-free hash of the rows; equal runs give equal digests."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    total = F.coalesce(F.sum(own.cast("decimal(20,0)")), F.lit(0)).cast("string")  # repeated rows cancel in bit_xor, not in the sum
    return rows.agg(F.count("*").alias("n"), F.concat_ws(":", F.hex(F.coalesce(F.bit_xor(own), F.lit(0))), total).alias("content"))
