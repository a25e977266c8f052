"""Idempotent writes as functions of the stored and the new rows (K), and their commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import audit
from ledgerlake.operators.neighbors import with_position
from ledgerlake.sinks.store import Store

TRANSFER_ORDER = ["tx_hash", "from_address", "to_address", "token_address", "amount", "activity_type", "created_at"]


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by `order`, which should name every other column, so the choice is the same on each run."""
    own = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in own if c not in order])).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def new_rows(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to append so that each key is stored once and stored rows stay."""
    return first_of(rows, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def insert_blocks_if_absent(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return new_rows(stored, rows, ["number"], ["hash"])


def insert_transfers_if_absent(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return new_rows(stored, rows, ["block_number", "log_index"], [c for c in TRANSFER_ORDER if c in rows.columns])


def append_bulk(rows: DataFrame, path: str) -> None:
    """Append without looking at what is stored."""
    rows.write.mode("append").parquet(path)


def upsert_latest(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the last row of each key; new rows go before stored ones of equal order."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max(F.struct(*order, "_new", *[c for c in values if c not in order and c != "_new"])).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in both.columns if c != "_new"])


def upsert_checkpoint(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """chain_id, last_synced_block, updated_at."""
    return upsert_latest(stored, rows, ["chain_id"], ["updated_at"])


def sync_status_rows(samples: DataFrame, error: Column | None = None) -> DataFrame:
    """Status rows of samples (chain_id, latest, synced, updated_at); the lag is 0 at least. error: a message, where one is."""
    error = F.lit(None).cast("string") if error is None else error
    return samples.select(
        "chain_id", F.col("latest").alias("latest_block"), F.col("synced").alias("last_synced_block"),
        F.greatest(F.col("latest") - F.col("synced"), F.lit(0)).alias("sync_lag"),
        F.when(error.isNotNull(), "error").otherwise("syncing").alias("status"), error.alias("error_message"), "updated_at",
    )


def upsert_token_metadata(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyed by the lower-case address."""
    lower = lambda df: df.withColumn("address", F.lower("address"))
    return upsert_latest(lower(stored), lower(rows), ["address"], ["updated_at"])


def backfill_symbol(transfers: DataFrame, dim: DataFrame) -> DataFrame:
    """Symbols from the dimension where transfers have none."""
    known = dim.select(F.lower("address").alias("_token"), F.col("symbol").alias("_symbol"))
    out = transfers.join(known, F.lower("token_address") == F.col("_token"), "left")
    symbol = F.when(F.coalesce("symbol", F.lit("")) == "", F.coalesce("_symbol", "symbol")).otherwise(F.col("symbol"))
    return out.select(*[c for c in transfers.columns if c != "symbol"], symbol.alias("symbol"))


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the names of the rules they break (a rule that isn't true is broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = rows.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0).withColumn("reasons", F.concat_ws(",", "reasons"))


BLOCKS = "number long, hash string, parent_hash string, timestamp long, gas_limit long, gas_used long, transaction_count int, processed_at_ms long"
CHECKPOINTS = "chain_id long, last_synced_block long, updated_at timestamp"


def commit_batch(store: Store, batch_id: int, chain_id: int, blocks: DataFrame, transfers: DataFrame, now: Column, run: str = "") -> bool:
    """Blocks, transfers and the checkpoint at the batch's greatest height (never lower than before), together.

    Of what is stored, only folders whose bounds meet the batch's numbers are compared with it.
    """
    if batch_id <= store.committed(run):
        return False
    ends = [F.min("k").alias("low"), F.max("k").alias("high")]
    own = blocks.select(F.col("number").alias("k")).agg(*ends).head()
    other = transfers.select(F.col("block_number").cast("long").alias("k")).agg(*ends).head()
    stored = lambda name, rows, b: store.read(name, rows.schema, b.low, b.high) if b.low is not None else rows.limit(0)
    new_blocks = insert_blocks_if_absent(stored("blocks", blocks, own), blocks)
    new_transfers = insert_transfers_if_absent(stored("transfers", transfers, other), transfers)
    point = store.spark.createDataFrame([(chain_id, own.high)], "chain_id long, last_synced_block long").where("last_synced_block IS NOT NULL").withColumn("updated_at", now)
    points = store.read("checkpoints", CHECKPOINTS).unionByName(point)
    latest = points.groupBy("chain_id").agg(F.max("last_synced_block").alias("last_synced_block"), F.max("updated_at").alias("updated_at"))
    return store.commit(batch_id, {"blocks": new_blocks, "transfers": new_transfers}, {"checkpoints": latest}, run)


def flush_batches(tasks: DataFrame, most: int = 200, every_ms: int = 500) -> DataFrame:
    """K06's cadence: tasks (task_id, height, arrival_ms) with the flush that commits each: a clock flushes every `every_ms` what has
    gathered since its last beat, and `most` tasks are flushed at once. Adds beat, part, and reason (count or age). Beats are independent of each other.
    """
    return parts_of_beats(tasks.withColumn("beat", F.floor(F.col("arrival_ms") / every_ms)), most)


def parts_of_beats(tasks: DataFrame, most: int, slice_ms: int = 25) -> DataFrame:
    """tasks with part, from 0 in each beat, and reason (count: the part is full). A beat is counted in slices of its time, so no task holds one whole."""
    rows = with_position(tasks, "arrival_ms", "_place", by=["beat"], ties=["task_id"], width=slice_ms)
    rows = rows.join(tasks.groupBy("beat").agg(F.count("*").alias("_n")), "beat")
    rows = rows.withColumn("part", F.floor(F.col("_place") / most))
    return rows.withColumn("reason", F.when((F.col("part") + 1) * most <= F.col("_n"), "count").otherwise("age")).drop("_n", "_place")


def flushes(tasks: DataFrame, most: int = 200, every_ms: int = 500) -> DataFrame:
    """The commits of a cadence: beat, part, reason, tasks, and the checkpoint that each sets."""
    return flush_batches(tasks, most, every_ms).groupBy("beat", "part", "reason").agg(F.count("*").alias("tasks"), F.max("height").alias("checkpoint"))


TASKS = "task_id long, height long, arrival_ms long"
FLUSHED = f"{TASKS}, beat long, part long, reason string"
CADENCE = "beat long, parts long"


def commit_due(store: Store, batch_id: int, tasks: DataFrame, clock_ms: int | None, chain_id: int, now: Column, *, most: int = 200, every_ms: int = 500, run: str = "") -> bool:
    """K06's cadence over triggers: what is due of the started batch and the new tasks goes into the table `flushed`, the rest waits on.

    Due are full parts of `most` tasks, and all tasks of beats that ended at the clock (clock_ms: None ends them all, as a writer
    that stops does). Waiting tasks lie in the table `started`, and `cadence` has the open beat with its parts flushed so far. Both,
    the flushed tasks and the checkpoint (the greatest flushed height, never lower than before) change in one commit. A task that
    comes after its beat has ended counts for the open one.
    """
    if batch_id <= store.committed(run):
        return False
    held = store.read("cadence", CADENCE).head()  # one row at most
    beat, parts = (held.beat, held.parts) if held else (None, 0)
    tasks = tasks.select("task_id", "height", "arrival_ms").unionByName(store.read("started", TASKS))
    at = F.floor(F.col("arrival_ms") / every_ms)
    rows = parts_of_beats(tasks.withColumn("beat", at if beat is None else F.greatest(at, F.lit(beat))), most)
    rows = rows.withColumn("part", F.col("part") + F.when(F.col("beat") == beat, parts).otherwise(0)).persist()
    try:
        top = rows.agg(F.max("beat")).head()[0] if clock_ms is None else clock_ms // every_ms
        open_beat = max(x for x in (top, beat, 0) if x is not None) + (clock_ms is None)
        due = (F.col("beat") < open_beat) | (F.col("reason") == "count")
        done = rows.where(due & (F.col("beat") == open_beat)).select("part").distinct().count() + (parts if open_beat == beat else 0)
        flushed = rows.where(due).select("task_id", "height", "arrival_ms", "beat", "part", "reason")
        point = flushed.agg(F.max("height").alias("last_synced_block")).where("last_synced_block IS NOT NULL").select(F.lit(chain_id).cast("long").alias("chain_id"), "last_synced_block", now.alias("updated_at"))
        points = store.read("checkpoints", CHECKPOINTS).unionByName(point)
        latest = points.groupBy("chain_id").agg(F.max("last_synced_block").alias("last_synced_block"), F.max("updated_at").alias("updated_at"))
        replaced = {
            "started": rows.where(~due).select("task_id", "height", "arrival_ms"),
            "cadence": store.spark.createDataFrame([(open_beat, done)], CADENCE),
            "checkpoints": latest,
        }
        return store.commit(batch_id, {"flushed": flushed}, replaced, run)
    finally:
        rows.unpersist()


def reorganise(store: Store, batch_id: int, chain_id: int, incoming: DataFrame, blocks_schema, transfers_schema, now: Column, *, back: int = 1000, run: str = "reorg") -> int | None:
    """Q11 to Q13 as one commit: if incoming (canonical) blocks contradict stored ones, find the last common block before the first
    contradiction, delete what is stored above it, with its transfers, and set the checkpoint there. The ancestor; None where
    nothing contradicts. Raises ValueError if no ancestor lies within `back` blocks; nothing is changed then.

    Only folders near the incoming numbers are read; folders above the ancestor are dropped unread.
    """
    ends = incoming.agg(F.min("number").alias("low"), F.max("number").alias("high")).head()
    if ends.low is None:
        return None
    stored = store.read("blocks", blocks_schema, ends.low - 1 - back, ends.high)
    at = audit.detect_reorg(incoming, stored, chain_id).agg(F.min("number").alias("at")).head().at
    if at is None:
        return None
    ancestor = audit.common_ancestor(stored, incoming, at - 1, back).head().ancestor
    if ancestor is None:
        raise ValueError(f"no common block within {back} before block {at}")
    point = store.spark.createDataFrame([(chain_id, ancestor)], "chain_id long, last_synced_block long").withColumn("updated_at", now)
    points = store.read("checkpoints", CHECKPOINTS).where(F.col("chain_id") != chain_id).unionByName(point)
    store.commit(batch_id, {}, {"checkpoints": points}, run, above={"blocks": ancestor, "transfers": ancestor})
    return ancestor


def tee_sinks(rows: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """The same rows to each sink; a sink that fails doesn't stop the others. sink, error."""
    rows = rows.persist()
    results = []
    try:
        for name, sink in sinks.items():
            try:
                sink(rows)
                results.append((name, None))
            except Exception as e:  # noqa: BLE001  (whatever a sink raises is its status)
                results.append((name, str(e)[:500]))
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame(results, "sink string, error string")


def capture_rows(rows: DataFrame, kind: str, ts_ms: Column) -> DataFrame:
    """Value: a JSON line for each row in the envelope of captures."""
    return rows.select(F.to_json(F.struct(ts_ms.alias("ts"), F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data"))).alias("value"))


def capture_sink(rows: DataFrame, path: str, kind: str, ts_ms: Column) -> None:
    capture_rows(rows, kind, ts_ms).write.mode("append").option("compression", "gzip").text(path)
