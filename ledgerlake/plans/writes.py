"""Queries of the idempotent writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators.relational import not_null
from ledgerlake.plans.base import query
from ledgerlake.sinks import batch as K

_FIRST = "SELECT *, row_number() OVER (PARTITION BY block_number, log_index ORDER BY tx_hash, from_address, to_address, token_address, amount, activity_type, created_at) AS k FROM transfers"
_T = "block_number, log_index, tx_hash, from_address, to_address, token_address, amount, activity_type, created_at"


@query("k01_insert_blocks_if_absent", "doubled_blocks", "SELECT DISTINCT number, hash, parent_hash FROM doubled_blocks WHERE number % 3 > 0")
def k01(v):
    stored = v.blocks.where("number % 3 = 0").select("number", "hash", "parent_hash")
    return K.insert_blocks_if_absent(stored, v.doubled_blocks.select("number", "hash", "parent_hash"))


@query("k02_insert_transfers_if_absent", "transfers", f"SELECT {_T} FROM ({_FIRST}) WHERE k = 1 AND block_number % 4 > 0")
def k02(v):
    return K.insert_transfers_if_absent(v.transfers.where("block_number % 4 = 0"), v.transfers)


_CP = "SELECT chain_id, synced AS last_synced_block, ts AS updated_at, sample_id FROM status_samples"


def _points(v):
    return v.status_samples.select("chain_id", F.col("synced").alias("last_synced_block"), F.col("ts").alias("updated_at"))


@query("k04_upsert_checkpoint", "status_samples", "SELECT chain_id, arg_max(synced, ts) AS last_synced_block, max(ts) AS updated_at FROM status_samples GROUP BY 1")
def k04(v):
    rows = _points(v)
    return K.upsert_checkpoint(rows.where("last_synced_block < 3000"), rows.where("last_synced_block >= 3000"))


@query("k05_upsert_sync_status", "status_samples", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts DESC) AS k FROM status_samples)
 SELECT chain_id, latest AS latest_block, synced AS last_synced_block, greatest(latest - synced, 0) AS sync_lag, CASE WHEN sample_id % 2 = 0 THEN 'error' ELSE 'syncing' END AS status, CASE WHEN sample_id % 2 = 0 THEN 'node lost' END AS error_message, ts AS updated_at FROM s WHERE k = 1""")
def k05(v):
    samples = v.status_samples.withColumnRenamed("ts", "updated_at")
    rows = K.sync_status_rows(samples, F.when(F.col("sample_id") % 2 == 0, "node lost"))
    return K.upsert_latest(rows.limit(0), rows, ["chain_id"], ["updated_at"])


@query("k09_upsert_token_metadata", "token_metadata", "SELECT lower(address) AS address, CASE WHEN symbol IN ('T1', 'T3') THEN symbol || 'x' ELSE symbol END AS symbol, CASE WHEN symbol IN ('T1', 'T3') THEN 9 ELSE decimals END AS decimals FROM token_metadata")
def k09(v):
    old = v.token_metadata.withColumn("updated_at", F.lit(1))
    new = v.token_metadata.where("symbol IN ('T1', 'T3')").select(F.upper("address").alias("address"), F.concat("symbol", F.lit("x")).alias("symbol"), F.lit(9).alias("decimals"), F.lit(2).alias("updated_at"))
    return K.upsert_token_metadata(old, new).drop("updated_at")


@query("k10_backfill_symbol", "transfers token_metadata", "SELECT block_number, log_index, tx_hash, CASE log_index % 3 WHEN 0 THEN m.symbol WHEN 1 THEN coalesce(m.symbol, '') ELSE 'OLD' END AS symbol FROM transfers LEFT JOIN token_metadata m ON m.address = token_address")
def k10(v):
    k = F.col("log_index") % 3
    rows = v.transfers.withColumn("symbol", F.when(k == 1, "").when(k == 2, "OLD"))
    return K.backfill_symbol(rows, v.token_metadata).select("block_number", "log_index", "tx_hash", "symbol")


@query("k11_quarantine", "blocks", "SELECT number, CASE WHEN number % 31 = 4 THEN 'not_null' || CASE WHEN number % 7 = 0 THEN ',height' ELSE '' END ELSE 'height' END AS reasons FROM blocks WHERE number % 31 = 4 OR number % 7 = 0")
def k11(v):
    rows = v.blocks.select("number", F.when(F.col("number") % 31 != 4, F.col("hash")).alias("hash"))
    return K.quarantine(rows, {"not_null": not_null(["hash"]), "height": F.col("number") % 7 != 0})[1].select("number", "reasons")
