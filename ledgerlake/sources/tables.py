"""Scans of tables and plans of work (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files; its filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, *, column: str = "number", low: int = 0, high: int = 1, parts: int = 64, options: dict[str, str] | None = None) -> DataFrame:
    """S05 over JDBC: read in parts by ranges of a column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(options or {}))
    return reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def write_blocks(blocks: DataFrame, path: str, size: int = 100_000) -> None:
    """Blocks in folders of number ranges, sorted in files, so scans of a range read few files."""
    rows = blocks.withColumn("number_range", F.floor(F.col("number") / size))
    rows.repartition("number_range").sortWithinPartitions("number").write.partitionBy("number_range").mode("append").parquet(path)


def scan_written_range(spark: SparkSession, path: str, start: int, end: int, size: int = 100_000) -> DataFrame:
    """S01 over what write_blocks() wrote: folders outside the range aren't listed for reading."""
    rows = spark.read.parquet(path).where(F.col("number_range").between(start // size, end // size))
    return rows.where(F.col("number").between(start, end)).drop("number_range")


def load_token_dim(metadata: DataFrame) -> DataFrame:
    """The token dimension with lower-case addresses, one row an address; Spark broadcasts it while it is small."""
    return metadata.groupBy(F.lower("address").alias("address")).agg(F.max_by(F.struct("symbol", "decimals"), F.struct("symbol", "decimals")).alias("m")).select("address", "m.symbol", "m.decimals")


def plan_backfill_ranges(spans: DataFrame, step: int = 50) -> DataFrame:
    """range_start, range_end of the work in spans (start, end, head); both ends are included, so a range has step + 1 numbers."""
    rows = spans.withColumn("end", F.least("end", "head")).where(F.col("start") <= F.col("end"))
    rows = rows.select("end", F.explode(F.sequence("start", "end", F.lit(step + 1).cast("long"))).alias("range_start"))
    return rows.select("range_start", F.least(F.col("range_start") + step, F.col("end")).alias("range_end"))


def parent_anchor(blocks: DataFrame, canonical: DataFrame, start: int) -> DataFrame:
    """Blocks with the canonical block before start, where it is absent."""
    if start <= 0:
        return blocks
    anchor = canonical.where(F.col("number") == start - 1).join(blocks.where(F.col("number") == start - 1).select("number"), "number", "left_anti")
    return blocks.unionByName(anchor.select(*blocks.columns))
