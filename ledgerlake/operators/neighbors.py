"""Neighbours in a global order without gathering all rows in one task.

Rows are grouped by ranges of the key. Within a range a window sees the neighbour; the first or last row of a range takes it
from the edge of the nearest range that has rows. The frame of edges has a row for each range of `width` key values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 100_000


def _ranged(df: DataFrame, key: str, width: int, by: list[str]) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_range", F.floor(F.col(key) / width)), [*by, "_range"]


def with_neighbor(df: DataFrame, key: str, columns: list[str], out: str, *, ahead: bool = False, by: list[str] = [], ties: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """df with a struct `out` of the columns of the row before (or ahead) in the order of key and ties, per `by`."""
    rows, parts = _ranged(df, key, width, by)
    order = [key, *ties]
    window = W.partitionBy(*parts).orderBy(*order)
    value = F.struct(*columns)
    rows = rows.withColumn("_near", (F.lead if ahead else F.lag)(value).over(window))
    pick = F.min_by if ahead else F.max_by
    edge = rows.groupBy(*parts).agg(pick(value, F.struct(*order)).alias("_edge"))
    across = W.partitionBy(*by).orderBy("_range") if by else W.orderBy("_range")  # a row for each range
    target = (F.lag if ahead else F.lead)("_range").over(across)
    edge = edge.select(*by, target.alias("_range"), "_edge").where("_range IS NOT NULL")
    return rows.join(edge, parts, "left").withColumn(out, F.coalesce("_near", "_edge")).drop("_near", "_edge", "_range")


def carried_forward(df: DataFrame, key: str, value: Column, out: str, *, by: list[str] = [], ties: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """df with `out`: the last value that isn't null up to and with each row."""
    rows, parts = _ranged(df.withColumn("_value", value), key, width, by)
    order = [key, *ties]
    window = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(window))
    edge = rows.groupBy(*parts).agg(F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    return rows.join(edge, parts, "left").withColumn(out, F.coalesce("_own", "_before")).drop("_value", "_own", "_before", "_range")


def running_max(df: DataFrame, key: str, value: str, out: str, *, by: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """df with `out`: the greatest value up to and with each row in the order of key, per `by`; rows of equal keys count for each other."""
    rows, parts = _ranged(df, key, width, by)
    rows = rows.withColumn("_own", F.max(value).over(W.partitionBy(*parts).orderBy(key)))
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    edge = rows.groupBy(*parts).agg(F.max(value).alias("_top")).withColumn("_before", F.max("_top").over(before)).drop("_top")
    return rows.join(edge, parts, "left").withColumn(out, F.greatest("_own", "_before")).drop("_own", "_before", "_range")


def with_halo(df: DataFrame, key: str, reach: int, *, width: int = WIDTH) -> DataFrame:
    """df with `_part`, a range of the key, and `_own`: each range also gets the rows up to `reach` before it, as copies with _own false.

    A trailing window of at most `reach` within (_part, ...) is then whole for each row that a range owns.
    """
    width = max(width, reach)  # so that only the next range looks back at a row
    part = F.floor(F.col(key) / width)
    rows = df.withColumn("_home", part)
    near = F.col(key) - F.col("_home") * width >= width - reach
    parts = F.when(near, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return rows.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == F.col("_home")).drop("_home")


def with_position(df: DataFrame, key: str, out: str, *, by: list[str] = [], ties: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """df with `out`: each row's place, from 0, in the order of key and ties, per `by`. Ranges of the key are counted by themselves; only their counts are summed up in order."""
    rows, parts = _ranged(df, key, width, by)
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(*parts).orderBy(key, *ties)))
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    counts = rows.groupBy(*parts).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(counts, parts).withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_at", "_before", "_range")
