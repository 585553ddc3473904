"""Numbering and running sums that no single task does for a large group or the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def dense_index(df: DataFrame, key: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the position of each row by an integer key, from 0. Keys are cut into ranges of `width`; only the counts
    of ranges are summed in one task, rows are numbered within their range. Equal keys get different positions in any order; a null
    key comes first."""
    cell = F.floor(F.col(key) / width)
    counts = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = df.withColumn("_cell", cell)
    rows = rows.join(counts, rows["_cell"].eqNullSafe(counts["_cell"])).drop(counts["_cell"])
    within = Window.partitionBy("_cell").orderBy(key)
    return rows.withColumn(name, (F.col("_before") + F.row_number().over(within) - 1).cast("long")).drop("_cell", "_before")


def gaps(df: DataFrame, group: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with each value less the one before it in its group (the first as it is). A group is cut into ranges of values, so
    one of any size is spread over tasks."""
    cell = F.floor(F.col(value) / width)
    rows = df.withColumn("_cell", cell)
    last = rows.groupBy(group, "_cell").agg(F.max(value).alias("_max"))
    last = last.select(group, "_cell", F.lag("_max").over(Window.partitionBy(group).orderBy("_cell")).alias("_carry"))
    rows = rows.join(last, [group, "_cell"])
    before = F.lag(value).over(Window.partitionBy(group, "_cell").orderBy(value))
    return rows.withColumn(name, F.col(value) - F.coalesce(before, "_carry", F.lit(0))).drop("_cell", "_carry")


def running(df: DataFrame, group: str, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the running sum of value in its group by a non-negative integer order, in two steps as above."""
    rows = df.withColumn("_cell", F.floor(F.col(order) / width))
    sums = rows.groupBy(group, "_cell").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, [group, "_cell"]).withColumn(name, F.col("_before") + F.sum(value).over(within)).drop("_cell", "_before")


def ranked(df: DataFrame, by: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group; Spark cuts each partition's groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
