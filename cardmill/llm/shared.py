"""What the operators share: reading, cutting lineage, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there. The folder is the session's; only where none is
    set and all runs on this machine, a temporary one is made."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the smallest node that links lead to, for each node of an edge. Alternates large-star and
    small-star steps, each a min-aggregation and a join, until no edge changes; nothing is gathered on the driver but
    one count and sum for each round. Null ends and loops are dropped, repeated edges count once. Raises if it hasn't
    ended after `most` rounds (rounds grow with the logarithm of the longest chain)."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = cut(e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    state = None
    for _ in range(most):
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        e = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()  # large-star
        low = e.groupBy("x").agg(F.min("y").alias("m"))
        e = e.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("p")).select("p.x", "p.y").where("x <> y").distinct()  # small-star
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state:
            return e.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "node").union(e.select("y", "y").distinct())
        state = now
    raise RuntimeError("the components did not settle")


def islands(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): the union of each key's spans; spans that touch become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
