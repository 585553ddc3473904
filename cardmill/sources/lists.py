"""Small text inputs: manifests of moved files, lists of queries, relevance judgements."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FolderMap
from ..operators.vectors import dequantised


def manifest(lines: DataFrame) -> DataFrame:
    """(stem, folder): where a file was, from lines (source, line_no, line) of an old path and then "    -> new name   [what became of it]". A new
    name goes with the path right before it; blank lines and those that begin with =, Original or Format don't come between.
    The last line of a stem counts; files of no folder have no row."""
    arrow = F.startswith("line", F.lit("    -> "))
    noise = (F.col("line") == "") | F.regexp_like("line", F.lit("^(=|Original|Format)"))
    rows = lines.where(arrow | ~noise).select("source", "line_no", "line", arrow.alias("arrow"))
    w = Window.partitionBy("source").orderBy("line_no")
    pairs = rows.select("*", F.lag("line").over(w).alias("old"), F.lag("arrow").over(w).alias("after_arrow")).where("arrow and not after_arrow")
    new = F.trim(F.substring_index(F.substring("line", 8, 1 << 20), "   [", 1))
    stem = F.regexp_replace(F.substring_index(new, "/", -1), r"(?<=.)\.[^.]*$", "")
    old = F.trim("old")
    folder = F.when(F.contains(old, F.lit("/")), F.regexp_replace(old, "/[^/]*$", "")).otherwise("")
    found = pairs.select(stem.alias("stem"), folder.alias("folder"), "source", "line_no").where("folder not in ('', '.')")
    return found.groupBy("stem").agg(F.max_by("folder", F.struct("source", "line_no")).alias("folder"))


def manifest_file(spark: SparkSession, path: str) -> DataFrame:
    """The manifest in a text file; no rows if there is no such file."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "stem string, folder string")
    # one file is one row, so that its lines keep their order
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return manifest(text.select("source", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, q): a query a line; blank lines and those that begin with # are none."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "q"))
    return text.select(F.col("query_id").cast("long").alias("query_id"), F.trim("q").alias("q")).where("q <> '' and q not like '#%'")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(q, stem) from a JSON object of queries and lists of stems."""
    with open(path, encoding="utf-8") as f:
        pairs = [(q, s) for q, stems in json.load(f).items() for s in stems]
    return spark.createDataFrame(pairs, "q string, stem string")


def folder_map(path: str | None) -> FolderMap:
    """The user's map in a JSON file over the defaults; the defaults if there is no such file."""
    if not path or not os.path.exists(path):
        return FolderMap()
    with open(path, encoding="utf-8") as f:
        return FolderMap(json.load(f))


def vectors(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table of quantised vectors, with `v` as numbers again."""
    return dequantised(spark.read.parquet(f"{folder}/{name}"))
