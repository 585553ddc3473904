"""Which files of an old tree to keep: copies by content, then versions by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CURATED = "Completed files"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _facts(scan: DataFrame) -> DataFrame:
    """Readable rows with the preference of their path: curated folders, shallow, short, alphabet."""
    path = F.col("path")
    curated = F.when(F.contains(path, F.lit(CURATED)), 0).otherwise(1)
    order = F.struct(curated.alias("curated"), (F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"), F.char_length(path).alias("long"), path.alias("path"))
    return scan.where("md5 is not null").select("path", "md5", F.coalesce("hl", F.lit(0)).alias("hl"), F.coalesce("words", F.lit(0)).alias("words"), order.alias("order"))


def plan(scan: DataFrame) -> DataFrame:
    """(path, disposition, version): each file is kept, a duplicate (same bytes as a preferred one), or for review (same name
    as one with more highlights, then words, then a curated path, then the least path of its content). `version` is the
    place among those of one name, null for duplicates. Files without a fingerprint have no row.

    Both steps are aggregations of least values joined back, so contents or names with any number of files are not sorted
    in one task; only versions (different contents of one name) are numbered.
    """
    facts = _facts(scan)
    best = facts.groupBy("md5").agg(F.min("order").alias("best"), F.min("path").alias("first"))
    rows = facts.join(best, "md5")
    alive = rows.where(F.col("order") == F.col("best")).withColumn("name", F.lower(name_of(F.col("path"))))
    w = Window.partitionBy("name").orderBy(F.desc("hl"), F.desc("words"), F.col("order.curated"), "first")
    alive = alive.select("path", F.row_number().over(w).alias("version"))
    alive = alive.select("path", F.when(F.col("version") == 1, "keep").otherwise("review").alias("disposition"), "version")
    gone = rows.where(F.col("order") != F.col("best")).select("path", F.lit("duplicate").alias("disposition"), F.lit(None).cast("int").alias("version"))
    return alive.unionByName(gone)


def moves(scan: DataFrame) -> DataFrame:
    """(path, new_name, disposition): where each file would go. Names in one place are made unique without case by _2, _3 in
    order of path; duplicates get ''. Nothing is moved."""
    rows = plan(scan)
    name = name_of(F.col("path"))
    at = Window.partitionBy("disposition", F.lower(name)).orderBy("path")
    k = F.row_number().over(at)
    base, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    new = F.when(k == 1, name).otherwise(F.concat(base, F.lit("_"), k.cast("string"), ext))
    words = F.when(F.col("disposition") == "keep", "kept").when(F.col("disposition") == "review", "version superseded").otherwise("exact duplicate removed")
    keep = rows.where("disposition <> 'duplicate'").select("path", new.alias("new_name"), words.alias("disposition"))
    return keep.unionByName(rows.where("disposition = 'duplicate'").select("path", F.lit("").alias("new_name"), words.alias("disposition")))


def manifest_lines(moved: DataFrame) -> DataFrame:
    """(path, text): two lines a file, old path and new name."""
    return moved.select("path", F.concat("path", F.lit("\n    -> "), F.when(F.col("new_name") == "", "(removed)").otherwise(F.col("new_name")), F.lit("   ["), "disposition", F.lit("]")).alias("text"))


def summary(scan: DataFrame) -> DataFrame:
    """One row: scanned, exact_removed, survivors, version_groups, to_review, final."""
    rows = plan(scan).select("disposition", "version").unionByName(scan.select(F.lit("scanned").alias("disposition"), F.lit(None).cast("int").alias("version")))
    n = {"scanned": F.col("disposition") == "scanned", "exact_removed": F.col("disposition") == "duplicate", "survivors": F.col("disposition").isin("keep", "review"), "version_groups": F.col("version") == 2, "to_review": F.col("disposition") == "review", "final": F.col("disposition") == "keep"}
    return rows.agg(*(F.count_if(c).alias(name) for name, c in n.items()))


def conflicts(scan: DataFrame) -> DataFrame:
    """(name, version, line): a line for each file whose name has several versions."""
    facts = plan(scan).where("version is not null").join(_facts(scan), "path").withColumn("name", F.lower(name_of(F.col("path"))))
    several = facts.where("version = 2").select("name")
    mark = F.when(F.col("version") == 1, "KEEP  ").otherwise("review")
    line = F.concat(F.lit("  "), mark, F.lit(" hl="), F.lpad(F.format_number("hl", 0), 6, " "), F.lit(" textruns="), F.lpad(F.format_number("words", 0), 7, " "), F.lit("  "), F.col("path"))
    return facts.join(several, "name").select("name", "version", line.alias("line"))
