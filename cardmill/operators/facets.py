"""Facets of files from names and folders, their coverage and their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import ranked

SHOWN = {"format": 5, "argtype": 10, "position": 8, "collection": 12}  # values offered of each facet
YEARS = 8


def of_names(files: DataFrame) -> DataFrame:
    """(file_id, position, argtype, format, year): what the stem says; format is Policy where it says nothing."""
    stem = F.coalesce("stem", F.lit(""))
    return files.select("file_id", T.position(stem).alias("position"), T.first_match(stem, T.ARGTYPES).alias("argtype"), F.coalesce(T.first_match(stem, T.FORMATS), F.lit("Policy")).alias("format"), T.season(stem).alias("year"))


def of_names_first(files: DataFrame) -> DataFrame:
    """The same by the earlier patterns, which need a word boundary, with the attribution in parentheses."""
    stem = F.coalesce("stem", F.lit(""))
    positions = tuple((p, rf"\b{p}\b") for p in T.POSITIONS)
    return files.select(
        "file_id", T.first_match(stem, positions).alias("position"), T.first_match(stem, T.ARGTYPES_FIRST).alias("argtype"), F.coalesce(T.first_match(stem, T.FORMATS_FIRST), F.lit("Policy")).alias("format"),
        T.year_first(stem).alias("year"), F.nullif(T.clean(F.regexp_extract(stem, T.ATTRIBUTION, 1)), F.lit("")).alias("attribution"),
    )


def of_paths(rows: DataFrame, key: str, folder: str, folders: T.FolderMap | None = None) -> DataFrame:
    """(key, topic, year, position, argtype, division, collection): what the folder says; all null for no folder."""
    folders = folders or T.FolderMap()
    c = F.nullif(F.col(folder), F.lit(""))
    parts = T.segments(c)
    return rows.select(
        key, T.path_topic(c, folders).alias("topic"), T.path_year(c).alias("year"), T.deepest(parts, folders.position).alias("position"), T.deepest(parts, folders.argtype).alias("argtype"),
        T.path_division(c, folders).alias("division"), T.path_collection(c).alias("collection"),
    )


def combined(files: DataFrame, folders_of: DataFrame, folders: T.FolderMap | None = None) -> DataFrame:
    """(file_id, position, argtype, format, year, topic, division, orig_folder, collection): the name first, the folder where the
    name says nothing. folders_of: stem, folder (a row a stem)."""
    named = files.join(folders_of.select("stem", "folder"), "stem", "left")
    stem = F.coalesce("stem", F.lit(""))
    mine = named.select("file_id", F.col("folder").alias("orig_folder"), T.position(stem).alias("p"), T.first_match(stem, T.ARGTYPES).alias("a"), T.first_match(stem, T.FORMATS).alias("f"), T.season(stem).alias("y"))
    theirs = of_paths(named, "file_id", "folder", folders)
    both = mine.join(theirs, "file_id")
    return both.select("file_id", F.coalesce("p", "position").alias("position"), F.coalesce("a", "argtype").alias("argtype"), F.coalesce("f", "division", F.lit("Policy")).alias("format"), F.coalesce("y", "year").alias("year"), "topic", "division", "orig_folder", "collection")


def updated(files: DataFrame, folders_of: DataFrame, folders: T.FolderMap | None = None) -> DataFrame:
    """A new version of files with these facets in place of its own, in the same order of columns; new ones come last."""
    found = combined(files, folders_of, folders)
    new = [c for c in found.columns if c != "file_id"]
    order = [*files.columns, *(c for c in new if c not in files.columns)]
    return files.drop(*new).join(found, "file_id").select(*order)


def coverage(files: DataFrame) -> DataFrame:
    """(facet, n, percent): files that have each facet. No files give 0 percent."""
    names = ("division", "collection", "argtype", "position", "year", "topic")
    counts = files.agg(F.count("*").alias("_n"), *(F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in names))
    rows = counts.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("n")) for c in names))).alias("r"))
    return rows.select("r.facet", "r.n", F.when(F.col("_n") > 0, F.round(F.col("r.n") / F.col("_n") * 100, 4)).otherwise(0.0).alias("percent"))


def top_values(files: DataFrame, facet: str, most: int, unlabelled: str | None = None) -> DataFrame:
    """(value, n): the most frequent values, ties by value; null ones left out or under a name."""
    value = F.coalesce(F.col(facet), F.lit(unlabelled)) if unlabelled else F.col(facet)
    return files.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("value is not null").orderBy(F.desc("n"), "value").limit(most)


def vocabulary(files: DataFrame) -> DataFrame:
    """(facet, value, rank): values offered for browsing, most frequent first; years of digits only, newest first, so seasons such as
    2025-26 are never offered."""
    each = files.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in SHOWN))).alias("x")).select("x.facet", "x.value").where("value <> ''")
    counts = each.groupBy("facet", "value").agg(F.count("*").alias("n"))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv)), F.col("facet"))
    chips = ranked(counts, ["facet"], [F.desc("n"), "value"], max(SHOWN.values())).where(F.col("rank") <= most)
    years = files.where(F.regexp_like("year", F.lit("^[0-9]+$"))).select(F.lit("year").alias("facet"), F.col("year").alias("value")).distinct()
    years = ranked(years, ["facet"], [F.desc("value")], YEARS)
    return chips.select("facet", "value", "rank").unionByName(years.select("facet", "value", "rank"))
