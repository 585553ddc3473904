"""Problem 6: best representative of each group of duplicates, by skyline selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consistent import consistent_form

# Long and short spellings of argument types in names of files; the last is the short one.
TYPES = (("counterplans", "cp"), ("counterplan", "cp"), ("disadvantages", "da"), ("disadvantage", "da"), ("disads", "da"), ("disad", "da"), ("dis ad", "da"), ("kritiks", "k"), ("kritik", "k"), ("critique", "k"), ("topicality", "t"), ("answers to", "at"), ("answer to", "at"), ("a2", "at"), ("affirmative", "aff"), ("negative", "neg"), ("framework", "fw"))
# Words after which a number is part of the name, not of a copy.
NUMBERED = ("lesson", "drill", "round", "part", "day", "week", "unit", "session", "class", "lecture", "speech", "chapter", "volume", "vol", "module", "game", "debate", "topic", "set", "test", "exercise", "number", "no")
# Words that mark a copy or a version at the end of a name.
MARKS = ("copy", "final", "edited", "edit", "updated", "update", "old", "new", "recovered", "revised", "rev", "draft", "backup", "bak", "fixed", "v", "ver", "version", r"v ?\d+", r"ver ?\d+", r"version \d+", "[1-9]")
RECENT = range(1900, 2101)  # years told apart; a proven bound of cells a group


def stem_key(df: DataFrame, key: str, stem: str) -> DataFrame:
    """(key, group_key): stems in consistent form without case, separators, marks of copying or versioning at the end (or "copy of"
    at the start), and with argument types in their short spelling. A single digit at the end is such a mark, but not
    after a word that is counted (lesson 3). Null or empty stems give ''."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for long, short in TYPES:
        text = F.replace(text, F.lit(f" {long} "), F.lit(f" {short} "))
    text = F.regexp_replace(F.trim(text), r"^(copy (\d+ )?of )+", "")
    text = F.regexp_replace(text, rf"\b({'|'.join(NUMBERED)}) (\d)\b", "$1#$2")  # not a digit of its own any more
    text = F.regexp_replace(text, rf"( ({'|'.join(MARKS)}))+$", "")
    return consistent_form(df, key, [stem]).select(key, text.alias("group_key"))


def layers(cells: list[tuple[int, int, int]]) -> list[list[int]]:
    """Indices of the cells (completeness, year, rank of trust; no rank twice) by layer of dominance: those that no other dominates,
    then those that only the first do, and so on.

    A cell's layer is one more than the greatest of the cells that dominate it. Cells are taken by falling rank, so those are
    the ones taken before that are as great in both other numbers: a maximum over a corner of a small grid.
    """
    known, when = (sorted({c[i] for c in cells}) for i in (0, 1))
    grid = np.zeros((len(known), len(when)), np.int64)
    row, column = ({x: i for i, x in enumerate(axis)} for axis in (known, when))
    out: list[list[int]] = []
    for i in sorted(range(len(cells)), key=lambda i: -cells[i][2]):
        r, c = row[cells[i][0]], column[cells[i][1]]
        layer = int(grid[r:, c:].max())
        grid[r, c] = layer + 1
        while len(out) <= layer:
            out.append([])
        out[layer].append(i)
    return out


def survivors(df: DataFrame, key: str, group: str, trust: list[str], year: Column, fields: list[str], *, least: int = 1) -> DataFrame:
    """(group, n, first_id, best_id, skyline, *fields): one surviving record for each group of at least `least` records.

    Records are compared by completeness (fields that are known), recency (year, 0 where none is known or it is not in
    1900-2100) and trust (the columns of `trust`, greater first, null below 0, ties to the smaller key). Of those that no
    record of the group dominates, the policy takes trust, then recency, then completeness; `skyline` is how many of
    them there are. Its null fields are filled from the first layer of dominance that knows the field, by the same policy.

    Records of a group with equal completeness and recency are one candidate: it has the trust of the most trusted of them,
    and of each field the value of the most trusted of them that knows it. Candidates are aggregated before the shuffle; a group
    has at most (fields + 1) * 202, so a group of any number of records is small when its layers are found. Records
    with a null group are left out. Keys must be unique; repeated rows then count once for the best, twice in n.
    """
    score = F.struct(*(F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_t{i}") for i, c in enumerate(trust)), (-F.col(key)).alias("_last"))
    known = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    when = F.coalesce(year.cast("int"), F.lit(0))
    when = F.when(when.between(RECENT.start, RECENT.stop - 1), when).otherwise(0)
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_id"), known.alias("_known"), when.alias("_year"), score.alias("_score"), *(F.col(c).alias(f"_f{i}") for i, c in enumerate(fields)))
    best = [F.max(F.when(F.col(f"_f{i}").isNotNull(), F.struct("_score", F.col(f"_f{i}").alias("value")))).alias(f"_f{i}") for i in range(len(fields))]
    cells = rows.groupBy("_g", "_known", "_year").agg(F.max("_score").alias("_score"), F.min("_id").alias("_first"), F.count("*").alias("_n"), *best)
    names = ["_known", "_year", "_score", "_first", "_n", *(f"_f{i}" for i in range(len(fields)))]
    groups = cells.groupBy("_g").agg(F.collect_list(F.struct(*names)).alias("cells"))
    id_kind = df.schema[key].dataType.simpleString()
    kinds = [df.schema[c].dataType.simpleString() for c in fields]
    schema = f"_g {df.schema[group].dataType.simpleString()}, n bigint, first_id {id_kind}, best_id {id_kind}, skyline int" + "".join(f", _f{i} {k}" for i, k in enumerate(kinds))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + len(fields))]
            for g, own in zip(batch.column("_g").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if sum(c["_n"] for c in own) < least:
                    continue
                points = [tuple(c["_score"].values()) for c in own]
                ranks = {p: r for r, p in enumerate(sorted(set(points)))}
                by_layer = layers([(c["_known"], c["_year"], ranks[p]) for c, p in zip(own, points, strict=True)])
                pick = max(by_layer[0], key=lambda i: (points[i], own[i]["_year"], own[i]["_known"]))
                row = [g, sum(c["_n"] for c in own), min(c["_first"] for c in own), -own[pick]["_score"]["_last"], len(by_layer[0])]
                for i in range(len(fields)):
                    name, value = f"_f{i}", None
                    for layer in ([pick], *by_layer):
                        known = [own[k][name] for k in layer if own[k][name] is not None]
                        known = [x for x in known if layer != [pick] or x["_score"] == own[pick]["_score"]]
                        if known:
                            value = max(known, key=lambda x: tuple(x["_score"].values()))["value"]
                            break
                    row.append(value)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [batch.schema.field("_g").type, pa.int64(), None, None, pa.int32()]
            cell = batch.schema.field("cells").type.value_type
            types[2] = types[3] = cell.field("_first").type
            types += [cell.field(f"_f{i}").type.field("value").type for i in range(len(fields))]
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_g", "n", "first_id", "best_id", "skyline", *(f"_f{i}" for i in range(len(fields)))])

    found = groups.mapInArrow(solve, schema)
    return found.select(F.col("_g").alias(group), "n", "first_id", "best_id", "skyline", *(F.col(f"_f{i}").alias(c) for i, c in enumerate(fields)))
