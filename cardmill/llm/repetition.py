"""Problem 10: repetition inside a single document, from suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .suffixes import Suffixes


def repetition(df: DataFrame, key: str, text: str, *, least: int = 8) -> DataFrame:
    """(key, n_words, repeated_words, share, longest): for each row, the words of its text that lie in a stretch
    of at least `least` words which occurs more than once in the text (occurrences may overlap), as a number and as a share
    of all its words, and the longest such stretch in words. Words are those of the lower-cased consistent form.

    Null and empty texts have 0 words and share 0. Rows are independent: nothing is shuffled, copies are each measured,
    a text of any length is taken whole. Columns not named are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words.Words(part.column("_text"))
        first, size = Suffixes(w.row, w.at, w.hash, apart=True).repeats(least) if len(w.row) else (np.zeros(0, np.int64),) * 2
        step = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + size, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
        longest = np.zeros(w.rows, np.int64)
        np.maximum.at(longest, w.row[first], size)
        n, inside = np.diff(w.at), np.diff(covered[w.at])
        return words.record(_key=part.column("_key"), n_words=n.astype(np.int64), repeated_words=inside.astype(np.int64), share=inside / np.maximum(n, 1), longest=longest)

    narrow = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return narrow.mapInArrow(words.over(measure, "_text"), f"_key {kind}, n_words bigint, repeated_words bigint, share double, longest bigint").withColumnRenamed("_key", key)


def excessive(df: DataFrame, key: str, text: str, *, least: int = 8, share: tuple[int, int] = (3, 10), longest: int | None = None) -> DataFrame:
    """The rows of repetition() that are over a limit, with over_share and over_longest: at least share[0]/share[1] of their words
    are repeated, or their longest repeat has more than `longest` words (null: any length). A row without words is over none."""
    up, down = share
    rows = repetition(df, key, text, least=least)
    rows = rows.withColumn("over_share", (F.col("n_words") > 0) & (F.col("repeated_words") * down >= F.col("n_words") * up))
    rows = rows.withColumn("over_longest", F.lit(False) if longest is None else F.col("longest") > longest)
    return rows.where("over_share or over_longest")
