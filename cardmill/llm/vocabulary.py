"""Problem 5: frequency of every term or n-gram, from suffix arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .suffixes import Suffixes


def intervals(w: words.Words, longest: int, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the length, and of each n-gram a first word, its occurrences and its rows, all from one suffix array."""
    if not len(w.row):
        return
    array = Suffixes(w.row, w.at, w.hash, apart=False, depth=longest)
    prefix, before = array.common(array.order[:-1], array.order[1:]), array.before()
    for k in lengths:
        yield k, *array.intervals(k, prefix, before)


def frequencies(df: DataFrame, fields: list[str], *, longest: int = 3, lengths: Sequence[int] | None = None, letters: bool = True) -> DataFrame:
    """(term, n, occurrences, records): how often each n-gram of up to `longest` words occurs in the joined fields of all rows, and
    in how many rows; words are those of the lower-cased consistent form, n-grams have a space between words. One array
    serves all lengths; `lengths` are those that come out (all, if not given).

    Each block of rows gets its own suffix array; a row lies in one block, so the counts of blocks add up, and only
    distinct n-grams of a block are shuffled. Null and empty fields have no words; equal rows count each; a text of any length
    is one block at least. An empty table gives no row.
    """
    names = [f"_{i}" for i in range(len(fields))]
    wanted = tuple(range(1, longest + 1) if lengths is None else lengths)
    if not all(1 <= k <= longest for k in wanted):
        raise ValueError(f"lengths are from 1 to {longest}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, *names):
                w = words.Words(words.joined(part, *names), letters=letters)
                for n, first, size, rows in intervals(w, longest, wanted):
                    texts = w.texts(first).cast(pa.string())
                    for k in range(1, n):
                        texts = pc.binary_join_element_wise(texts, w.texts(first + k).cast(pa.string()), " ")
                    yield words.record(term=texts, n=np.full(len(first), n, np.int32), occurrences=size.astype(np.int64), records=rows.astype(np.int64))

    narrow = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)))
    counts = narrow.mapInArrow(count, "term string, n int, occurrences bigint, records bigint")
    return counts.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, n: int, *, rare: int, common: tuple[int, int]) -> DataFrame:
    """counts with `mark`: rare in at most `rare` records, common in more than common[0]/common[1] of all n, else null.
    Common comes first where both hold."""
    up, down = common
    return counts.withColumn("mark", F.when(F.col("records") * down > n * up, "common").when(F.col("records") <= rare, "rare"))
