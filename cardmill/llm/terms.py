"""Problem 4: how distinctive a term is for a record, by log-entropy weights."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

DIGITS = 1e-9


def occurrences(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, term, tf): terms of the joined fields with the times they occur in the row, in the lower-cased consistent form. All of
    a row's words are in the row, so they are counted before anything is shuffled."""
    kind = df.schema[key].dataType.simpleString()
    names = [f"_{i}" for i in range(len(fields))]

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words.Words(words.joined(part, *names), letters=True)
        order = np.lexsort((w.hash, w.row))
        row, h = w.row[order], w.hash[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        at = np.nonzero(first)[0]
        tf = np.diff(np.append(at, len(row)))
        return words.record(_key=part.column("_key").take(pa.array(row[at])), term=w.texts(order[at]).cast(pa.string()), tf=tf.astype(np.int64))

    narrow = df.select(F.col(key).alias("_key"), *(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)))
    return narrow.mapInArrow(words.over(count, *names), f"_key {kind}, term string, tf bigint").withColumnRenamed("_key", key)


def spread(counts: DataFrame, n: int) -> DataFrame:
    """(term, df, gf, spread): records and occurrences of each term, and 1 less the entropy of its occurrences over the
    records divided by the entropy of an even spread over all n records."""
    entropy = F.log(F.col("gf")) - F.col("s") / F.col("gf")
    even = F.log(F.lit(float(n)))
    sums = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log("tf")).alias("s"))
    return sums.select("term", "df", "gf", (1 - F.when(even > 0, entropy / even).otherwise(0.0)).alias("spread"))


def least_score(n: int, tf: int, df: int) -> float:
    """The least score of a term that occurs tf times or more in the row and in df rows or fewer of n: its occurrences are
    spread evenly over df rows at most."""
    return math.log1p(tf) * (1 - math.log(df) / math.log(n)) if n > df else 0.0


def log_entropy(df: DataFrame, key: str, fields: list[str], *, least: float | None = None, n: int | None = None) -> DataFrame:
    """(key, term, tf, df, score): score = ln(1 + tf) * (1 - H / ln n), where H is the entropy of the term's occurrences
    over the n rows of df. Two aggregations: terms in a row, and rows of a term; the second is combined before the
    shuffle, so a term of all rows costs one row a partition.

    least keeps the rows of so great a score (but for the last digits); as the second factor is at most 1, rows that are
    too few occurrences for it are left out before they meet the statistics, which are those of all rows whatever is
    kept. Rows without terms (null or empty fields) give no row but count in n; with n of 1 the score is ln(1 + tf). The key
    should be unique: rows with the same key count as different records. n is the number of rows, if it is known.
    """
    n = df.count() if n is None else n
    counts = occurrences(df, key, fields)
    stats = spread(counts, n)
    if least is not None:
        counts = counts.where(F.log1p("tf") >= least - DIGITS)
    out = counts.join(stats, "term").select(key, "term", "tf", "df", (F.log1p("tf") * F.col("spread")).alias("score"))
    return out if least is None else out.where(F.col("score") >= least - DIGITS)
