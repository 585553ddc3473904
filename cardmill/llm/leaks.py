"""Problem 8: evaluation texts in training text, by rare seeds and local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

SEED = 6  # words of a seed
BLOCK_CHARS = 4 << 20  # characters of items sent to executors at once
MATCH, MISS, GAP = 2, -1, -1
CELLS = 1 << 15  # cells of a row of alignments done at once; a longer stretch is done alone


class Items:
    """Test items as word hashes, with the seeds in order of their hash."""

    def __init__(self, ids: np.ndarray, texts: list[str]) -> None:
        w = words.Words(pa.array(texts, pa.string()))
        self.ids, self.at, self.hash = ids, w.at, w.hash
        first, seed = w.grams(SEED)
        order = np.argsort(seed, kind="stable")
        self.first, self.seed, self.row = first[order], seed[order], w.row[first[order]]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.seed & np.uint64((1 << 22) - 1)] = True

    def hits(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a seed's first word in the documents and its index here, all that are equal."""
        first, h = w.grams(SEED)
        maybe = np.nonzero(self.bits[h & np.uint64((1 << 22) - 1)])[0]
        low, high = np.searchsorted(self.seed, h[maybe], "left"), np.searchsorted(self.seed, h[maybe], "right")
        n = high - low
        where = np.repeat(first[maybe], n)
        index = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return where, index


def aligned(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of each pair of word sequences, and the longest run of words they share; pairs of like length at once."""
    best, longest = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    n, m = np.array([len(x) for x in docs], np.int64), np.array([len(x) for x in items], np.int64)
    order = np.lexsort((n, m // 16))
    a = 0
    while a < len(order):
        width = np.maximum.accumulate(n[order[a : a + CELLS]]) + 1
        b = a + max(1, int(np.sum(width * np.arange(1, len(width) + 1) <= CELLS)))
        own = order[a:b]
        best[own], longest[own] = _table([docs[i] for i in own], [items[i] for i in own])
        a = b
    return best, longest


def _table(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A column a pair, filled up with words that match nothing. Scores are kept plus their place times the cost of a gap, so that a
    gap in the item, of any length, is a running maximum."""
    size = max(len(x) for x in docs)
    doc, item = np.zeros((size, len(docs)), np.uint64), np.ones((max(len(x) for x in items), len(docs)), np.uint64)
    for k, (x, y) in enumerate(zip(docs, items, strict=True)):
        doc[: len(x), k], item[: len(y), k] = x, y
    none = (np.arange(size + 1, dtype=np.int32) * -GAP)[:, None]  # a score of 0
    above, run = np.repeat(none, len(docs), 1), np.zeros((size + 1, len(docs)), np.int32)
    best, longest = above.copy(), run.copy()
    for word in item:
        equal = doc == word
        row = np.maximum(above + GAP, none)
        np.maximum(row[1:], above[:-1] + np.where(equal, np.int32(MATCH - GAP), np.int32(MISS - GAP)), out=row[1:])
        above = np.maximum.accumulate(row, axis=0)
        run[1:] = (run[:-1] + 1) * equal
        np.maximum(best, above, out=best)
        np.maximum(longest, run, out=longest)
    return (best - none).max(0), longest.max(0)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The same of one pair."""
    best, longest = aligned([doc], [item])
    return int(best[0]), int(longest[0])


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, *, least_score: int = 20) -> DataFrame:
    """(key, item_key, seeds, score, share, longest_run): documents with passages of test items, and which items.

    Seeds are all runs of SEED words of the items. Where a document has a seed of an item, the stretch around all its seeds is
    aligned with the item by Smith-Waterman over words (match 2, else -1); `share` is the score of that of the whole item.
    Pairs of at least `least_score` come out, edited copies too if SEED words in a row are left somewhere; `longest_run` is the
    longest stretch of equal words. No seed is passed over for being frequent, so a stock opening costs an alignment for each
    document and item that have it.

    Items are sent to the executors in blocks of bounded size, each streamed against all documents without a shuffle of
    them. An item shorter than a seed cannot be found. Items with a null key are passed over. Null texts count as empty; copies
    of a document each come out.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    parts = []
    for b in range(blocks):
        block = items.where(F.col(item_key).isNotNull()).where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b).select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).orderBy("i").collect()
        own = Items(np.array([r.i for r in block], np.int64), [r.t or "" for r in block])
        parts.append(_block(spark, narrow, own, kind, least_score))
    found = reduce(DataFrame.union, parts)
    return found.select(F.col("_key").alias(key), F.col("_item").cast(item_kind).alias(item_key), "seeds", "score", "share", "longest_run")


def _block(spark, narrow: DataFrame, own: Items, kind: str, least_score: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(own)

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        its = sent.value
        w = words.Words(part.column("_text"))
        where, index = its.hits(w)
        out = [np.zeros(0)] * 6
        if len(where):
            row, item = w.row[where], its.row[index]
            order = np.lexsort((where, item, row))
            where, index, row, item = where[order], index[order], row[order], item[order]
            begin = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))[0]
            end = np.append(begin[1:], len(where))
            r, i = row[begin], item[begin]
            length = its.at[i + 1] - its.at[i]
            low = np.maximum(w.at[r], where[begin] - 2 * length)
            high = np.minimum(w.at[r + 1], where[end - 1] + SEED + 2 * length)
            score, run = aligned([w.hash[a:b] for a, b in zip(low, high, strict=True)], [its.hash[its.at[k] : its.at[k + 1]] for k in i])
            good = score >= least_score
            out = [x[good] for x in (r, its.ids[i], end - begin, score, score / (MATCH * length), run)]
        return words.record(
            _key=part.column("_key").take(pa.array(out[0], pa.int64())), _item=pa.array(out[1], pa.int64()), seeds=pa.array(out[2], pa.int32()), score=pa.array(out[3], pa.int32()),
            share=pa.array(out[4], pa.float64()), longest_run=pa.array(out[5], pa.int32()),
        )

    return narrow.mapInArrow(words.over(find, "_text"), f"_key {kind}, _item bigint, seeds int, score int, share double, longest_run int")
