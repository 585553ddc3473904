"""Problem 1: near-duplicate records with small edits, by MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

SEEN = 1 << 22  # classes that a task remembers
PART = 1000  # rows of a class that are paired at once
SHORT = 24  # bits that bands leave off a class; classes alike in the others are candidates together, and verified
MAP = 20  # bits of the number of a word in the bitmap of ids


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of so many rows that a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _narrow(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_{i}" for i in range(len(fields))]
    return df.select(F.col(key).alias("id"), *(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True))), names


def _long_enough(w: words.Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a shingle, a hash of each one's word sequence, where its shingles begin, and all shingle hashes."""
    first, h = w.grams(shingle)
    row = w.row[first]
    begin = np.nonzero(np.append(True, row[1:] != row[:-1]))[0] if len(row) else np.zeros(0, np.int64)
    own = row[begin]
    return own, words.chained(w.hash, w.at[own], w.at[own + 1], words.CHAIN), begin, h


def classes(df: DataFrame, key: str, fields: list[str], *, shingle: int) -> DataFrame:
    """(id, class, text): for each row with at least one shingle hashes of its word sequence and of its fields as stored."""
    narrow, names = _narrow(df, key, fields)
    narrow = narrow.withColumn("text", F.xxhash64(*(F.coalesce(n, F.lit("")) for n in names)))

    def name(part: pa.RecordBatch) -> pa.RecordBatch:
        own, whole, _, _ = _long_enough(words.Words(words.joined(part, *names)), shingle)
        take = pa.array(own)
        return words.record(id=part.column("id").take(take), **{"class": words.signed(whole)}, text=part.column("text").take(take))

    return narrow.mapInArrow(words.over(name, *names), f"id {df.schema[key].dataType.simpleString()}, class bigint, text bigint")


def slots(df: DataFrame, fields: list[str], *, shingle: int, rows: int, bands: int, seed: int = 7) -> DataFrame:
    """(slot, class): for each class of equal word sequences, without its last SHORT bits, its bands, a number of 8 bits for the band
    and 56 for its minima. A task gives a class once, so a class of any number of copies is at most one row a task in a slot."""
    names = [f"_{i}" for i in range(len(fields))]
    narrow = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)))
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 32, (bands * rows, 2), np.uint64).astype(np.uint32) | np.uint32(1)
    salts = draw.integers(0, 1 << 63, bands * rows, np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in words.slices(batch, *names):
                own, whole, begin, h = _long_enough(words.Words(words.joined(part, *names)), shingle)
                if len(seen) > SEEN:
                    seen.clear()  # copies then come out twice, which changes no pair
                new = np.fromiter((not (x in seen or seen.add(x)) for x in whole.tolist()), bool, len(own))
                if not new.any():
                    continue
                low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                keys = np.zeros((bands, len(own)), np.uint64)
                for i, (a, b) in enumerate(factors):
                    keys[i // rows] = words.mix(keys[i // rows] + np.minimum.reduceat(low * a + high * b, begin) * salts[i])
                keys = keys >> np.uint64(8) | (np.arange(bands, dtype=np.uint64) << np.uint64(56))[:, None]
                yield words.record(slot=words.signed(keys[:, new].ravel()), **{"class": words.signed(np.tile(whole[new] >> np.uint64(SHORT), bands))})

    return narrow.mapInArrow(sign, "slot bigint, class bigint")


def wanted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts with an id in a pair, and some others: those whose bit is set in a bitmap of the ids, which has a bounded size."""
    word = f"(xxhash64(id) & {(1 << MAP) - 1})"
    bit = f"shiftleft(1L, cast(shiftright(xxhash64(id), {MAP}) & 63 as int))"
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bitmap = ids.groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    return texts.join(F.broadcast(bitmap), F.expr(f"{word} = word and bits & {bit} <> 0"), "left_semi")


def similar(pairs: DataFrame, fields: list[str], *, kind: str, shingle: int, threshold: float) -> DataFrame:
    """The pairs whose distinct shingles agree so far, with `similarity`; texts of both sides are in l_0, r_0 and so on."""
    left, right = ([f"{side}_{i}" for i in range(len(fields))] for side in "lr")

    def one(part: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = words.Words(words.joined(part, *names))
        first, h = w.grams(shingle)
        row = w.row[first]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        return row[keep], h[keep], np.bincount(row[keep], minlength=part.num_rows)

    def verify(part: pa.RecordBatch) -> pa.RecordBatch:
        (ra, ha, na), (rb, hb, nb) = one(part, left), one(part, right)
        row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=part.num_rows)
        value = both / np.maximum(na + nb - both, 1)
        keep = pa.array(np.nonzero((value >= threshold) & (both > 0))[0])
        return words.record(a=part.column("a").take(keep), b=part.column("b").take(keep), similarity=value[keep.to_numpy()])

    return pairs.mapInArrow(words.over(verify, *left, *right), f"a {kind}, b {kind}, similarity double")


def linked(df: DataFrame, key: str, fields: list[str], *, shingle: int = 5, threshold: float = 0.8, rows: int = 3, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences, and links between classes that are similar enough.

    First (id, class, text, n): of each row that has a shingle the least id of its class, a hash of its fields as stored and the rows
    of its class. Second (a, b, similarity): pairs of different classes, a < b. Bands hold classes, not rows, and go through one
    shuffle that both sides of the self-join use; a band holds only different texts of the same minima, and AQE splits it
    if it is large. Each candidate pair is verified on the whole shingle sets of one row of either class; texts of classes that no
    candidate has are left out before their shuffle. A class of which no row has an id is left out.
    """
    bands = bands_for(threshold, rows, recall)
    if bands > 256:
        raise ValueError(f"{bands} bands are needed, and 256 can be numbered: take fewer rows a band")
    named = shared.cut(classes(df, key, fields, shingle=shingle))
    reps = named.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null")
    members = named.join(reps, "class").select("id", F.col("rep").alias("class"), "text", "n")
    banded = slots(df, fields, shingle=shingle, rows=rows, bands=bands)
    pairs = banded.withColumnRenamed("class", "a").join(banded.withColumnRenamed("class", "b"), "slot").where("a < b").select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.shiftrightunsigned("class", SHORT).alias(side), F.col("rep").alias(f"_{side}")), side).drop(side)
    pairs = shared.cut(pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    narrow, names = _narrow(df, key, fields)
    narrow = wanted(narrow, pairs)
    for side, at in (("l", "a"), ("r", "b")):
        pairs = pairs.join(narrow.withColumnsRenamed({"id": at} | {n: f"{side}{n}" for n in names}), at)
    return members, similar(pairs, fields, kind=df.schema[key].dataType.simpleString(), shingle=shingle, threshold=threshold)


def pairs(df: DataFrame, key: str, fields: list[str], *, expand: int | None = 64, **how: object) -> DataFrame:
    """(a, b, similarity): ids of rows that are similar enough, a < b, each pair once.

    With `expand` None all pairs come out, whatever the number of copies. With a number, of more than `expand` exact copies (equal
    in each field as stored, null as empty) the smallest id stands for all in pairs with other texts, and pairs with each of its
    copies: then a group of copies costs as many rows as it has copies, and each two different texts that are similar enough are
    paired, whether their words are the same or not.
    Null fields count as empty; rows of fewer words than a shingle have no partner. Ids must be unique.
    """
    members, links = linked(df, key, fields, **how)
    star = None
    if expand is not None:
        texts = members.where("n > 1").groupBy("class", "text").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > expand)
        members = members.join(texts, ["class", "text"], "left")
        star = members.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
        members = members.where("first is null or id = first")
    # classes are paired in parts of about PART rows, so that no task has all pairs of a large class
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)).alias("part")
    parts = members.groupBy("class", "n", part).agg(F.collect_list("id").alias("ids"))
    one, other = (parts.select(F.col("class").alias(side), "n", F.col("part").alias(f"{side}_part"), F.col("ids").alias(f"{side}_ids")) for side in "ab")
    within = one.where("n > 1").join(other.drop("n").withColumnRenamed("b", "a"), "a").where("a_part <= b_part")
    within = within.select("a_ids", "b_ids", F.lit(1.0).alias("similarity"), (F.col("a_part") == F.col("b_part")).alias("same"))
    between = links.join(one.drop("n"), "a").join(other.drop("n"), "b").select("a_ids", "b_ids", "similarity", F.lit(False).alias("same"))
    units = within.union(between).repartition("a_ids", "b_ids")
    both = units.select("same", "similarity", "b_ids", F.explode("a_ids").alias("x")).select("same", "similarity", "x", F.explode("b_ids").alias("y"))
    both = both.where("not same or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return both if star is None else both.union(star)


def groups(df: DataFrame, key: str, fields: list[str], **how: object) -> DataFrame:
    """(id, group_id, links, copies): for each row with a partner the smallest id that links lead to, the number of other classes its
    class is linked to, and the number of other rows with the same words."""
    members, links = linked(df, key, fields, **how)
    links = shared.cut(links)
    found = shared.components(links)
    sizes = members.groupBy("class").agg((F.count("*") - 1).alias("copies"))
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    per = sizes.join(ends, "class", "left").join(found.withColumnRenamed("node", "class"), "class", "left").where("copies > 0 or links is not null")
    # a component's least class is its least id
    return members.join(per, "class").select("id", F.coalesce("component", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
