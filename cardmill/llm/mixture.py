"""Problem 9: mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1024  # parts of a source whose token sums are added up first


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, key: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(id, source, tokens): sizes in tokens; sources without case, spaces at the ends, and with _ for what is no letter or digit."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("id"), _source(source).alias("source"), F.col(text).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(x)) if x else 0 for x in batch.column("_text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(n)], names=["id", "source", "tokens"])

    return narrow.mapInArrow(count, f"id {kind}, source string, tokens bigint")


def _source(column: str):
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[^\p{L}\p{N}]+", "_")


def quotas(supply: dict[str, int], share: dict[str, float], cap: dict[str, int | None], total: float) -> dict[str, float]:
    """Tokens of each source: shares of the total; what a source lacks at its cap goes to the others by their shares."""
    quota = dict.fromkeys(share, 0.0)
    open_ = {s for s in share if supply.get(s, 0) > 0 and share[s] > 0 and (cap[s] is None or cap[s] > 0)}
    left = total
    while open_:
        scale = left / sum(share[s] for s in open_)
        full = {s for s in open_ if cap[s] is not None and cap[s] * supply[s] <= share[s] * scale}
        for s in full or open_:
            quota[s] = float(cap[s] * supply[s]) if full else share[s] * scale
        if not full:
            break
        left -= sum(quota[s] for s in full)
        open_ -= full
    return quota


def slopes(supply: dict[str, int], quota: dict[str, float], tilt: float) -> dict[str, float]:
    """How far each source's weight falls along training: it goes linearly from 1 + a to 1 - a times its share. Sources that
    repeat come late, others early; the sum over sources stays even."""
    total = sum(quota.values())
    if not total:
        return dict.fromkeys(quota, 0.0)
    raw = {s: tilt if q <= supply.get(s, 0) else -tilt for s, q in quota.items()}
    mean = sum(raw[s] * quota[s] for s in quota) / total
    most = max(1.0, *(abs(raw[s] - mean) for s in quota))
    return {s: (raw[s] - mean) / most for s in quota}


def plan(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, *, total: int | None = None, tilt: float = 0.5, vocabulary: str | None = None, most: int = 100_000) -> tuple[DataFrame, list[dict]]:
    """Sizes of the documents that have a target (kept in the checkpoint folder) and a line of the plan for each target."""
    rows = targets.select(_source("source").alias("source"), "target_share", "max_repeats").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {most} targets")
    share = {r.source: float(r.target_share or 0) for r in rows if r.source is not None}
    cap = {r.source: r.max_repeats for r in rows}
    sized = shared.cut(sizes(docs, key, text, source, vocabulary or default_vocabulary()))
    wanted = docs.sparkSession.createDataFrame([(s,) for s in share], "source string")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(wanted), "source").collect()
    supply = {r.source: r.n for r in have}
    quota = quotas(supply, share, cap, float(total if total is not None else sum(supply.values())))
    fall = slopes(supply, quota, tilt)
    return sized, [{"source": s, "target_share": share[s], "max_repeats": cap[s], "supply": supply.get(s, 0), "quota": quota[s], "fall": fall[s]} for s in share]


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, **how: object) -> DataFrame:
    """(key, source, copy, tokens, position): the chosen documents with their repeats, in order of training position.

    Each source gets its target share of `total` tokens (all tokens of the sources with a target, if not given). A document is taken at most
    max_repeats times in all (null: any number); what a source can't give at that is shared among the others by their shares. Documents of a
    source follow in order of a hash of their id, again and again, until its tokens are used; the last round takes those whose
    middle lies within them. Each source's weight is a linear schedule over training; its integral gives the demand up to any
    point, and inverting that gives the position, in tokens, of each copy's middle. A range sort by position ends it.

    Running sums use BUCKETS parts of each source, so a source of any size is spread over tasks. Documents without a target
    source (null included) are left out, and targets without documents get nothing. Empty texts have 0 tokens and are kept in order.
    """
    sized, lines = plan(docs, key, text, source, targets, **how)
    out = _placed(sized, lines).withColumnRenamed("id", key)
    return out.orderBy("position", key, "copy")


def _placed(sized: DataFrame, lines: list[dict]) -> DataFrame:
    """(id, source, copy, tokens, position)"""
    spark = sized.sparkSession
    table = spark.createDataFrame([(x["source"], x["supply"], x["quota"], x["fall"]) for x in lines], "source string, supply long, quota double, fall double")
    order = F.xxhash64("id")
    placed = sized.join(F.broadcast(table.where("quota > 0")), "source").withColumn("_h", order).withColumn("_b", F.pmod(F.shiftright("_h", 48), F.lit(BUCKETS)))
    sums = placed.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_b").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(sums, ["source", "_b"]).withColumn("_middle", F.col("_before") + F.sum("tokens").over(within) - F.col("tokens") / 2)
    rounds = F.floor(F.col("quota") / F.col("supply"))
    rest = F.col("quota") - rounds * F.col("supply")
    copies = placed.withColumn("_copies", rounds + (F.col("_middle") < rest).cast("long")).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    done = F.least(((F.col("copy") - 1) * F.col("supply") + F.col("_middle")) / F.col("quota"), F.lit(1.0))
    a = F.col("fall")
    # demand up to u is u + a * u * (1 - u) of the quota; the root of that for `done`, in the form that is exact at a = 0
    u = 2 * done / ((1 + a) + F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * done, F.lit(0.0))))
    total = sum(x["quota"] for x in lines)
    return copies.select("id", "source", F.col("copy").cast("int").alias("copy"), "tokens", F.round(F.when(done > 0, u).otherwise(0.0) * total, 3).alias("position"))


def report(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, **how: object) -> DataFrame:
    """(source, target_share, max_repeats, supply_tokens, mixed_tokens, actual_share, documents, most_repeats): a row for each target."""
    counted, plans = plan(docs, key, text, source, targets, **how)
    got = _placed(counted, plans).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copy").alias("most_repeats"))
    sized = counted.groupBy("source").agg(F.sum("tokens").alias("supply_tokens"))
    lines = targets.select(_source("source").alias("source"), "target_share", "max_repeats").join(sized, "source", "left").join(got, "source", "left")
    lines = lines.fillna(0, ["supply_tokens", "mixed_tokens", "documents", "most_repeats"])
    all_ = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row a target
    return lines.select("source", "target_share", "max_repeats", "supply_tokens", "mixed_tokens", F.round(F.when(all_ > 0, F.col("mixed_tokens") / all_).otherwise(0.0), 6).alias("actual_share"), "documents", "most_repeats")
