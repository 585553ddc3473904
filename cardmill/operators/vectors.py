"""Term weights, latent vectors, quantised vectors and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import index
from .ordered import ranked

LEVELS = 127
QUERIES = 4096  # queries compared at once
BODY = 1200  # characters of a body that vectors see
ROWS = 512  # rows multiplied at once


def texts(cards: DataFrame, files: DataFrame) -> DataFrame:
    """(card_id, text): tag, cite, start of body and stem that are not empty, lower-cased."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("tag", "cite")] + [F.nullif(F.substring("body", 1, BODY), F.lit("")), F.nullif(F.col("stem"), F.lit(""))]
    return index.with_stem(cards, files).select("card_id", F.lower(F.concat_ws(" ", *parts)).alias("text"))


def tfidf(docs: DataFrame, *, least: int = 4, share: float = 0.4, most: int = 40_000, key: str = "card_id") -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each row of length 1. Terms of at least `least` rows and at most that share of
    rows; of more than `most` the most frequent, then the first by alphabet. A row's terms are counted within the row."""
    n = docs.count()
    # rows are spread by key once: counts, weights and lengths of a row need no other shuffle; the terms kept are at most `most`
    toks = docs.select(key, T.tokens(F.col("text"), T.QUERY_TOKEN).alias("toks")).repartition(key)
    tf = toks.select(key, F.explode("toks").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= least) & (F.col("df") <= share * n))
    df = df.orderBy(F.desc("total"), "term").limit(most)
    raw = tf.join(F.broadcast(df), "term").select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def idf(weights_of: DataFrame, n: int) -> DataFrame:
    """(term, idf) from rows (key, term)."""
    return weights_of.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))


def lsa(weights: DataFrame, n: int, *, key: str = "card_id", dims: int = 64, rounds: int = 4, seed: int = 0, most_terms: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """(key, v) of rows and (term, v) of terms: truncated singular vectors of the weights, each of length 1; term vectors are
    scaled by idf first. Signs and rotations are arbitrary, similarities are not.

    Randomised subspace iteration. The basis over terms has at most most_terms * (dims + 10) numbers and is sent to executors; each
    round streams the rows once, adds up its product in each partition and sums those in a tree.
    """
    spark = weights.sparkSession
    known = idf(weights, n).orderBy("term").limit(most_terms + 1).collect()
    if len(known) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    vocabulary = [r.term for r in known]
    terms = spark.createDataFrame(list(zip(vocabulary, range(len(vocabulary)), strict=True)), "term string, i int")
    rows = weights.join(F.broadcast(terms), "term").groupBy(key).agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w")).persist()
    width = min(dims + 10, len(vocabulary))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(vocabulary), width)))[0]

    def product(b: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(b)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            for batch in batches:
                for at, cols, w in _ragged(batch):
                    left = np.add.reduceat(sent.value[cols] * w[:, None], at[:-1])
                    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                    order = np.argsort(cols, kind="stable")
                    begin = np.nonzero(np.append(True, np.diff(cols[order]) != 0))[0]
                    total[cols[order][begin]] += np.add.reduceat(left[row[order]] * w[order, None], begin)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        parts = rows.select("i", "w").mapInArrow(part, "m binary")
        return parts.rdd.map(lambda r: np.frombuffer(r.m).reshape(sent.value.shape)).treeReduce(np.add)

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    gram = basis.T @ product(basis)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-values)[:dims]
    right = basis @ turn[:, order]  # term by dimension
    sent = spark.sparkContext.broadcast(right)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.add.reduceat(sent.value[cols] * w[:, None], at[:-1]) for at, cols, w in _ragged(batch)]
            if not parts:
                continue
            out = np.concatenate(parts)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["k", "v"])

    kind = weights.schema[key].dataType.simpleString()
    docs = rows.select(key, "i", "w").mapInArrow(project, f"k {kind}, v array<double>").withColumnRenamed("k", key)
    scaled = right * np.array([r.idf for r in known])[:, None]
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    return docs, spark.createDataFrame([(t, v.tolist()) for t, v in zip(vocabulary, scaled, strict=True)], "term string, v array<double>")


def _ragged(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, terms and weights of some rows at a time; every row has a term."""
    i, w = (batch.column(batch.schema.get_field_index(c)) for c in ("i", "w"))
    at = np.asarray(i.offsets) - i.offsets[0].as_py()
    cols, weights = np.asarray(i.flatten()), np.asarray(w.flatten())
    for lo in range(0, batch.num_rows, ROWS):
        own = at[lo : lo + ROWS + 1]
        yield own - own[0], cols[own[0] : own[-1]], weights[own[0] : own[-1]]


def quantised(vectors: DataFrame, v: str = "v") -> DataFrame:
    """vectors with `q` (-127 to 127, halves to even) and the `scale`, the greatest size of any number of the table, 1 if that is 0."""
    scale = vectors.agg(F.max(F.array_max(F.transform(F.col(v), lambda x: F.abs(x.cast("double"))))).alias("scale"))
    scale = scale.select(F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))
    s = scale.first().scale
    q = F.transform(F.col(v), lambda x: F.greatest(F.lit(-LEVELS), F.least(F.lit(LEVELS), F.rint(x.cast("double") / s * LEVELS).cast("int"))).cast("tinyint"))
    return vectors.withColumn("q", q).withColumn("scale", F.lit(s))


def dequantised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("v", F.transform("q", lambda x: x.cast("double") * F.col("scale") / LEVELS))


def query_vectors(terms: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """(query_id, v): the mean of the vectors of a query's terms, of length 1; queries without known terms or of length 0 have no row.
    terms: query_id, term, repeated as often as they count."""
    each = terms.join(term_vectors, "term").select("query_id", F.posexplode("v").alias("d", "x"))
    mean = each.groupBy("query_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = mean.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("l"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).where("n > 0")
    return lists.select("query_id", F.transform("l", lambda s: s["x"] / F.col("n")).alias("v"))


def with_prefixes(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """terms with each unknown term replaced by the first word of more than three letters that begins with it, if any."""
    known = vocabulary.select("term")
    exact = terms.join(known, "term")
    rest = terms.join(known, "term", "left_anti")
    words = known.where(F.char_length("term") > 3).select(F.col("term").alias("word"), F.substring("term", 1, 2).alias("head"))
    near = rest.select("term").distinct().withColumn("head", F.substring("term", 1, 2)).join(words, "head").where(F.startswith("word", "term")).groupBy("term").agg(F.min("word").alias("word"))
    return exact.unionByName(rest.join(near, "term").withColumn("term", F.col("word")).select(*terms.columns))


def aligned(cards: DataFrame, vectors: DataFrame, dims: int, key: str = "card_id") -> DataFrame:
    """(key, v, matched): a vector for each card, zeros where there is none."""
    return cards.select(key).join(vectors.select(key, "v"), key, "left").select(key, F.coalesce("v", F.array_repeat(F.lit(0.0), dims)).alias("v"), F.col("v").isNotNull().alias("matched"))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, top: int) -> DataFrame:
    """(query_id, key, similarity, rank): the vectors of the greatest cosine to each query, ties by key."""
    return ranked(similarities(queries, vectors, key, top), ["query_id"], [F.desc("similarity"), key], top)


def similarities(queries: DataFrame, vectors: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """(query_id, key, similarity): the cosine of each query and each vector, or at least the `top` greatest of each query.

    Queries go to the executors in blocks of QUERIES and all vectors stream past each block as a matrix product; each batch keeps its
    `top` of each query before the shuffle. Vectors of length 0 have similarity 0; those of null or another length are passed over.
    """
    spark, kind = queries.sparkSession, vectors.schema[key].dataType.simpleString()
    id_kind = queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // QUERIES))
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("v").cast("array<double>").alias("v")).collect()
        ids = pa.array([r.query_id for r in block])
        m = np.array([r.v for r in block], np.float64).reshape(len(block), -1)
        sent = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                v = batch.column("v")
                own = np.nonzero(np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(v), q.shape[1]), False)))[0]
                if not len(own) or not len(q):
                    continue
                x = np.asarray(v.take(pa.array(own)).flatten(), np.float64).reshape(len(own), -1)
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                k = len(own) if top is None else min(top, len(own))
                # all that reach the k-th greatest, so ties are settled by key later
                limit = np.partition(s, len(own) - k, axis=1)[:, len(own) - k] - 1e-9
                i, j = np.nonzero(s >= limit[:, None])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), batch.column("k").take(pa.array(own[j])), pa.array(s[i, j])], names=["query_id", "k", "similarity"])

        found = vectors.select(F.col(key).alias("k"), F.col("v").cast("array<double>").alias("v")).mapInArrow(compare, f"query_id {id_kind}, k {kind}, similarity double")
        out = found if out is None else out.union(found)
    return out.select("query_id", F.col("k").alias(key), F.round("similarity", 6).alias("similarity"))
