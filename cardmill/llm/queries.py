"""Queries of the operators in this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consistent, leaks, mixture, names, neardup, repetition, spans, survivors, terms, vocabulary
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]
CARD = ["tag", "cite", "body"]
SAME_CARD = {"shingle": 3, "threshold": 0.5, "recall": 0.99999}  # as the problem is stated for cards, which asks for all pairs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(table(spark, d, "cards"), "card_id", CARD, expand=None, **SAME_CARD).select(F.col("a").alias("card_a"), F.col("b").alias("card_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "cards"), "card_id", CARD, **SAME_CARD).withColumnRenamed("id", "card_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "cards"), "card_id", "body")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "cards"), "card_id", "body").withColumn("share", F.round("share", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent.consistent_form(table(spark, d, "cards"), "card_id", ["body", "tag", "cite"], only_changed=True).select("card_id", "field")


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return consistent.consistent_form(table(spark, d, "cards"), "card_id", ["body", "tag", "cite"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms of a score that the stated counts reach at least; of these the ones that have the counts."""
    cards = table(spark, d, "cards")
    n = cards.count()
    scored = terms.log_entropy(cards, "card_id", ["tag", "body"], least=terms.least_score(n, 4, 5), n=n)
    return scored.where("tf >= 4 and df <= 5").select("card_id", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.log_entropy(table(spark, d, "cards"), "card_id", ["tag", "body"]).withColumn("score", F.round("score", 6))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "cards")
    counts = vocabulary.frequencies(cards, ["tag", "body"], longest=3, lengths=[1]).select("term", "n", "occurrences", "records")
    return vocabulary.marked(counts, cards.count(), rare=2, common=(35, 100)).drop("n")


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.frequencies(table(spark, d, "cards"), ["tag", "body"], longest=3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).where("mark is not null").select("term", "mark")


def _versions(spark: SparkSession, d: str, least: int) -> DataFrame:
    files = table(spark, d, "files")
    keyed = files.join(survivors.stem_key(files, "file_id", "stem"), "file_id").where("group_key <> ''")
    fields = [c for c in files.columns if c != "file_id"]
    year = F.regexp_extract("year", r"((?:19|20)\d\d)", 1)
    return survivors.survivors(keyed, "file_id", "group_key", ["highlighted", "words"], F.when(year != "", year), fields, least=least)


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d, 1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d, 2).select("first_id", "best_id")


def p7_spellings(spark: SparkSession, d: str) -> DataFrame:
    found = names.attribute(table(spark, d, "cards"), "card_id", "cite", table(spark, d, "authors"), "author_id")
    return found.groupBy(F.col("author").alias("author_id"), "spelling").agg(F.count("*").alias("cards"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = names.attribute(table(spark, d, "cards"), "card_id", "cite", table(spark, d, "authors"), "author_id")
    return found.select("card_id", F.col("author").alias("author_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.withColumn("share", F.round("share", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("longest_run >= 12").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text").withColumn("share", F.round("share", 6))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat three tenths of their words, or 40 words in a row."""
    found = repetition.excessive(table(spark, d, "documents"), "doc_id", "text", share=(3, 10), longest=39)
    return found.select("doc_id", "over_share", "over_longest")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.excessive(table(spark, d, "documents"), "doc_id", "text", share=(3, 10)).select("doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
