"""Tag, citation and body recovered from plain paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TAG_WORDS, CITE_WORDS, BODY_WORDS = 60, 90, 40
CITE_WITHIN, BODY_WITHIN = 2, 3
# What a citation and a link look like.
CITE = rf"^[^a-z]{{0,4}}[A-Z][A-Za-z.\-']+(?:[{T.SPACE}]+(?:et[{T.SPACE}]+al\.?|and|&|[A-Z][A-Za-z.\-']+)){{0,3}}[{T.SPACE},]*(?:'|’)?\d{{2,4}}\b"
LINK = r"https?://|www\."


def kinds(paras: DataFrame) -> DataFrame:
    """paras with `kind`: tag, cite, body or null. Blank ones, links and headings of the first three levels are none; a long one with
    underlines or highlights is a body, one that looks like a citation a cite, a short bold one a tag."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")
    heading = F.regexp_like(F.coalesce("style", F.lit("")), F.lit("^Heading [123]"))
    kind = F.when((t == "") | F.regexp_like(t, F.lit(LINK)) | heading, None).when((F.col("words") >= BODY_WORDS) & ((F.col("ul") > 0) | (F.col("hl") > 0)), "body")
    kind = kind.when((F.col("words") <= CITE_WORDS) & F.regexp_like(t, F.lit(CITE)), "cite").when((F.col("words") <= TAG_WORDS) & F.col("bold"), "tag")
    return paras.withColumn("kind", kind)


def triples(paras: DataFrame) -> DataFrame:
    """(doc_id, tag_pos, cite_pos, body_pos): a tag, a cite within the next two paragraphs with no tag before it, a body within the next three
    with no tag or cite before it. A match holds no other tag, so taking all of them is the same as scanning greedily."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = CITE_WITHIN + BODY_WITHIN
    rows = kinds(paras).select("doc_id", "pos", "kind", *(F.lead(F.coalesce(F.substring("kind", 1, 1), F.lit("-")), k, "$").over(w).alias(f"k{k}") for k in range(1, ahead + 1)), *(F.lead("pos", k).over(w).alias(f"p{k}") for k in range(1, ahead + 1)))
    rows = rows.where("kind = 'tag'")
    line = F.concat(*(F.col(f"k{k}") for k in range(1, ahead + 1)))
    cite = F.char_length(F.regexp_extract(line, rf"^([^tc$]{{0,{CITE_WITHIN - 1}}}c)", 1))
    body = F.char_length(F.regexp_extract(F.substring(line, cite + 1, F.lit(BODY_WITHIN)), rf"^([^tcb$]{{0,{BODY_WITHIN - 1}}}b)", 1))
    at = F.array(*(F.col(f"p{k}") for k in range(1, ahead + 1)))
    return rows.select("doc_id", F.col("pos").alias("tag_pos"), cite.alias("c"), body.alias("b"), at.alias("at")).where("c > 0 and b > 0").select("doc_id", "tag_pos", F.element_at("at", F.col("c")).alias("cite_pos"), F.element_at("at", F.col("c") + F.col("b")).alias("body_pos"))


def counts(paras: DataFrame) -> DataFrame:
    """(kind, n)"""
    return kinds(paras).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
