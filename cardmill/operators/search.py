"""Batches of queries against all cards: browse, title, exact and blended ranking, explanation and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import index, pages, vectors
from .ordered import ranked

FACETS = ("format", "position", "argtype", "year", "collection")
CANDIDATES = 400  # cards of the greatest similarity that the blend takes, before facets


def with_terms(queries: DataFrame) -> DataFrame:
    """(query_id, q, toks)"""
    return queries.select("query_id", "q", T.tokens(F.col("q"), T.QUERY_TOKEN).alias("toks"))


def passing(cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None, evidence: bool = False) -> DataFrame:
    """Cards, with facts of their file, that have all the facets asked for."""
    out = index.with_stem(cards.drop("year", "stem", "docx_path", "topic", *FACETS), files, "stem", "docx_path", "topic", *FACETS)
    for name, value in (facets or {}).items():
        if name not in FACETS:
            raise ValueError(f"no facet {name}")
        out = out.where(F.col(name) == value)
    return out.where("is_evidence = 1") if evidence else out


def browse(cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None, evidence: bool = False) -> DataFrame:
    """(card_id, score): all cards that pass, in order of id, score 0."""
    return passing(cards, files, facets, evidence).select("card_id", F.lit(0).cast("long").alias("score")).orderBy("card_id")


def has(field: str, t: Column) -> Column:
    return F.contains(F.col(field), t).cast("long")


def lower_fields(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c in ("tag", "cite", "stem")))


def title_search(queries: DataFrame, cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """(query_id, card_id, score): files whose stem has every term of the query as a part; a row a file, with its card of the greatest
    score, then least id. The score is 10 a term, 1 more for evidence. Stems meet queries on the first two characters of
    their longest term, so not all pairs are compared."""
    terms = with_terms(queries).where(F.size("toks") > 0)
    longest = F.element_at(F.array_sort(F.transform("toks", lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), 1)["t"]
    terms = terms.withColumn("pair", F.substring(longest, 1, 2))
    stems = files.select("file_id", F.lower(F.coalesce("stem", F.lit(""))).alias("low")).where(F.char_length("low") >= 2)
    pairs = stems.select("file_id", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("low") - 1), lambda i: F.substring(F.col("low"), i, F.lit(2))))).alias("pair"))
    hit = terms.join(pairs, "pair").where(F.forall("toks", lambda t: F.contains(F.col("low"), t))).select("query_id", "file_id", F.size("toks").alias("n"))
    best = passing(cards, files, facets).groupBy("file_id").agg(F.min(F.struct((-F.when(F.col("is_evidence") != 0, 1).otherwise(0)).alias("e"), "card_id")).alias("b"))
    return hit.join(best, "file_id").select("query_id", F.col("b.card_id").alias("card_id"), (F.col("n") * 10 - F.col("b.e")).cast("long").alias("score"))


def matches(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, card_id): cards with all terms of a query that the index knows, by itself or as a prefix; terms it doesn't know
    are passed over. A query of unknown terms only has no rows."""
    posts = index.postings(cards, ["tag", "cite", "body"], T.INDEX_TOKEN)
    counts = index.pruned(index.frequencies(posts), cards.count())
    each = with_terms(queries).select("query_id", F.explode(F.array_distinct("toks")).alias("term"))
    known = each.join(index.expanded(each, counts), "term")
    found = known.groupBy("query_id").agg(F.count_distinct("term").alias("n"))
    hits = known.join(posts.withColumnRenamed("term", "word"), "word").groupBy("query_id", "card_id").agg(F.count_distinct("term").alias("k"))
    return hits.join(found, "query_id").where("k = n").select("query_id", "card_id")


def missing(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, term, pos): terms that are neither in the index nor a prefix of one of its terms."""
    counts = index.pruned(index.frequencies(index.postings(cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), cards.count())
    each = with_terms(queries).select("query_id", F.posexplode("toks").alias("pos", "term"))
    return each.join(index.expanded(each, counts).select("term").distinct(), "term", "left_anti").select("query_id", "term", "pos")


def vocabulary(cards: DataFrame) -> tuple[DataFrame, int]:
    """(term, df) of the terms that searches know, and the number of cards."""
    n = cards.count()
    return index.pruned(index.frequencies(index.postings(cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), n), n


def scored_rows(cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """(card_id, whole, _tag, _cite, _stem, base) of the cards that pass, texts lower-cased; base: 1, 2 for evidence, 1 for a tag of more than 12 characters."""
    base = F.lit(1) + F.when(F.col("is_evidence") != 0, 2).otherwise(0) + F.when(F.char_length("tag") > 12, 1).otherwise(0)
    return lower_fields(passing(cards, files, facets)).select("card_id", F.lower(T.text("tag", "cite", "body")).alias("whole"), "_tag", "_cite", "_stem", base.alias("base"))


def first_matches(queries: DataFrame, cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """(query_id, card_id, score, rank): the first matches that pass, best first, ties by id. The score is 1, and for each term (repeated ones
    again) 8 in the stem, 10 in the tag, 4 in the cite, 2 for evidence, 1 for a tag of more than 12 characters. queries: query_id, q, most."""
    counts, n = vocabulary(cards)
    terms = queries.select("query_id", T.tokens(F.col("q"), T.QUERY_TOKEN).alias("toks"), "most").where(F.size("toks") > 0)
    known = index.expanded(terms.select(F.explode("toks").alias("term")), counts)
    return pages.first_matches(terms, scored_rows(cards, files, facets), known, n)


def exact_search(queries: DataFrame, cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None, top: int = index.TOP, skip: int = 0) -> DataFrame:
    """(query_id, card_id, score, rank): a page of the matches of each query, best first, ties by id."""
    return first_matches(queries.select("query_id", "q", F.lit(skip + top).alias("most")), cards, files, facets).where(F.col("rank") > skip)


def did_you_mean(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, missing, suggestion, corrected): for queries without matches that miss a term, the nearest word for the first
    such term and the query with it; suggestion null if there is none."""
    counts = index.pruned(index.frequencies(index.postings(cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), cards.count())
    first = missing(queries, cards).groupBy("query_id").agg(F.min(F.struct("pos", "term")).alias("m")).select("query_id", F.col("m.term").alias("missing"))
    first = first.join(matches(queries, cards).select("query_id").distinct(), "query_id", "left_anti")
    near = index.suggestions(first.select(F.col("missing").alias("term")), counts).select(F.col("term").alias("missing"), "suggestion")
    out = first.join(near, "missing", "left").join(queries.select("query_id", "q"), "query_id")
    at = F.instr(F.lower("q"), F.col("missing"))
    fixed = F.concat(F.substring(F.col("q"), F.lit(1), at - 1), F.col("suggestion"), F.substring(F.col("q"), at + F.char_length("missing"), F.char_length("q")))
    return out.select("query_id", "missing", "suggestion", fixed.alias("corrected"))


@dataclass(frozen=True)
class Blend:
    """Weights of the interactive ranking."""

    lexical: float = 0.6
    semantic: float = 0.4
    candidates: int = CANDIDATES


def smart_search(queries: DataFrame, query_vectors: DataFrame, cards: DataFrame, card_vectors: DataFrame, files: DataFrame, facets: dict[str, str] | None = None, blend: Blend = Blend(), top: int = index.TOP) -> DataFrame:  # noqa: B008
    """(query_id, card_id, score, rank): shares of the best lexical score and of the greatest similarity, added. Queries without
    a vector keep their lexical scores. The most similar cards are taken before facets, so fewer may be left."""
    has_vector = query_vectors.select("query_id").distinct().withColumn("v", F.lit(1))
    # without the most similar cards, which are scored one by one, a page is among so many first matches
    most = F.when(F.col("v").isNull(), top).otherwise(top + blend.candidates)
    lex = first_matches(queries.join(has_vector, "query_id", "left").select("query_id", "q", most.alias("most")), cards, files, facets)
    sem = vectors.nearest(query_vectors, card_vectors, "card_id", blend.candidates)
    first = sem.where("rank = 1").select("query_id", F.col("similarity").alias("first"))
    near = pair_scores(sem.join(first, "query_id"), queries, cards, files, facets).select("query_id", "card_id", "score", "similarity", "first")
    both = lex.select("query_id", "card_id", "score").unionByName(near, allowMissingColumns=True)
    both = both.groupBy("query_id", "card_id").agg(*(F.max(c).alias(c) for c in ("score", "similarity", "first"))).join(has_vector, "query_id", "left")
    most = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1))
    blended = F.coalesce(blend.lexical * F.col("score") / most, F.lit(0.0)) + F.coalesce(blend.semantic * F.col("similarity") / F.coalesce(F.nullif("first", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    both = both.select("query_id", "card_id", F.round(F.when(F.col("v").isNull(), F.col("score").cast("double")).otherwise(blended), 6).alias("score"))
    return ranked(both, ["query_id"], [F.desc("score"), "card_id"], top)


def pair_scores(pairs: DataFrame, queries: DataFrame, cards: DataFrame, files: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """pairs of query_id and card_id whose card passes, with the score of first_matches, null if the card does not match."""
    terms = with_terms(queries).select("query_id", "toks")
    each = terms.select("query_id", F.explode(F.array_distinct("toks")).alias("term"))
    known = each.join(index.expanded(each, vocabulary(cards)[0]), "term").groupBy("query_id", "term").agg(F.collect_list("word").alias("words"))
    known = known.groupBy("query_id").agg(F.collect_list("words").alias("known"))
    rows = scored_rows(cards.join(pairs.select("card_id").distinct(), "card_id", "left_semi"), files, facets)
    both = pairs.join(rows, "card_id").join(terms, "query_id", "left").join(known, "query_id", "left")
    own = F.regexp_extract_all("whole", F.lit(T.INDEX_TOKEN), F.lit(0))
    sums = F.aggregate("toks", F.col("base").cast("long"), lambda acc, t: acc + 8 * has("_stem", t) + 10 * has("_tag", t) + 4 * has("_cite", t))
    return both.withColumn("_own", own).select(*pairs.columns, F.when(F.forall("known", lambda w: F.arrays_overlap(w, F.col("_own"))), sums).alias("score"))


def explain(results: DataFrame, queries: DataFrame, cards: DataFrame, files: DataFrame, top: int = 4, of: int = 120) -> DataFrame:
    """(query_id, place, stem, cards, score, matched): the files with most of the score among the first `of` results; for the first file also
    which terms its best card has in its tag or the start of its body. results: query_id, card_id, score, rank."""
    rows = results.where(F.col("rank") <= of).join(cards.select("card_id", "file_id", F.lower(T.text("tag")).alias("_tag"), F.lower(F.substring(T.text("body"), 1, 320)).alias("_body")), "card_id")
    by = rows.groupBy("query_id", "file_id").agg(F.count("*").alias("cards"), F.sum("score").alias("score"), F.min(F.struct("rank", "_tag", "_body")).alias("best"))
    by = ranked(by, ["query_id"], [F.desc("score"), F.col("best.rank")], top, "place")
    out = by.join(files.select("file_id", "stem"), "file_id").join(with_terms(queries).select("query_id", "toks"), "query_id")
    hit = F.filter("toks", lambda t: F.contains(F.col("best._tag"), t) | F.contains(F.col("best._body"), t))
    return out.select("query_id", "place", "stem", "cards", F.round("score", 6).alias("score"), F.when(F.col("place") == 1, F.array_join(hit, ", ")).otherwise("").alias("matched"))


def labels(results: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    """(query_id, n, label): how many results a query has, in words."""
    n = queries.select("query_id").join(results.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    tail = {"smart": " · meaning-based", "title": " · titles"}.get(mode, "")
    return n.withColumn("label", F.concat(F.format_number("n", 0), F.when(F.col("n") == 1, " match").otherwise(" matches"), F.lit(tail)))


def display(cards: DataFrame, files: DataFrame) -> DataFrame:
    """(card_id, title, weak, cite, badges, stem, link): what a list of results shows of a card."""
    rows = passing(cards, files)
    tag, body = F.coalesce("tag", F.lit("")), F.coalesce("body", F.lit(""))
    title = F.when(tag != "", tag).when(body != "", F.concat(F.substring(F.substring(body, 1, 320), 1, 140), F.lit("…"))).otherwise("(untagged card)")
    badges = F.array_compact(F.array(F.when(F.col("is_evidence") != 0, "evidence").otherwise("analytic"), *(F.nullif(F.col(c), F.lit("")) for c in ("argtype", "position", "topic", "year")), F.nullif(F.substring("section", 1, 46), F.lit(""))))
    return rows.select("card_id", title.alias("title"), (F.char_length(tag) < 12).alias("weak"), F.substring(F.coalesce("cite", F.lit("")), 1, 190).alias("cite"), F.array_join(badges, "|").alias("badges"), "stem", T.open_link(F.col("docx_path"), F.col("stem")).alias("link"))


def detail(cards: DataFrame, files: DataFrame, ids: list[int]) -> DataFrame:
    """(card_id, tag, cite, body, stem, link): all of some cards, with words in place of what is missing."""
    rows = passing(cards.where(F.col("card_id").isin(ids)), files)
    tag, body = F.coalesce(F.nullif(F.col("tag"), F.lit("")), F.lit("(untagged card)")), F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit("(no body text stored — open the source document for the full card)"))
    return rows.select("card_id", tag.alias("tag"), F.coalesce("cite", F.lit("")).alias("cite"), body.alias("body"), "stem", T.open_link(F.col("docx_path"), F.col("stem")).alias("link"))
