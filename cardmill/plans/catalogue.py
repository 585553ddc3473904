"""All queries over the test tables, by name. Searches ask for every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe, evaluate, facets, index, intent, nodes, recover, search, vectors
from ..operators.ordered import dense_index
from ..sinks import export
from ..sources import lists, trees, word
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
EVERY = 50
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.statements().items() if k in _ALL}


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self._read(name)


def asked(t: Tables) -> DataFrame:
    """(query_id, q): the first three words of the tag of every 50th card."""
    return t.cards.where((F.col("card_id") % EVERY == 0) & (F.col("tag") != "")).select(F.col("card_id").alias("query_id"), F.array_join(F.slice(F.split("tag", " "), 1, 3), " ").alias("q"))


def named(t: Tables) -> DataFrame:
    """(query_id, q): the stem of every 50th file."""
    return t.files.where((F.col("file_id") % EVERY == 0) & (F.col("stem") != "")).select(F.col("file_id").alias("query_id"), F.col("stem").alias("q"))


def mistyped(t: Tables) -> DataFrame:
    """(query_id, q): the first word of six letters or more of each tag asked for, without its fourth."""
    first = F.try_element_at(F.filter(T.tokens(F.col("q"), T.QUERY_TOKEN), lambda x: F.char_length(x) >= 6), F.lit(1))
    return asked(t).select("query_id", first.alias("w")).where("w is not null").select("query_id", F.concat(F.substring("w", 1, 3), F.expr("substring(w, 5)")).alias("q"))


def tag_queries(t: Tables) -> DataFrame:
    return t.cards.where("tag <> ''").select(F.col("card_id").alias("query_id"), F.col("tag").alias("q"))


# --- terms and postings --------------------------------------------------------------------------------------------
@query
def term_df_web(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return index.pruned(index.frequencies(index.postings(t.cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), t.cards.count())


@query
def term_df_eval(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return evaluate.frequencies(t.cards, t.files)


@query
def postings_delta(spark: SparkSession, d: str) -> DataFrame:
    return index.delta_postings(Tables(spark, d).cards)


@query
def postings_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return index.decoded(index.delta_postings(Tables(spark, d).cards)).groupBy("term").agg(F.count("*").alias("n"), F.sum("decoded").alias("total"))


@query
def postings_fts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return index.fts_postings(t.cards, t.files).groupBy("term", "field").agg(F.count("*").alias("df"))


@query
def dense_file_index(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return dense_index(t.files.select("file_id"), "file_id", "file_idx").join(t.cards.select("card_id", "file_id"), "file_id").select("card_id", "file_idx")


# --- searches ------------------------------------------------------------------------------------------------------
@query
def browse_facets(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.browse(t.cards, t.files, {"format": "Policy", "argtype": "Kritik"}, evidence=True)


@query
def title_search(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.title_search(named(t), t.cards, t.files)


@query
def exact_search(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.exact_search(asked(t), t.cards, t.files)


@query
def prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    counts = index.pruned(index.frequencies(index.postings(t.cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), t.cards.count())
    heads = asked(t).select(F.explode(T.tokens(F.col("q"), T.QUERY_TOKEN)).alias("w")).select(F.substring("w", 1, 4).alias("term")).distinct()
    return index.expanded(heads, counts)


@query
def missing_terms(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.missing(mistyped(t), t.cards).select("query_id", "term")


@query
def suggest_terms(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    counts = index.pruned(index.frequencies(index.postings(t.cards, ["tag", "cite", "body"], T.INDEX_TOKEN)), t.cards.count())
    return index.suggestions(mistyped(t).select(F.col("q").alias("term")), counts)


@query
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.did_you_mean(mistyped(t), t.cards)


@query
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    part = asked(t).select("query_id", F.expr("substring(q, 3, 9)").alias("q"))
    return index.contains_search(part, t.cards, t.files)


@query
def smart_search(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    v = t.embeddings.select(F.col("vec_id").alias("card_id"), F.col("embedding").alias("v"))
    asking = v.where(F.col("card_id") % EVERY == 0).select(F.col("card_id").alias("query_id"), "v").join(asked(t).select("query_id"), "query_id")
    return search.smart_search(asked(t), asking, t.cards, v, t.files)


@query
def explain_panel(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.explain(search.exact_search(asked(t), t.cards, t.files, top=120), asked(t), t.cards, t.files)


@query
def result_labels(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.labels(search.title_search(named(t), t.cards, t.files), named(t), "title")


@query
def display_cards(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return search.display(t.cards, t.files)


@query
def highlighted_tags(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return export.marked_up(search.exact_search(asked(t), t.cards, t.files), t.cards, asked(t))


# --- the second ranker ---------------------------------------------------------------------------------------------
@query
def eval_lexical(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    scores = evaluate.lexical(asked(t), t.cards, t.files, evaluate.CONFIGS["lexical-first + phrase + title"])
    return scores.withColumn("score", F.round("score", 4))


def _config_results(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("card_id"), F.col("embedding").alias("v"))
    asking = v.where(F.col("card_id") % EVERY == 0).select(F.col("card_id").alias("query_id"), "v").join(asked(t).select("query_id"), "query_id")
    out = evaluate.searches(asked(t), asking, t.cards, v, t.files, list(evaluate.CONFIGS.values()))
    return out.select(F.element_at(F.array(*(F.lit(c) for c in evaluate.CONFIGS)), F.col("config") + 1).alias("config"), "query_id", "stem", "rank")


def _known(t: Tables) -> DataFrame:
    """(query_id, stem): the file of the card whose tag is asked for."""
    own = t.cards.select(F.col("card_id").alias("query_id"), "file_id").join(asked(t).select("query_id"), "query_id")
    return own.join(t.files.select("file_id", F.coalesce("stem", F.lit("")).alias("stem")), "file_id").select("query_id", "stem")


@query
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return evaluate.measures(_config_results(t), _known(t), list(evaluate.CONFIGS))


@query
def rank_best(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return evaluate.best(evaluate.measures(_config_results(t), _known(t), list(evaluate.CONFIGS)))


@query
def rank_report(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return evaluate.report(_config_results(t), _known(t))


# --- intent --------------------------------------------------------------------------------------------------------
@query
def intent_assess(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return intent.assess(t.cards.select(F.col("card_id").alias("query_id"), F.coalesce("section", F.lit("")).alias("q")))


@query
def intent_assess_df(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = intent.assess(tag_queries(t), evaluate.frequencies(t.cards, t.files), t.cards.count())
    return rows.select("query_id", "kind")


@query
def filename_terms(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return intent.filename_terms(t.files.select(F.col("file_id").alias("query_id"), F.replace(F.coalesce("stem", F.lit("")), F.lit("_"), F.lit(" ")).alias("q")))


@query
def filename_score(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return intent.filename_scores(named(t).select("query_id", F.replace("q", F.lit("_"), F.lit(" ")).alias("q")), t.files)


# --- facets and scalars --------------------------------------------------------------------------------------------
@query
def facets_from_stem(spark: SparkSession, d: str) -> DataFrame:
    return facets.of_names(Tables(spark, d).files)


@query
def facets_from_stem_first(spark: SparkSession, d: str) -> DataFrame:
    return facets.of_names_first(Tables(spark, d).files).drop("attribution")


@query
def attribution(spark: SparkSession, d: str) -> DataFrame:
    return facets.of_names_first(Tables(spark, d).files).select("file_id", "attribution")


@query
def path_facets(spark: SparkSession, d: str) -> DataFrame:
    return facets.of_paths(Tables(spark, d).files, "file_id", "orig_folder")


@query
def facets_combined(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    known = t.files.where("orig_folder is not null").groupBy("stem").agg(F.max("orig_folder").alias("folder"))
    return facets.combined(t.files, known)


@query
def facet_vocab(spark: SparkSession, d: str) -> DataFrame:
    return facets.vocabulary(Tables(spark, d).files)


@query
def facet_coverage(spark: SparkSession, d: str) -> DataFrame:
    return facets.coverage(Tables(spark, d).files)


@query
def topn_argtype(spark: SparkSession, d: str) -> DataFrame:
    return facets.top_values(Tables(spark, d).files, "argtype", 12, "(unlabelled)")


@query
def topn_collection(spark: SparkSession, d: str) -> DataFrame:
    return facets.top_values(Tables(spark, d).files, "collection", 10)


@query
def topn_topic(spark: SparkSession, d: str) -> DataFrame:
    return facets.top_values(Tables(spark, d).files, "topic", 10)


@query
def cite_parse(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).cards.select("card_id", T.cite_author(F.col("cite")).alias("author"), T.cite_year(F.col("cite")).alias("year"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).cards.select("card_id", T.clean(F.col("tag")).alias("tag"), T.clean(F.col("cite")).alias("cite"))


@query
def manifest_folders(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the moves of the scanned tree, read back."""
    lines = dedupe.manifest_lines(dedupe.moves(Tables(spark, d).scan))
    each = lines.select(F.col("path").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lists.manifest(each)


@query
def docx_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    beside = word.lookup(t.scan.select(dedupe.name_of(F.col("path")).alias("name")))
    return t.files.select("file_id", "stem").join(beside, "stem", "left").select("file_id", "name")


# --- counts, sections, recovery ------------------------------------------------------------------------------------
def _runs(t: Tables) -> DataFrame:
    """Orders as documents and their lines as runs of text: two numbers each, so words run on from line to line."""
    mark = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "highlight"), F.when(F.col("l_linestatus") == "O", "underline_mark"), F.when(F.col("l_quantity") > 40, "shading")))
    color = F.when(F.col("l_returnflag") == "R", F.array(F.concat(F.lit("c"), (F.col("l_partkey") % 9).cast("string")))).otherwise(F.array().cast("array<string>"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), pos.alias("pos"), F.concat(F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string")).alias("text"), mark.alias("marks"), color.alias("colors"), (F.col("l_linenumber") % 3 == 0).alias("brk"))


@query
def word_marks(spark: SparkSession, d: str) -> DataFrame:
    return nodes.counters(_runs(Tables(spark, d)), "doc")


@query
def word_colours(spark: SparkSession, d: str) -> DataFrame:
    return nodes.colours(_runs(Tables(spark, d)), "doc")


@query
def file_card_counts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return nodes.file_counts(t.files, t.cards)


@query
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return nodes.totals(Tables(spark, d).files)


def _heads(t: Tables) -> DataFrame:
    """Lines of documents as headings: those of a colon as hats, numbered ones as blocks, short ones as pockets."""
    line = F.col("line")
    kind = F.when(F.regexp_like("line", F.lit("^[A-Z][a-z]+:")), "hat").when(F.regexp_like("line", F.lit("^[0-9]+[.]")), "block").when(F.char_length(line) < 60, "pocket").otherwise("card")
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", kind.alias("type"), F.when(kind != "card", line).alias("label"))


@query
def section_path(spark: SparkSession, d: str) -> DataFrame:
    return nodes.sections(_heads(Tables(spark, d)), "doc_id").where("type = 'card'").select("doc_id", "pos", "section")


@query
def outline_heads(spark: SparkSession, d: str) -> DataFrame:
    return nodes.outlines(_heads(Tables(spark, d)), "doc_id")


def _paras(t: Tables) -> DataFrame:
    """The fields of each card as paragraphs of its file."""
    def para(k: int, field: str, bold: bool):
        text = F.coalesce(field, F.lit(""))
        words = F.size(F.filter(F.split(text, f"[{T.SPACE}]+"), lambda x: x != ""))
        marks = (F.col("underlined"), F.col("highlighted")) if field == "body" else (F.lit(0), F.lit(0))
        return F.struct((F.col("ordinal") * 3 + k).alias("pos"), text.alias("text"), words.alias("words"), F.lit(bold).alias("bold"), marks[0].cast("long").alias("ul"), marks[1].cast("long").alias("hl"), F.lit("Normal").alias("style"))

    return t.cards.select(F.col("file_id").alias("doc_id"), F.explode(F.array(para(0, "tag", True), para(1, "cite", False), para(2, "body", False))).alias("p")).select("doc_id", "p.*")


@query
def recover_triples(spark: SparkSession, d: str) -> DataFrame:
    return recover.triples(_paras(Tables(spark, d)))


@query
def paragraph_kinds(spark: SparkSession, d: str) -> DataFrame:
    return recover.counts(_paras(Tables(spark, d)))


def _trees(t: Tables) -> DataFrame:
    """(file_id, content): each file's cards written as a compressed document, one card after the other."""
    row = F.struct("ordinal", "card_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("tag", "cite", "body")), F.col("is_analytic"))
    each = t.cards.groupBy("file_id").agg(F.sort_array(F.collect_list(row)).alias("cards"))  # a document is one row

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leaf(kind: str, text: str) -> dict:
            return {"type": kind, "content": [{"type": "text", "text": text}]}

        for batch in batches:
            out = []
            for cards in batch.column("cards").to_pylist():
                content = []
                for c in cards:
                    parts = [leaf(kind, c[f]) for kind, f in (("tag", "tag"), ("cite_paragraph", "cite"), ("card_body", "body")) if c[f]]
                    content.append(leaf("analytic", c["body"]) if c["is_analytic"] else {"type": "card", "content": parts})
                out.append(gzip.compress(json.dumps({"doc": {"type": "doc", "content": content}}).encode(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(out, pa.binary())], names=["file_id", "content"])

    return each.mapInArrow(write, "file_id long, content binary")


@query
def tree_cards(spark: SparkSession, d: str) -> DataFrame:
    """Files written as documents, decoded and taken apart again: their cards, citations and words."""
    found = trees.good(trees.decode(_trees(Tables(spark, d))))
    cards = nodes.cards(found).groupBy("file_id").agg(F.count("*").alias("cards"), F.sum("is_evidence").cast("long").alias("evidence"))
    return cards.join(nodes.counters(found, "file_id").select("file_id", "words"), "file_id", "left").select("file_id", "cards", "evidence", F.coalesce("words", F.lit(0)).alias("words"))


# --- files to keep -------------------------------------------------------------------------------------------------
@query
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.plan(Tables(spark, d).scan).where("disposition = 'duplicate'").select("path")


@query
def version_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.plan(Tables(spark, d).scan).where("version is not null")


@query
def dedupe_moves(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.moves(Tables(spark, d).scan)


@query
def dedupe_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.summary(Tables(spark, d).scan)


@query
def dedupe_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.conflicts(Tables(spark, d).scan)


@query
def envelope_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last export of each file, of equal ones one."""
    e = Tables(spark, d).envelopes
    last = e.groupBy("file_id").agg(F.max(F.struct("loaded_at", "cmir_path", F.lower("format").alias("format"), "formatversion")).alias("e"), F.count("*").alias("exports"))
    return last.select("file_id", F.date_format("e.loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"), F.col("e.cmir_path").alias("cmir_path"), F.col("e.format").alias("format"), "exports")


# --- vectors -------------------------------------------------------------------------------------------------------
@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").alias("v"))
    return vectors.nearest(v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "v"), v, "vec_id", 10)


@query
def quantize_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.quantised(Tables(spark, d).embeddings.select("vec_id", F.col("embedding").alias("v")))
    total = F.aggregate(F.transform("q", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return q.select("vec_id", total.alias("checksum"), F.round("scale", 6).alias("scale"))


@query
def vector_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.dequantised(vectors.quantised(Tables(spark, d).embeddings.select("vec_id", F.col("embedding").alias("v"))))
    return q.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query
def vector_realign(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    v = t.embeddings.select(F.col("vec_id").alias("card_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.aligned(t.cards, v, 64).select("card_id", "matched", F.round(F.element_at("v", 1), 6).alias("first"))


@query
def query_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Terms are vectors' labels here: each event type's users, by the vector of their number."""
    t = Tables(spark, d)
    v = t.embeddings.select(F.col("vec_id").cast("string").alias("term"), "embedding")
    terms = t.events.select(F.col("event_type").alias("query_id"), F.col("user_id").cast("string").alias("term"))
    return vectors.query_vectors(terms, v.withColumnRenamed("embedding", "v")).select("query_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query
def vector_text(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return vectors.texts(t.cards, t.files)


@query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return vectors.tfidf(vectors.texts(t.cards, t.files)).withColumn("weight", F.round("weight", 6))


@query
def lsa_svd(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: latent vectors are unique up to signs and rotations."""
    t = Tables(spark, d)
    docs, _ = vectors.lsa(vectors.tfidf(vectors.texts(t.cards, t.files)), t.cards.count())
    return docs.select("card_id", F.size("v").alias("dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("length"))


# --- tables at large -----------------------------------------------------------------------------------------------
@query
def event_json(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events
    return e.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query
def payload_cards(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return export.card_rows(t.cards, t.files).select("card_idx", F.get_json_object("row", "$.a").alias("tag"), F.get_json_object("row", "$.p").alias("preview"))
