"""Results as files: tables, one self-contained page, reports."""

from __future__ import annotations

import base64
import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facets, index, nodes
from ..operators.ordered import dense_index
from ..operators.vectors import quantised

PREVIEW = 320
PLACE = "__PAYLOAD__"


def tables(folder: str, files: DataFrame, cards: DataFrame) -> None:
    """The index: files, cards and both kinds of postings, postings clustered by term."""
    files.write.mode("overwrite").parquet(f"{folder}/files")
    cards.write.mode("overwrite").parquet(f"{folder}/cards")
    for name, df, key in (("postings_fts", index.fts_postings(cards, files), "term"), ("postings_tri", index.trigram_postings(cards, files), "gram")):
        df.repartitionByRange(key).sortWithinPartitions(key, "card_id").write.mode("overwrite").parquet(f"{folder}/{name}")


def vectors(folder: str, docs: DataFrame, terms: DataFrame) -> None:
    """Vectors of cards and of terms as small numbers with the scale of their table."""
    for name, df in (("card_vectors", docs), ("term_vectors", terms)):
        quantised(df).drop("v").write.mode("overwrite").parquet(f"{folder}/{name}")


def card_rows(cards: DataFrame, files: DataFrame) -> DataFrame:
    """(card_idx, row): what the page holds of a card, as JSON: tag, cite, place of its file, section, evidence, 0, start of the body."""
    places = dense_index(files.select("file_id"), "file_id", "file_idx")
    rows = dense_index(cards.select("card_id", "file_id", "tag", "cite", "section", "is_evidence", "body"), "card_id", "card_idx").join(places, "file_id")
    text = [F.coalesce(c, F.lit("")) for c in ("tag", "cite", "section")]
    cells = F.struct(text[0].alias("a"), text[1].alias("b"), "file_idx", text[2].alias("c"), F.when(F.col("is_evidence") != 0, 1).otherwise(0).alias("e"), F.lit(0).alias("z"), F.substring(F.coalesce("body", F.lit("")), 1, PREVIEW).alias("p"))
    return rows.select("card_idx", F.to_json(cells).alias("row"))


def payload(cards: DataFrame, files: DataFrame) -> bytes:
    """Gzip JSON of the whole page: cards, files, terms with gaps, facet values. It is one file by nature, so rows stream through the driver."""
    out: dict = {"cards": [], "files": [], "terms": {}, "meta": {}}
    for r in card_rows(cards, files).orderBy("card_idx").toLocalIterator():
        out["cards"].append(list(json.loads(r.row).values()))
    kept = ("stem", "docx_path", "format", "position", "argtype", "year", "collection", "topic")
    for r in files.orderBy("file_id").select(*kept).toLocalIterator():
        out["files"].append(list(r))
    for r in index.packed(index.delta_postings(cards)).orderBy("term", "part").toLocalIterator():
        out["terms"].setdefault(r.term, []).extend(r.deltas)
    for r in facets.vocabulary(files).orderBy("facet", "rank").toLocalIterator():
        out["meta"].setdefault(r.facet, []).append(r.value)
    out["meta"]["evidence"] = cards.where("is_evidence <> 0").count()
    return gzip.compress(json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode(), 9)


def page(template: str, data: bytes) -> str:
    """The template with the payload in its place; an error if it has none."""
    if PLACE not in template:
        raise ValueError(f"the template has no {PLACE}")
    return template.replace(PLACE, base64.b64encode(data).decode())


def unpacked(text: str) -> dict:
    """A payload read back; one that was not compressed too."""
    raw = base64.b64decode(text)
    return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


def statistics(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(name, value) of the corpus, for a console."""
    s = nodes.totals(files)
    return s.select(F.explode(F.create_map(*(x for c in s.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("name", "value"))


def marked_up(results: DataFrame, cards: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, card_id, html): the tags of results with the query's terms marked."""
    rows = results.join(cards.select("card_id", F.coalesce("tag", F.lit("")).alias("tag")), "card_id").join(queries.select("query_id", T.tokens(F.col("q"), T.QUERY_TOKEN).alias("toks")), "query_id")
    return rows.select("query_id", "card_id", T.highlight(F.col("tag"), F.col("toks")).alias("html"))
