"""Counts, sections and cards from the nodes of documents (a row a node, in pre-order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Nodes that end a word where they close, headings from coarse to fine, marks whose colours count.
BREAKS = ("tag", "card_body", "cite_paragraph", "block", "hat", "pocket", "paragraph", "analytic", "analytic_unit")
HEADINGS = ("hat", "pocket", "block")
COLOURED = ("highlight", "shading")
TAG_CHARS, LABEL_CHARS, OUTLINE = 160, 120, 60


def words(runs: DataFrame, group: str) -> DataFrame:
    """(group, wid, marks, colors): a row a word of a group's runs, in order of pos. A word that runs on across runs is one word, with the
    marks of all of them; a row with brk ends a word. runs: group, pos, text, marks, colors, brk."""
    pieces = F.split(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("brk"), " ").otherwise("")), f"[{T.SPACE}]")
    each = runs.select(group, "pos", "marks", "colors", F.posexplode(pieces).alias("j", "piece"))
    w = Window.partitionBy(group).orderBy("pos", "j").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("wid", F.sum((F.col("j") > 0).cast("long")).over(w)).where("piece <> ''")
    flat = each.groupBy(group, "wid").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"), F.array_distinct(F.flatten(F.collect_list("colors"))).alias("colors"))
    return flat


def counters(runs: DataFrame, group: str) -> DataFrame:
    """(group, words, highlighted, underlined, tagline_emph, shaded): a word with both layers of highlighting counts twice in
    `highlighted`."""
    def n(mark: str):
        return F.count_if(F.array_contains("marks", mark))

    return words(runs, group).groupBy(group).agg(F.count("*").alias("words"), (n("highlight") + n("shading")).alias("highlighted"), n("underline_mark").alias("underlined"), n("underline_direct").alias("tagline_emph"), n("shading").alias("shaded"))


def colours(runs: DataFrame, group: str, most: int = 6) -> DataFrame:
    """(color, n): the colours of the most words, ties by name."""
    return words(runs, group).select(F.explode("colors").alias("color")).groupBy("color").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "color").limit(most)


def sections(heads: DataFrame, group: str) -> DataFrame:
    """heads with `section`: the labels of the latest hat, pocket and block, joined; a hat ends pocket and block, a pocket the block. Empty
    labels change nothing; no heading gives null. heads: group, pos, type, label (null for what is no heading)."""
    label = F.nullif(F.substring("label", 1, LABEL_CHARS), F.lit(""))
    rows = heads.withColumn("_l", label)
    def over(*by: str):
        return Window.partitionBy(group, *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def new(*kinds: str):
        return (F.col("type").isin(*kinds) & F.col("_l").isNotNull()).cast("int")

    rows = rows.withColumn("_hat", F.sum(new("hat")).over(over())).withColumn("_pocket", F.sum(new("hat", "pocket")).over(over()))
    last = [F.last(F.when(F.col("type") == kind, F.col("_l")), ignorenulls=True).over(over(*by)) for kind, by in (("hat", ()), ("pocket", ("_hat",)), ("block", ("_pocket",)))]
    return rows.withColumn("section", F.nullif(F.concat_ws(" > ", *last), F.lit(""))).drop("_l", "_hat", "_pocket")


def outlines(heads: DataFrame, group: str) -> DataFrame:
    """(group, outline): the first headings with a label, as type:label."""
    label = F.nullif(F.substring("label", 1, LABEL_CHARS), F.lit(""))
    rows = heads.where(F.col("type").isin(*HEADINGS)).select(group, "pos", "type", label.alias("l")).where("l is not null")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("pos"))).where(F.col("_k") <= OUTLINE)
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(":", "type", "l").alias("t")))).alias("x"))
    return lists.select(group, F.array_join(F.col("x.t"), " | ").alias("outline"))


def _joined(rows: DataFrame, by: list[str], name: str, sep: str = "") -> DataFrame:
    """The texts of a group in order of pos, as one."""
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    return lists.select(*by, F.array_join(F.col("x.t"), sep).alias(name))


def cards(nodes: DataFrame) -> DataFrame:
    """(file_id, ordinal, section, is_evidence, is_analytic, tag, cite, author, year, body, words, highlighted, underlined) from nodes.

    A card with a citation is evidence; its tag and cite are the first of their kind, its body all bodies with a space between (a nested one
    counts again). Analytics have their text as body and its start as tag; one without text has no row but takes a number.
    Rows of unit_pos are those inside a card or an outermost analytic; a file without either has no row.
    """
    leaves = nodes.where("type = 'text'")
    units = nodes.where("pos = unit_pos and not brk").select("file_id", "pos", "type", "unit_pos")
    heads = nodes.where(F.col("type").isin(*HEADINGS) & ~F.col("brk") & F.col("unit_pos").isNull())
    spans = heads.select("file_id", F.col("pos").alias("start"), "end_pos", "type")
    labels = spans.join(leaves.where("unit_pos is null").select("file_id", "pos", "text"), "file_id").where("pos > start and pos <= end_pos")
    labels = spans.join(_joined(labels, ["file_id", "start"], "raw"), ["file_id", "start"], "left").select("file_id", F.col("start").alias("pos"), "type", T.clean(F.col("raw")).alias("label"))
    marked = sections(labels.unionByName(units.select("file_id", "pos", "type", F.lit(None).cast("string").alias("label"))), "file_id")
    numbered = marked.join(units.select("file_id", "pos"), ["file_id", "pos"]).select("file_id", F.col("pos").alias("unit_pos"), "type", "section", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")).alias("ordinal"))
    inside = leaves.where("unit_pos is not null").select("file_id", "unit_pos", "pos", "text")
    parts = nodes.where(F.col("unit_pos").isNotNull() & ~F.col("brk") & F.col("type").isin("tag", "cite_paragraph", "card_body")).select("file_id", "unit_pos", F.col("pos").alias("start"), "end_pos", "type")
    covered = parts.join(inside, ["file_id", "unit_pos"]).where("pos > start and pos <= end_pos")
    texts = parts.join(_joined(covered, ["file_id", "unit_pos", "start"], "raw"), ["file_id", "unit_pos", "start"], "left").select("file_id", "unit_pos", "start", "type", F.coalesce("raw", F.lit("")).alias("raw"))
    per = texts.groupBy("file_id", "unit_pos").agg(
        F.min(F.when(F.col("type") == "tag", F.struct("start", "raw"))).alias("t"), F.min(F.when(F.col("type") == "cite_paragraph", F.struct("start", "raw"))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "card_body", F.struct("start", "raw")))).alias("b"),
    )
    whole = _joined(inside, ["file_id", "unit_pos"], "whole")
    counted = counters(nodes.where("unit_pos is not null").withColumn("unit", F.struct("file_id", "unit_pos")), "unit").select("unit.file_id", "unit.unit_pos", "words", "highlighted", "underlined")
    rows = numbered.join(per, ["file_id", "unit_pos"], "left").join(whole, ["file_id", "unit_pos"], "left").join(counted, ["file_id", "unit_pos"], "left")
    card = F.col("type") == "card"
    rows = rows.select(
        "file_id", "ordinal", "section", (card & F.col("c").isNotNull()).cast("int").alias("is_evidence"), (~card).cast("int").alias("is_analytic"), F.when(card, F.coalesce("t.raw", F.lit(""))).otherwise("").alias("tag"),
        F.when(card, F.coalesce("c.raw", F.lit(""))).otherwise("").alias("cite"), F.when(card, F.coalesce(F.array_join(F.col("b.raw"), " "), F.lit(""))).otherwise(F.coalesce("whole", F.lit(""))).alias("body"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "highlighted", "underlined")),
    )
    rows = rows.select("file_id", "ordinal", "section", "is_evidence", "is_analytic", T.clean(F.col("tag")).alias("tag"), T.clean(F.col("cite")).alias("cite"), T.clean(F.col("body")).alias("body"), "words", "highlighted", "underlined").where("is_analytic = 0 or body <> ''")
    tag = F.when(F.col("is_analytic") == 1, F.substring("body", 1, TAG_CHARS)).otherwise(F.col("tag"))
    return rows.select("file_id", "ordinal", "section", "is_evidence", "is_analytic", tag.alias("tag"), "cite", T.cite_author(F.col("cite")).alias("author"), T.cite_year(F.col("cite")).alias("year"), "body", "words", "highlighted", "underlined")


def file_counts(files: DataFrame, cards: DataFrame) -> DataFrame:
    """(file_id, card_nodes, analytics_n, evidence, analytics) of all files, without cards too. card_nodes has all rows, analytics those
    without a citation that are no analytic units."""
    n = cards.groupBy("file_id").agg(F.count("*").alias("card_nodes"), F.count_if(F.col("is_analytic") != 0).alias("analytics_n"), F.count_if(F.col("is_evidence") != 0).alias("evidence"))
    rows = files.select("file_id").join(n, "file_id", "left").fillna(0, ["card_nodes", "analytics_n", "evidence"])
    return rows.withColumn("analytics", F.col("card_nodes") - F.col("evidence") - F.col("analytics_n"))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, words, highlighted, underlined, cards, evidence and the shares of words that are marked."""
    s = files.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("words", "highlighted", "underlined", "card_nodes", "evidence")))
    return s.select("*", *(F.round(F.col(c) / F.greatest("words", F.lit(1)), 6).alias(f"{c}_share") for c in ("highlighted", "underlined")))
