"""Document trees: gzip-compressed JSON files as a row a node, with errors set apart."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.nodes import BREAKS, COLOURED

NODES = "file_id long, pos int, end_pos int, depth int, parent_pos int, unit_pos int, type string, text string, marks array<string>, colors array<string>, brk boolean, error string"
UNITS = ("card", "analytic", "analytic_unit")


def scan(spark: SparkSession, folder: str, suffix: str = ".cmir") -> DataFrame:
    """(file_id, path, content): files below the folder with the suffix, in any case; file_id is the place of the path from 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.endswith(F.lower("path"), F.lit(suffix)))
    ids = files.select("path").withColumn("file_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")).cast("long"))  # names only
    return ids.join(files.select("path", "content"), "path").select("file_id", "path", "content")


def flatten(doc: dict) -> list[tuple]:
    """Nodes in pre-order without recursion: pos, end_pos, depth, parent_pos, unit_pos, type, text, marks, colors, brk. Where a node ends a
    word, a row with brk follows its last descendant."""
    out: list[list] = []
    stack: list[tuple] = [(doc, 0, None, None, False)]
    while stack:
        node, depth, parent, unit, closing = stack.pop()
        if closing:
            own = out[parent]
            own[1] = len(out) - 1
            if own[5] in BREAKS:
                out.append([len(out), len(out), depth, parent, own[4], own[5], "", [], [], True])
            continue
        kind = node.get("type")
        pos = len(out)
        if unit is None and kind in UNITS:
            unit = pos
        text, marks, colors = None, [], []
        if kind == "text":
            text = node.get("text", "")
            for m in node.get("marks") or []:
                if m.get("type"):
                    marks.append(m["type"])
                color = (m.get("attrs") or {}).get("color")
                if m.get("type") in COLOURED and color:
                    colors.append(color)
        out.append([pos, pos, depth, parent, unit, kind, text, marks, colors, False])
        stack.append((node, depth, pos, unit, True))
        for child in reversed(node.get("content") or []):
            stack.append((child, depth + 1, pos, unit, False))
    return [tuple(x) for x in out]


def decode(files: DataFrame) -> DataFrame:
    """A row a node of every document; of one that can't be read one row with its error. files: file_id, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [(i, *x, None) for x in flatten(json.loads(gzip.decompress(raw.as_py()).decode("utf-8")).get("doc") or {})]
                except Exception as e:
                    rows = [(i, *[None] * 10, f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 20_000):  # a long document is several batches
                    columns = zip(*rows[k : k + 20_000], strict=True)
                    types = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])

    return files.select("file_id", "content").mapInArrow(run, NODES)


def good(nodes: DataFrame) -> DataFrame:
    return nodes.where("error is null").drop("error")


def failed(nodes: DataFrame) -> DataFrame:
    """(file_id, error)"""
    return nodes.where("error is not null").select("file_id", "error")


def lines(nodes: DataFrame) -> DataFrame:
    """(file_id, line, q): the lines of documents with more than two characters, as queries; eight of the block types end a line."""
    ends = tuple(x for x in BREAKS if x != "cite_paragraph")
    piece = F.when(F.col("type").isin(*ends) & F.col("brk"), "\n").when(F.col("type") == "text", F.coalesce("text", F.lit(""))).otherwise("")
    whole = nodes.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("t")))).alias("x")).select("file_id", F.array_join(F.col("x.t"), "").alias("t"))
    return whole.select("file_id", F.posexplode(F.split("t", "\n")).alias("line", "q")).select("file_id", "line", F.trim("q").alias("q")).where(F.char_length("q") > 2)
