"""Problem 3: visually identical text with different characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import glyphs, words


def consistent_form(df: DataFrame, key: str, fields: list[str], *, only_changed: bool = False) -> DataFrame:
    """(key, field, text, changed), a row for each row and field of df: the field's text in consistent form and whether
    that differs from the stored text.

    Full-width and joined letters become plain letters, a letter and its separate accent one letter, characters without
    width vanish, every blank becomes a plain space, and look-alikes become Latin letters in words with Latin letters.
    Line breaks stay. A null field is the empty text, unchanged; rows that repeat come out as often; columns not named
    are not read. Texts of any length are handled whole. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def form(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, field in enumerate(fields):
            column = words.joined(part, f"_{i}")
            cp, at, changed = glyphs.consistent(*glyphs.decode(column))
            rows = np.nonzero(changed)[0] if only_changed else np.arange(part.num_rows)
            if only_changed:
                cp, at = glyphs.pick(cp, at, rows)
            texts = glyphs.encode(cp, at).cast(pa.string())
            out.append([part.column("_key").take(pa.array(rows)), pa.array(np.repeat(field, len(rows)), pa.string()), texts, pa.array(changed[rows])])
        columns = [pa.concat_arrays([x[i] for x in out]) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["_key", "field", "text", "changed"])

    names = [f"_{i}" for i in range(len(fields))]
    narrow = df.select(F.col(key).alias("_key"), *(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)))
    return narrow.mapInArrow(words.over(form, *names), f"_key {kind}, field string, text string, changed boolean").withColumnRenamed("_key", key)
