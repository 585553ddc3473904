import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cardmill.llm import consistent, glyphs, words

ALPHABET = "aZ9 \t\n-ﬁﬃéöｅＡ９̧́̈ 　 ​­﻿аеоѕԁһΟνβЖщΛ東\U0001f600Ĳĳйй"


def by_hand(s: str) -> str:
    """The same rules, a text at a time."""
    s = "".join(c for c in s if not any(a <= ord(c) <= b for a, b in glyphs.WIDTHLESS))
    s = "".join(unicodedata.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in glyphs.COMPATIBLE) else " " if unicodedata.category(c) == "Zs" or c == "\t" else c for c in s)
    s = unicodedata.normalize("NFC", s)

    def word(m: re.Match) -> str:
        if not any("LATIN" in unicodedata.name(x, "") for x in m[0]):
            return m[0]
        out = []
        for x in unicodedata.normalize("NFD", m[0]):
            out.append(glyphs.LOOKALIKE.get(x, x))
        new, old = unicodedata.normalize("NFC", "".join(out)), m[0]
        return new if any(c in glyphs.LOOKALIKE for c in unicodedata.normalize("NFD", old)) else old

    return re.sub(r"(?:[^\W_]|[̀-ͯ])+", word, s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=12)), max_size=8))
def test_consistent_form_equals_the_rules_by_hand(texts):
    cp, at = glyphs.decode(pa.array(texts, pa.string()))
    out, to, changed = glyphs.consistent(cp, at)
    got = glyphs.encode(out, to).to_pylist()
    assert got == [by_hand(t or "") for t in texts]
    assert changed.tolist() == [g != (t or "") for g, t in zip(got, texts, strict=True)]
    again, _, twice = glyphs.consistent(out, to)
    assert not twice.any() and (again == out).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=10)), max_size=6))
def test_round_trip_of_any_text(texts):
    column = pa.array([None if t is None else t.encode("utf-8", "replace").decode() for t in texts], pa.string())
    assert glyphs.encode(*glyphs.decode(column)).to_pylist() == [t or "" for t in column.to_pylist()]
    if len(texts) > 2:
        assert glyphs.encode(*glyphs.decode(column.slice(1, 2))).to_pylist() == [t or "" for t in column.slice(1, 2).to_pylist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab1 _-é", max_size=14), max_size=6), st.integers(1, 4))
def test_words_and_grams(texts, n):
    w = words.Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\W_]+", t) for t in texts]
    flat = w.texts(np.arange(len(w.start))).to_pylist()
    assert [flat[a:b] for a, b in zip(w.at[:-1], w.at[1:], strict=True)] == want
    first, h = w.grams(n)
    grams = [tuple(x[i : i + n]) for x in want for i in range(len(x) - n + 1)]
    assert len(grams) == len(h) and len(set(grams)) == len(set(h.tolist()))
    assert len({(g, k) for g, k in zip(grams, h.tolist(), strict=True)}) == len(set(grams))


def test_slices_bound_characters_and_lose_no_row(monkeypatch):
    monkeypatch.setattr(words, "CHARS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 4, None, "b" * 50, "", "c" * 9, "d"])], names=["x"])
    parts = list(words.slices(batch, "x"))
    assert sum((p.column("x").to_pylist() for p in parts), []) == batch.column("x").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 3]


def test_forms_of_rows(spark, rows):
    df = spark.createDataFrame([(1, "ｆull", None, "x"), (2, "", "plain", "y"), (2, "", "plain", "y"), (None, "сat​", "café", "z")], "id long, a string, b string, _0 string")
    got = rows(consistent.consistent_form(df, "id", ["a", "b"]))
    assert got == [(1, "a", "full", True), (1, "b", "", False), (2, "a", "", False), (2, "a", "", False), (2, "b", "plain", False), (2, "b", "plain", False), (None, "a", "cat", True), (None, "b", "café", False)]
    assert rows(consistent.consistent_form(df, "id", ["b"], only_changed=True)) == []
    assert consistent.consistent_form(df.limit(0), "id", ["a"]).count() == 0


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "ｗord " * 400_000)], "id long, a string")
    r = consistent.consistent_form(df, "id", ["a"]).selectExpr("length(text) n", "changed").first()
    assert (r.n, r.changed) == (2_000_000, True)
