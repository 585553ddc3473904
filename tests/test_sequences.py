import random

import pytest
from pyspark.sql import functions as F

from cardmill.operators import dedupe, nodes, ordered, recover
from cardmill.sources import lists


def test_dense_index_and_running(spark, rows):
    df = spark.createDataFrame([(5,), (900,), (70,), (6,), (-3,)], "k long")
    assert rows(ordered.dense_index(df, "k", "i", width=64)) == [(-3, 0), (5, 1), (6, 2), (70, 3), (900, 4)]
    g = spark.createDataFrame([("a", v) for v in (3, 90, 91, 400)] + [("b", 2)], "g string, v long")
    d = ordered.gaps(g, "g", "v", "d", width=64)
    assert rows(d, "g", "v", "d") == [("a", 3, 3), ("a", 400, 309), ("a", 90, 87), ("a", 91, 1), ("b", 2, 2)]
    assert rows(ordered.running(d, "g", "v", "d", "s", width=64), "v", "s") == [(2, 2), (3, 3), (400, 400), (90, 90), (91, 91)]


def words_by_hand(runs):
    out, current = [], None
    for text, marks, brk in runs:
        for ch in text or "":
            if ch.isspace():
                if current is not None:
                    out.append(current)
                current = None
            else:
                current = (current or set()) | set(marks)
        if brk:
            if current is not None:
                out.append(current)
            current = None
    return out + ([current] if current is not None else [])


def test_word_stitching_equals_a_sequential_count(spark):
    rnd = random.Random(3)
    docs = {}
    for d in range(60):
        docs[d] = [("".join(rnd.choice("ab   \n") for _ in range(rnd.randrange(6))), rnd.sample(["highlight", "shading", "underline_mark"], rnd.randrange(3)), rnd.random() < 0.2) for _ in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame([(d, p, t, m, [], b) for d, runs in docs.items() for p, (t, m, b) in enumerate(runs)], "doc long, pos int, text string, marks array<string>, colors array<string>, brk boolean")
    got: dict = {}
    for r in nodes.words(df, "doc").collect():
        got.setdefault(r.doc, []).append((r.wid, frozenset(r.marks)))
    for d, runs in docs.items():
        assert [m for _, m in sorted(got.get(d, []), key=lambda x: x[0])] == [frozenset(x) for x in words_by_hand(runs)]


def test_both_layers_count_twice(spark):
    df = spark.createDataFrame([(1, 0, "deter", ["highlight"], ["yellow"], False), (1, 1, "rence now", ["shading"], [], False)], "doc long, pos int, text string, marks array<string>, colors array<string>, brk boolean")
    r = nodes.counters(df, "doc").first()
    assert (r.words, r.highlighted, r.shaded) == (2, 3, 2)
    assert [tuple(x) for x in nodes.colours(df, "doc").collect()] == [("yellow", 1)]


def test_sections_equal_a_sequential_walk(spark):
    rnd = random.Random(4)
    data, want = [], {}
    for d in range(80):
        stack = {"hat": None, "pocket": None, "block": None}
        for p in range(rnd.randrange(1, 14)):
            kind = rnd.choice(["hat", "pocket", "block", "card"])
            label = rnd.choice(["", "x", "y"]) if kind != "card" else None
            data.append((d, p, kind, label))
            if label:
                stack[kind] = label
                if kind == "hat":
                    stack["pocket"] = stack["block"] = None
                elif kind == "pocket":
                    stack["block"] = None
            if kind == "card":
                want[d, p] = " > ".join(x for x in stack.values() if x) or None
    df = spark.createDataFrame(data, "doc long, pos int, type string, label string")
    assert {(r.doc, r.pos): r.section for r in nodes.sections(df, "doc").where("type = 'card'").collect()} == want


@pytest.mark.parametrize(("kinds", "want"), [("t-cb", [(0, 2, 3)]), ("tcxxb", [(0, 1, 4)]), ("tcxxxb", []), ("ttcb", [(1, 2, 3)]), ("tccb", []), ("", []), ("tcb", [(0, 1, 2)]), ("t--cb", []), ("tcbtcb", [(0, 1, 2), (3, 4, 5)])])
def test_triples(spark, kinds, want):
    para = {"t": ("A tag", 2, True, 0, "Normal"), "c": ("Smith 2004 (x)", 3, False, 0, "Normal"), "b": ("word " * 50, 50, False, 3, "Normal"), "-": ("filler", 1, False, 0, "Normal"), "x": ("https://x.org", 1, True, 0, "Normal")}
    data = [(1, i, t, w, bold, ul, 0, style) for i, (t, w, bold, ul, style) in enumerate(para[k] for k in kinds)]
    df = spark.createDataFrame(data, "doc_id long, pos int, text string, words int, bold boolean, ul int, hl int, style string")
    assert sorted(tuple(r)[1:] for r in recover.triples(df).collect()) == want


def test_kinds_of_odd_paragraphs(spark):
    data = [(1, 0, None, 0, None, 0, 0, None), (1, 1, "Bold", 1, True, 0, 0, "Heading 2"), (1, 2, "Bold", 1, True, 0, 0, "Heading 4"), (1, 3, " ", 0, True, 0, 0, "x"), (1, 4, "w " * 61, 61, True, 0, 0, "x")]
    df = spark.createDataFrame(data, "doc_id long, pos int, text string, words int, bold boolean, ul int, hl int, style string")
    assert {r.pos: r.kind for r in recover.kinds(df).collect()} == {0: None, 1: None, 2: "tag", 3: None, 4: None}


def test_dedupe_equals_a_sequential_plan(spark):
    rnd = random.Random(6)
    for _ in range(3):
        tree = {}
        for _ in range(60):
            path = "/".join([*rnd.choices(["a", "Completed files", "b"], k=rnd.randrange(3)), rnd.choice(["X.docx", "x.docx", "y.docx", "z.doc"])])
            tree[path] = (rnd.choice([*"123456", None]), rnd.choice([0, 1, None]), rnd.choice([5, 6, None]))
        rank = lambda p: (0 if "Completed files" in p else 1, p.count("/"), len(p), p)
        want, by = {}, {}
        for p in sorted(tree):
            if tree[p][0]:
                by.setdefault(tree[p][0], []).append(p)
        names: dict = {}
        for ps in by.values():
            ordered_ = sorted(ps, key=rank)
            names.setdefault(ordered_[0].rsplit("/", 1)[-1].lower(), []).append(ordered_[0])
            want |= dict.fromkeys(ordered_[1:], "duplicate")
        for ps in names.values():
            o = sorted(ps, key=lambda p: (-(tree[p][1] or 0), -(tree[p][2] or 0), rank(p)[0]))
            want |= {o[0]: "keep"} | dict.fromkeys(o[1:], "review")
        df = spark.createDataFrame([(p, *v, v[0] is not None) for p, v in tree.items()], "path string, md5 string, hl int, words int, ok boolean")
        assert {r.path: r.disposition for r in dedupe.plan(df).collect()} == want
        s = dedupe.summary(df).first()
        assert (s.scanned, s.survivors, s.final) == (len(tree), len(by), len(names))


def test_moves_have_unique_names(spark):
    df = spark.createDataFrame([("a/X.docx", "1", 3, 1, True), ("b/x.docx", "2", 2, 1, True), ("c/x.docx", "3", 1, 1, True), ("c/y.docx", "1", 3, 1, True)], "path string, md5 string, hl int, words int, ok boolean")
    got = {r.path: (r.new_name, r.disposition) for r in dedupe.moves(df).collect()}
    assert got["a/X.docx"] == ("X.docx", "kept") and got["b/x.docx"] == ("x.docx", "version superseded") and got["c/x.docx"] == ("x_2.docx", "version superseded") and got["c/y.docx"] == ("", "exact duplicate removed")


def test_manifest(spark, rows):
    text = "Header\n====\n\na/b/One.docx\n    -> One.docx   [kept]\nroot.docx\n    -> root.docx   [kept]\nstale/path\nx/Two.docx\n\n    -> Two_2.docx   [kept]\n    -> Three.docx   [kept]\nlast/One.docx\n    -> One.docx   [kept]\nOriginal/lost.docx\n    -> lost.docx   [kept]"
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "source string, line_no int, line string")
    assert rows(lists.manifest(df)) == [("One", "last"), ("Two_2", "x")]


def test_empty_tables(spark):
    scan = spark.createDataFrame([], "path string, md5 string, hl int, words int, ok boolean")
    assert dedupe.plan(scan).count() == 0 and tuple(dedupe.summary(scan).first()) == (0, 0, 0, 0, 0, 0)
    assert nodes.totals(spark.createDataFrame([], "words long, highlighted long, underlined long, card_nodes long, evidence long")).first().highlighted_share == 0
    assert ordered.dense_index(spark.createDataFrame([], "k long"), "k", "i").count() == 0
    assert F is not None
