import gzip
import io
import json
import zipfile

import pytest

from cardmill.operators import nodes
from cardmill.sinks import export
from cardmill.sources import lists, trees, word
from cardmill.streaming import ingest


def text(s, *marks):
    return {"type": "text", "text": s, "marks": [{"type": m, "attrs": {"color": "yellow"}} for m in marks]}


def node(kind, *content):
    return {"type": kind, "content": list(content)}


DOC = node(
    "doc",
    node("hat", text("Hat  one")), node("pocket", text("Pocket")), node("block", text("")),
    node("card", node("tag", text("The "), text("tag")), node("cite_paragraph", text("Smith 11 (x)")), node("card_body", text("deter", "highlight"), text("rence works", "shading", "underline_mark"), node("paragraph"), text("more"))),
    node("analytic", text("")),
    node("hat", text("Hat two")),
    node("analytic_unit", node("analytic", text("inner")), node("card_body", text("words"))),
    node("card", node("tag", text("No cite"))),
)


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, doc in (("b.CMIR", DOC), ("sub/c.cmir", None), ("sub/d.cmir", {})):
        data = b"broken" if doc is None else gzip.compress(json.dumps({"format": "cmir", "doc": doc}).encode())
        (tmp_path / name).write_bytes(data)
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_cards_of_trees(spark, tree):
    files = trees.scan(spark, tree)
    assert [r.file_id for r in files.orderBy("file_id").collect()] == [1, 2, 3]
    rows = trees.decode(files).persist()
    assert [(r.file_id, r.error.split(":")[0]) for r in trees.failed(rows).collect()] == [(2, "BadGzipFile")]
    good = trees.good(rows)
    cards = {r.ordinal: r for r in nodes.cards(good).collect()}
    assert sorted(cards) == [1, 3, 4]  # an analytic without text takes a number
    assert (cards[1].section, cards[1].tag, cards[1].cite, cards[1].author, cards[1].year, cards[1].is_evidence) == ("Hat one > Pocket", "The tag", "Smith 11 (x)", "Smith", "2011", 1)
    assert cards[1].body == "deterrence worksmore" and cards[1].words == 8  # a break ends a word for counting, not in the text
    assert (cards[1].highlighted, cards[1].underlined) == (3, 2)
    assert (cards[3].section, cards[3].is_analytic, cards[3].body, cards[3].tag, cards[3].words) == ("Hat two", 1, "innerwords", "innerwords", 2)
    assert (cards[4].is_evidence, cards[4].author, cards[4].body) == (0, None, "")
    whole = nodes.counters(good, "file_id").first()
    assert whole.words == 8 + 2 + 1 + 2 + 2 + 2


def test_flatten_survives_depth():
    deep = node("doc", text("x"))
    for _ in range(5000):
        deep = node("paragraph", deep)
    rows = trees.flatten(deep)
    assert len(rows) == 5002 + 5000 and rows[0][1] == len(rows) - 2


def test_lines_of_queries(spark, tree):
    got = [r.q for r in trees.lines(trees.good(trees.decode(trees.scan(spark, tree)))).orderBy("file_id", "line").collect()]
    assert got[:3] == ["Hat  one", "Pocket", "The tag"]


def docx(xml, styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
XML = f"""<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="h4"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Bold tag</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:u w:val="single"/><w:highlight w:val="yellow"/></w:rPr><w:t>a b</w:t></w:r><w:r><w:rPr><w:highlight w:val="none"/><w:b w:val="0"/></w:rPr><w:t> c</w:t></w:r><w:r><w:rPr><w:shd w:fill="00FF00"/></w:rPr><w:t>d</w:t></w:r></w:p></w:body></w:document>"""


def test_word_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "in").mkdir()
    styles = f'<w:styles {NS}><w:style w:styleId="h4"><w:name w:val="heading 4"/></w:style></w:styles>'
    for name, data in (("in/a.DOCX", docx(XML, styles)), ("in/b.doc", b"old"), ("c.docx", b"no zip"), ("~$a.docx", b"lock"), (".git/x.docx", b"x"), ("n.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files = word.scan(spark, str(tmp_path))
    got = {r.path: (r.hl, r.words, r.ok) for r in word.fingerprints(files).collect()}
    assert got == {"in/a.DOCX": (2, 4, True), "in/b.doc": (0, 0, False), "c.docx": (0, 0, False)}
    p = word.paragraphs(files).orderBy("pos").collect()
    assert [(r.text, r.words, r.bold, r.ul, r.hl, r.style) for r in p] == [("Bold tag", 2, True, 0, 0, "Heading 4"), ("a b cd", 3, False, 1, 1, "")]
    names = spark.createDataFrame([("a.docx",), ("a.doc",), ("b.txt",), (None,)], "name string")
    assert [tuple(r) for r in word.lookup(names).collect()] == [("a", "a.docx")]


def test_lists(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# head\n\nstates cp\n at k \n")
    assert [r.q for r in lists.queries(spark, str(tmp_path / "q.txt")).collect()] == ["states cp", "at k"]
    (tmp_path / "g.json").write_text(json.dumps({"a": ["x", "y"], "b": []}))
    assert lists.qrels(spark, str(tmp_path / "g.json")).count() == 2
    (tmp_path / "m.txt").write_text("a/b.docx\n    -> b.docx   [kept]\n")
    assert [tuple(r) for r in lists.manifest_file(spark, str(tmp_path / "m.txt")).collect()] == [("b", "a")]
    assert lists.manifest_file(spark, str(tmp_path / "none.txt")).count() == 0


def test_export_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(5, "S", None, "Policy", None, "DA", "2024", "C", None)], "file_id long, stem string, docx_path string, format string, position string, argtype string, year string, collection string, topic string")
    cards = spark.createDataFrame([(i, 5, None, 1, f"tag{chr(97 + i)}", None, "shared " * (i < 1), 1) for i in range(4)], "card_id long, file_id long, section string, is_evidence int, tag string, cite string, body string, x int")
    data = export.payload(cards, files)
    page = export.page(f"<p>{export.PLACE}</p>", data)
    got = export.unpacked(page[3:-4])
    assert got["cards"][1] == ["tagb", "", 0, "", 1, 0, ""] and got["terms"]["shared"] == [0] and got["meta"]["years" if "years" in got["meta"] else "year"] == ["2024"]
    with pytest.raises(ValueError, match="template"):
        export.page("<p></p>", data)
    export.tables(str(tmp_path / "out"), files, cards)
    assert spark.read.parquet(str(tmp_path / "out/postings_fts")).where("term = 'taga'").count() == 1


def test_stream_takes_new_files_once(spark, tree, tmp_path):
    out, state = str(tmp_path / "o"), str(tmp_path / "s")
    for _ in range(2):
        ingest.start(spark, tree, out, state).awaitTermination(120)
    assert spark.read.parquet(f"{out}/cards").count() == 3 and spark.read.parquet(f"{out}/errors").count() == 1


def test_vectors_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1.0, -0.5]), (2, [0.0, 0.25])], "card_id long, v array<double>")
    terms = spark.createDataFrame([("fish", [0.5, 0.5])], "term string, v array<double>")
    export.vectors(str(tmp_path), docs, terms)
    got = {r.card_id: r.v for r in lists.vectors(spark, str(tmp_path), "card_vectors").collect()}
    assert got[1] == pytest.approx([1.0, -64 / 127]) and got[2] == pytest.approx([0, 32 / 127])
    assert lists.vectors(spark, str(tmp_path), "term_vectors").first().v == [0.5, 0.5]


def test_folder_map_file(tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"argtype": {"Cards": "Cards"}, "stop_topic": ["A"]}))
    m = lists.folder_map(str(tmp_path / "map.json"))
    assert m.argtype["Cards"] == "Cards" and m.argtype["DAs"] == "Disadvantage" and "A" in m.stop
    assert lists.folder_map(None).stop == lists.folder_map(str(tmp_path / "none")).stop
