import unicodedata

import pytest
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.operators import facets, intent


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_space_class_is_that_of_unicode_white_space(spark):
    chars = [chr(c) for c in range(0x3001) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i int, c string").where(F.regexp_like("c", F.lit(f"^[{T.SPACE}]$")))
    assert {chr(r.i) for r in df.collect()} == {c for c in chars if c.isspace()}


@pytest.mark.parametrize(
    ("text", "pattern", "want"),
    [("T--USFG speech", T.QUERY_TOKEN, ["t--usfg", "speech"]), ("cp the K", T.INDEX_TOKEN, ["the"]), ("2AC at K!", T.INTENT_TOKEN, ["2ac", "at", "k"]), (None, T.QUERY_TOKEN, []), ("", T.QUERY_TOKEN, [])],
)
def test_tokens(spark, text, pattern, want):
    assert one(spark, text, lambda c: T.tokens(c, pattern)) == want


@pytest.mark.parametrize(
    ("cite", "author", "year"),
    [("Smith 11 (John, editor)", "Smith", "2011"), ("Smith and Jones, 1993", "Smith and Jones", "1993"), ("Jane Doe et al. 88. Ph.D.", "Jane Doe et al", "1988"), ("lower case 2004", None, "2004"), ("", None, None), (None, None, None), ("Smith '31", "Smith", "1931"), ("Smith 30", "Smith", "2030"), ("A" * 100 + " 2001", "A" * 100, None)],
)
def test_citations(spark, cite, author, year):
    assert one(spark, cite, T.cite_author) == author
    assert one(spark, cite, T.cite_year) == year


def test_clean(spark):
    assert one(spark, " ﬁsh   x\x1cy ", T.clean) == "fish x y"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "é", T.clean) == unicodedata.normalize("NFC", "é")


def test_facets_of_names(spark, rows):
    files = spark.createDataFrame([(1, "2AC_Fish_NCX"), (2, "Arctic_2025-26"), (3, "T_Be the Topic (Team Blue)"), (4, None), (5, "Drill '24-'25 PF"), (6, "1NR_K_CP")], "file_id long, stem string")
    assert rows(facets.of_names(files)) == [(1, "2AC", None, "Policy", None), (2, None, None, "Policy", "2025-26"), (3, None, "Topicality", "Policy", None), (4, None, None, "Policy", None), (5, None, "Drill", "Public Forum", "2024-25"), (6, "1NR", "Counterplan", "Policy", None)]
    first = {r.file_id: r for r in facets.of_names_first(files).collect()}
    assert first[1].position is None  # an underscore is a word character
    assert first[2].year is None
    assert first[3].attribution == "Team Blue"
    assert first[5].year == "2024"


def test_facets_of_paths(spark):
    df = spark.createDataFrame([(1, "Policy_Debate/Topics/Arctic_2025-26"), (2, "Policy_Debate/DAs/.x/Kritiks"), (3, ""), (4, None), (5, ".hidden/Topics/PF"), (6, "a/Topics")], "k long, folder string")
    got = {r.k: r for r in facets.of_paths(df, "k", "folder").collect()}
    assert (got[1].topic, got[1].year, got[1].division, got[1].collection) == ("Arctic", "2025-26", "Policy", "Policy Debate / Topics")
    assert (got[2].argtype, got[2].topic) == ("Kritik", None)
    assert not any(got[3][1:]) and not any(got[4][1:])
    assert (got[5].topic, got[5].division, got[5].collection) == (None, None, "Topics / PF")
    assert got[6].topic is None


def test_folder_map_of_a_user():
    m = T.FolderMap({"division": {"_note": "x", "Old": "Policy"}, "stop_topic": {"values": ["Only"]}})
    assert m.division["Old"] == "Policy" and "_note" not in m.division
    assert "Only" in m.stop and "Misc" not in m.stop and "DAs" in m.stop


def test_filename_beats_folder(spark):
    files = spark.createDataFrame([(1, "AT_Fish_LD"), (2, "Fish"), (3, None)], "file_id long, stem string")
    folders = spark.createDataFrame([("AT_Fish_LD", "Public_Forum/DAs"), ("Fish", "Public_Forum/DAs/2AC")], "stem string, folder string")
    got = {r.file_id: r for r in facets.combined(files, folders).collect()}
    assert (got[1].argtype, got[1].format) == ("Answers To", "Lincoln-Douglas")
    assert (got[2].argtype, got[2].format, got[2].position) == ("Disadvantage", "Public Forum", "2AC")
    assert got[3].format == "Policy"


def test_coverage_of_no_files(spark):
    files = spark.createDataFrame([], "division string, collection string, argtype string, position string, year string, topic string")
    assert {(r.n, r.percent) for r in facets.coverage(files).collect()} == {(0, 0.0)}


GOLDEN = {
    "2ac case cards": ("vague", {}), "give me a speech": ("vague", {}), "1nr single payer speech": ("ok", {"single": 1.0, "payer": 1.0}), "topicality": ("ok", {"topicality": 1.0, "t": 0.85}),
    "at k": ("ok", {"k": 1.0, "kritik": 0.85, "kritiks": 0.85, "critique": 0.85}), "states cp cards": ("ok", {"states": 1.0, "cp": 1.0, "counterplan": 0.85, "counterplans": 0.85}),
    "stuff about fish in the arctic": ("ok", {"fish": 1.0, "arctic": 1.0}), "cards": ("vague", {}), "help me find evidence": ("vague", {}), "T--USFG speech": ("ok", {"t": 1.0, "topicality": 0.85, "usfg": 1.0}), "": ("empty", {}),
}


def test_intent(spark):
    q = spark.createDataFrame([(i, x) for i, x in enumerate(GOLDEN)], "query_id long, q string")
    kinds = {r.query_id: r for r in intent.assess(q).collect()}
    terms: dict = {}
    for r in intent.filename_terms(q).collect():
        terms.setdefault(r.query_id, {})[r.term] = r.weight
    for i, (text, (kind, want)) in enumerate(GOLDEN.items()):
        assert kinds[i].kind == kind, text
        assert terms.get(i, {}) == want, text
    assert '"2ac fish arctic"' in kinds[0].message and "nuclear war" in kinds[1].message and kinds[2].message is None


def test_intent_with_frequencies(spark):
    q = spark.createDataFrame([(1, "fish"), (2, "rarity fish"), (3, "new")], "query_id long, q string")
    df = spark.createDataFrame([("fish", 30), ("rarity", 2)], "term string, df long")
    assert {r.query_id: r.kind for r in intent.assess(q, df, 100).collect()} == {1: "vague", 2: "ok", 3: "ok"}


def test_filename_scores(spark, rows):
    q = spark.createDataFrame([(1, "topicality"), (2, "at k")], "query_id long, q string")
    files = spark.createDataFrame([(1, "T_Be the Topic"), (2, "topicality-file"), (3, "strata"), (4, None), (5, "K_x")], "file_id long, stem string")
    assert rows(intent.filename_scores(q, files)) == [(1, 1, 5.1), (1, 2, 4.0), (2, 5, 6.0)]


def test_highlight(spark):
    df = spark.createDataFrame([("a <Fish> & c.t", ["fish", "c.t", "x"]), (None, ["a"])], "t string, q array<string>")
    assert [r[0] for r in df.select(T.highlight(F.col("t"), F.col("q"))).collect()] == ["a &lt;<mark>Fish</mark>&gt; &amp; <mark>c.t</mark>", ""]


def test_trigrams(spark):
    assert one(spark, "abcabc", T.trigrams) == ["abc", "bca", "cab"]
    assert one(spark, "ab", T.trigrams) == [] and one(spark, None, T.trigrams) == []


def test_updated_keeps_columns(spark):
    files = spark.createDataFrame([(1, "AT_Fish_LD", "old", 5)], "file_id long, stem string, position string, words long")
    new = facets.updated(files, spark.createDataFrame([], "stem string, folder string"))
    assert new.columns[:4] == files.columns and new.columns[-1] == "collection"
    r = new.first()
    assert (r.position, r.argtype, r.words) == (None, "Answers To", 5)
