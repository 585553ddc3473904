import pytest

from cardmill.operators import evaluate, index, search, vectors

CARD = "card_id long, file_id long, section string, is_evidence int, is_analytic int, tag string, cite string, body string, year string"
FILE = "file_id long, stem string, docx_path string, format string, position string, argtype string, year string, collection string, topic string"


@pytest.fixture(scope="module")
def data(spark):
    files = spark.createDataFrame([(1, "2AC_Fish_Arctic", None, "Policy", "2AC", None, "2024", "A", None), (2, "States_CP", "s.docx", "Policy", None, "Counterplan", "2025-26", "A", "Arctic"), (3, "Empty", None, "Public Forum", None, None, None, None, None)], FILE)
    cards = spark.createDataFrame(
        [
            (10, 1, None, 1, 0, "Fish collapse now", "Smith 04", "fish in the arctic die", None),
            (11, 1, "H > P", 0, 1, None, None, "robots take work", None),
            (12, 2, None, 1, 0, "States solve", "", "fifty states act on fishing", None),
            (13, 2, None, 1, 0, "", None, None, None),
            (14, 2, None, 1, 0, "Cpr saves", "x", "cprx states", None),
            *((20 + i, 2, None, 0, 0, "filler number", "z", f"other{chr(97 + i)} text", None) for i in range(6)),
        ],
        CARD,
    )
    return cards, files


def q(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


def test_exact_search(spark, data):
    cards, files = data
    got = {(r.query_id, r.card_id): r.score for r in search.exact_search(q(spark, "fish arctic", "states cp", "zzz", "zzz fish", "", "fish fish"), cards, files).collect()}
    assert got[0, 10] == 1 + 8 + 10 + 8 + 2 + 1 and (0, 12) not in got  # a longer word does not match a known term
    assert (1, 14) in got and (1, 12) not in got  # two letters are in no index, only a prefix
    assert not [k for k in got if k[0] in (2, 4)]
    assert (3, 10) in got  # an unknown term is passed over
    assert got[5, 10] == 1 + 2 * 18 + 3


def test_pages(spark, data):
    cards, files = data
    first = search.exact_search(q(spark, "states"), cards, files, top=1).collect()
    second = search.exact_search(q(spark, "states"), cards, files, top=1, skip=1).collect()
    assert [r["rank"] for r in first] == [1] and [r["rank"] for r in second] == [2] and first[0].card_id != second[0].card_id


def test_browse_and_title(spark, data):
    cards, files = data
    assert [r.card_id for r in search.browse(cards, files, {"format": "Policy", "collection": "A"}, evidence=True).collect()] == [10, 12, 13, 14]
    with pytest.raises(ValueError, match="topic"):
        search.browse(cards, files, {"topic": "Arctic"})
    got = {(r.query_id, r.card_id): r.score for r in search.title_search(q(spark, "fish arc", "states", "fish none", ""), cards, files).collect()}
    assert got == {(0, 10): 21, (1, 12): 11}


def test_suggestions(spark, data, rows):
    cards, files = data
    vocab = spark.createDataFrame([("fish", 3), ("fist", 9), ("states", 5), ("robots", 1), ("stated", 5)], "term string, df long")
    asked = spark.createDataFrame([("fisj",), ("statex",), ("xobots",), ("xyz",), ("rbots",)], "term string")
    assert rows(index.suggestions(asked, vocab), "term", "suggestion") == [("fisj", "fist"), ("rbots", "robots"), ("statex", "stated"), ("xobots", "robots")]
    dym = {r.query_id: (r.missing, r.suggestion, r.corrected) for r in search.did_you_mean(q(spark, "Arctiq", "zzzzzz", "fish zzzzzz"), cards).collect()}
    assert dym == {0: ("arctiq", "arctic", "arctic"), 1: ("zzzzzz", None, None)}


def test_prefixes_are_the_first_by_alphabet(spark):
    vocab = spark.createDataFrame([(f"pre{i:03}",) for i in range(60)] + [("pre",)], "term string")
    got = index.expanded(spark.createDataFrame([("pr",), ("pre",), ("zz",)], "term string"), vocab).collect()
    assert sorted(r.word for r in got if r.term == "pr") == ["pre", *(f"pre{i:03}" for i in range(40))]
    assert [r.word for r in got if r.term == "pre"] == ["pre"]


def test_contains_search(spark, data, rows):
    cards, files = data
    assert rows(search.index.contains_search(q(spark, "OLLAPSE", "s so", "ab", "states_c"), cards, files)) == [(0, 10), (1, 12), *((3, i) for i in (12, 13, 14, *range(20, 26)))]


def test_fewer_than_three_cards_keep_no_term(spark):
    cards = spark.createDataFrame([(1, 1, None, 1, 0, "tag", "c", "body", None)], CARD)
    assert index.web_postings(cards).count() == 0


def test_smart_search(spark, data):
    cards, files = data
    v = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.7, 0.7])], "card_id long, v array<double>")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>")
    got = {(r.query_id, r.card_id): r.score for r in search.smart_search(q(spark, "fish arctic", "states"), qv, cards, v, files).collect()}
    assert got[0, 10] == 1.0 and got[0, 12] == pytest.approx(0.4 * 0.707107, abs=1e-5) and got[0, 11] == 0
    assert got[1, 12] == 1 + 8 + 10 + 2  # no vector: the plain score


def test_explain_labels_display(spark, data):
    cards, files = data
    asked = q(spark, "states", "nothing")
    found = search.exact_search(asked, cards, files, top=120)
    top = search.explain(found, asked, cards, files).collect()
    assert [(r.query_id, r.place, r.stem, r.cards, r.matched) for r in top] == [(0, 1, "States_CP", 2, "states")]
    assert {r.query_id: r.label for r in search.labels(found, asked, "smart").collect()} == {0: "2 matches · meaning-based", 1: "0 matches · meaning-based"}
    shown = {r.card_id: r for r in search.display(cards, files).collect()}
    assert shown[11].title == "robots take work…" and shown[11].badges.startswith("analytic|2AC|2024|H > P") and shown[13].title == "(untagged card)" and shown[13].weak
    assert shown[12].link == "../s.docx" and shown[10].link == "../2AC_Fish_Arctic.docx"


def test_damping_and_measures(spark, data):
    cards, files = data
    w = evaluate.Weights(1.0, 0.4, 1.0, 1, 0, 0, 0, 0, 0)
    v = spark.createDataFrame([(10, [1.0, 0.0]), (12, [0.0, 1.0])], "card_id long, v array<double>")
    qv = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "query_id long, v array<double>")
    got = {(r.query_id, r.card_id): r.score for r in evaluate.search(q(spark, "the fish", "zzz"), qv, cards, v, files, w).collect()}
    assert got[0, 10] == 1.0 and got[0, 12] == 0.0  # words found: similarity counts nothing
    assert got[1, 12] == 0.4
    results = spark.createDataFrame([("a", 0, "s", 2), ("a", 1, "t", 1), ("b", 0, "x", 1)], "config string, query_id long, stem string, rank int")
    qrels = spark.createDataFrame([(0, "s"), (1, "t"), (2, "u"), (0, "s")], "query_id long, stem string")
    m = {r.config: (r.queries, r.hit1, r.hit3, r.mrr) for r in evaluate.measures(results, qrels, ["a", "b"]).collect()}
    assert m == {"a": (3, 0.333333, 0.666667, 0.5), "b": (3, 0.0, 0.0, 0.0)}
    assert evaluate.best(evaluate.measures(results, qrels, ["a", "b"])).first().config == "a"


def test_terms_keep_stop_words_if_there_are_no_others(spark):
    assert [r.toks for r in evaluate.terms(q(spark, "help me find it", "the fish")).orderBy("query_id").collect()] == [["help", "me", "find", "it"], ["fish"]]


def test_phrases_with_marks_are_words_next_to_each_other(spark, data):
    _, files = data
    cards = spark.createDataFrame([(1, 1, None, 1, 0, "T - USFG", None, None, None), (2, 1, None, 1, 0, "T and USFG", None, None, None), (3, 1, None, 1, 0, "café", None, None, None)], CARD)
    words = spark.createDataFrame([("t--usfg",), ("cafe",)], "term string")
    assert sorted(tuple(r) for r in evaluate.hits(words, cards, files).collect()) == [("cafe", 3), ("t--usfg", 1)]


def test_quantised_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, [127.0, 2.5, -2.5, 3.5]), (2, [0.0, 0.0, 0.0, 0.0])], "k long, v array<double>")
    got = {r.k: (r.q, r.scale) for r in vectors.quantised(df).collect()}
    assert got[1] == ([127, 2, -2, 4], 127.0) and got[2][0] == [0, 0, 0, 0]
    assert vectors.quantised(spark.createDataFrame([(1, [0.0])], "k long, v array<double>")).first().scale == 1.0


def test_query_vectors(spark):
    tv = spark.createDataFrame([("fish", [3.0, 0.0]), ("fishing", [0.0, 4.0]), ("anti", [-3.0, 0.0])], "term string, v array<double>")
    terms = spark.createDataFrame([(1, "fish"), (2, "fishi"), (3, "none"), (4, "fish"), (4, "anti")], "query_id long, term string")
    got = {r.query_id: r.v for r in vectors.query_vectors(vectors.with_prefixes(terms, tv), tv).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0]}


def test_nearest_with_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0])], "k long, v array<double>")
    got = vectors.nearest(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<double>"), v, "k", 3).orderBy("rank").collect()
    assert [(r.k, r.similarity) for r in got] == [(1, 1.0), (5, 1.0), (3, 0.0)]


def test_realigned(spark):
    cards = spark.createDataFrame([(1,), (2,)], "card_id long")
    v = spark.createDataFrame([(2, [1.0, 2.0])], "card_id long, v array<double>")
    assert {r.card_id: (r.v, r.matched) for r in vectors.aligned(cards, v, 2).collect()} == {1: ([0.0, 0.0], False), 2: ([1.0, 2.0], True)}


def test_latent_vectors_keep_similarities(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    groups = [["aa", "bb", "cc"], ["dd", "ee", "ff"]]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(groups[i % 2], 8)) + (" gg" if i % 3 else "")) for i in range(40)], "card_id long, text string")
    weights = vectors.tfidf(docs, least=2, share=0.9)
    m = np.zeros((40, 7))
    terms = sorted({r.term for r in weights.collect()})
    for r in weights.collect():
        m[r.card_id, terms.index(r.term)] = r.weight
    assert np.allclose((m * m).sum(1), 1)
    rows, term_vectors = vectors.lsa(weights, 40, dims=2, rounds=6)
    got = np.array([r.v for r in rows.orderBy("card_id").collect()])
    u, s, _ = np.linalg.svd(m)
    want = u[:, :2] * s[:2]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    assert term_vectors.count() == len(terms)


def test_detail(spark, data):
    cards, files = data
    got = {r.card_id: r for r in search.detail(cards, files, [13, 12, 999]).collect()}
    assert sorted(got) == [12, 13] and got[13].tag == "(untagged card)" and got[13].body.startswith("(no body") and got[12].body == "fifty states act on fishing"


def test_second_ranker_scores_cards_past_the_first_of_a_term_and_the_nearest(spark):
    n = 6100
    files = spark.createDataFrame([(1, "Early"), (2, "Late")], "file_id long, stem string")
    cards = spark.range(n).selectExpr("id AS card_id", f"CASE WHEN id < {n - 1} THEN 1L ELSE 2L END AS file_id", "0 AS is_evidence", f"CASE WHEN id < {n - 1} THEN '' ELSE 'fish' END AS tag", "'' AS cite", "'fish' AS body")
    late = evaluate.search(q(spark, "fish"), None, cards, None, files, evaluate.Weights(1, 0, 0, 1, 10, 0, 0, 0, 0), 1).collect()
    assert [(r.card_id, r.score) for r in late] == [(n - 1, 1.0)]
    v = spark.range(n - 400, n).selectExpr("id AS card_id", f"array(1.0D, CASE WHEN id < {n - 1} THEN 0.0D ELSE 1.0D END) AS v")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>")
    got = {r.stem: r.score for r in evaluate.search(q(spark, "fish"), qv, cards, v, files, evaluate.Weights(0, 1, 0, 1, 0, 0, 0, 0, 0), 2).collect()}
    assert got == {"Early": 1.0, "Late": 0.707107}


def shuffled(spark, df):
    """The rows of df, and how many rows its stages wrote for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        every = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(every.apply, range(every.size()))}

    before = stages()
    got = df.collect()
    return got, sum(n for k, n in stages().items() if k not in before)


def many(spark, n, asked):
    cards = spark.range(n).selectExpr("id AS card_id", "id % 7 AS file_id", "id % 2 AS is_evidence", "CASE WHEN id % 3 = 0 THEN 'Fishing boats' WHEN id % 3 = 1 THEN '' END AS tag", "CASE WHEN id % 5 = 0 THEN 'boats' END AS cite", "CASE WHEN id % 4 < 1 THEN concat('fish boats ', char(97 + id % 26), 'xyz') ELSE concat('other ', char(97 + id % 26), 'zzz') END AS body", "id % 2 AS is_analytic", "'' AS section", "'' AS year")
    cards = cards.unionAll(spark.range(n, 4 * n).selectExpr("id", "id % 7", "0L", "'plain'", "''", "'words only'", "0L", "''", "''"))
    files = spark.range(7).selectExpr("id AS file_id", "concat('Stem_', CASE WHEN id = 3 THEN 'boats' ELSE 'x' END) AS stem", *(f"CAST(NULL AS STRING) AS {c}" for c in ("docx_path", "topic", *search.FACETS)))
    return q(spark, *(f"{('fish', 'boats', 'fish boats', 'boats fish fish', 'axy boats')[i % 5]} z{i}q" for i in range(asked))), cards, files


def test_a_page_needs_no_row_for_every_match(spark, monkeypatch):
    queries, cards, files = many(spark, 3000, 200)
    matched = {(r.query_id, r.card_id) for r in search.matches(queries, cards).collect()}
    toks = {r.query_id: r.toks for r in search.with_terms(queries).collect()}
    rows = {r.card_id: r for r in search.lower_fields(search.passing(cards, files)).collect()}
    score = lambda k, c: 1 + sum(10 * (t in c._tag) + 4 * (t in c._cite) + 8 * (t in c._stem) for t in toks[k]) + 2 * (c.is_evidence != 0) + (len(c.tag or "") > 12)
    want = []
    for k in toks:
        own = sorted((-score(k, rows[c]), c) for j, c in matched if j == k)[:5]
        want += [(k, c, -s, i + 1) for i, (s, c) in enumerate(own)]
    want.sort()
    assert len(want) == 1000 and len(matched) > 100_000
    got, moved = shuffled(spark, search.exact_search(queries, cards, files, top=5))
    assert sorted(tuple(r) for r in got) == want and moved < len(matched) / 2
    monkeypatch.setattr(search.pages, "QUERIES", 70)
    assert sorted(tuple(r) for r in search.exact_search(queries, cards, files, top=5).collect()) == want


def test_a_blend_takes_the_match_after_those_that_fall_back(spark):
    _, cards, files = many(spark, 300, 1)
    v = spark.range(0, 300, 3).selectExpr("id AS card_id", "array(if(id = 0, 1.0D, -1.0D), 0.0D) AS v")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>")
    got = [(r["rank"], r.card_id) for r in search.smart_search(q(spark, "boats"), qv, cards, v, files, top=3).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 115), (3, 185)]


def test_parts_are_found_without_a_row_for_every_trigram(spark, monkeypatch):
    _, cards, files = many(spark, 1000, 1)
    texts = ("Fishing boats", "ing BOATS stem", "hing", "boats", "nothing here", "ai", "plai", "boats boats stem_x", "s S")
    asked = q(spark, *(texts[i % len(texts)] for i in range(90)))
    whole = [(r.card_id, r.w) for r in index.with_stem(cards, files).select("card_id", index.F.lower(index.T.text("tag", "cite", "stem")).alias("w")).collect()]
    want = sorted((r.query_id, c) for r in asked.collect() for c, w in whole if len(r.q) >= 3 and r.q.lower() in w)
    got, moved = shuffled(spark, index.contains_search(asked, cards, files))
    assert sorted(tuple(r) for r in got) == want and moved < len(want) / 2
    monkeypatch.setattr(index, "QUERIES", 40)
    assert sorted(tuple(r) for r in index.contains_search(asked, cards, files).collect()) == want


def test_leaders_need_no_row_for_every_card_of_a_term(spark):
    queries, cards, files = many(spark, 1500, 60)
    w = evaluate.CONFIGS["lexical-first + phrase + title"]
    v = spark.range(0, 1500, 9).selectExpr("id AS card_id", "array(1.0D, id % 5 - 2.0D) AS v")
    qv = spark.range(0, 60, 2).selectExpr("id AS query_id", "array(1.0D, 1.0D) AS v")
    lex = {(r.query_id, r.card_id): r.score for r in evaluate.lexical(queries, cards, files, w, None).collect()}
    sem = {(r.query_id, r.card_id): r.similarity for r in vectors.similarities(qv, v, "card_id").collect()}
    stem = {r.card_id: r.stem for r in index.with_stem(cards, files).collect()}
    want = []
    for k in range(60):
        own, near = {c: s for (j, c), s in lex.items() if j == k}, {c: s for (j, c), s in sem.items() if j == k}
        most, first = max(own.values(), default=0), max(near.values(), default=0)
        damped = w.a_sem * (1 - w.sem_damp * min(1, len(own) / w.lex_sat))
        score = {c: round((w.a_lex * own.get(c, 0) / most if most else 0) + (damped * near[c] / first if c in near else 0), 6) for c in own | near}
        best = {}
        for c in sorted(score, key=lambda c: (-score[c], c)):
            best.setdefault(stem[c], c)
        want += [(k, c, i + 1) for i, c in enumerate(list(best.values())[:2])]
    got, moved = shuffled(spark, evaluate.search(queries, qv, cards, v, files, w, 2))
    assert sorted((r.query_id, r.card_id, r["rank"]) for r in got) == sorted(want) and len(lex) > 50_000 and moved < 3 * len(lex)
