import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill.llm import leaks, mixture, names, neardup, queries, repetition, shared, spans, survivors, terms, vocabulary
from cardmill.llm.leaks import align

VOCABULARY = [f"w{i}" for i in range(200)]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def shingles(t, n):
    w = t.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rnd, t, rate):
    return " ".join(rnd.choice(VOCABULARY) if rnd.random() < rate else w for w in t.split())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    out = []
    for _ in range(60):
        base = prose(rnd, 60)
        out.append(base)
        out += [edited(rnd, base, r) for r in (0.02, 0.06, 0.15)[: rnd.randrange(4)]]
    out += [out[0]] * 5 + ["", None, "w1 w2", "w1"]
    rnd.shuffle(out)
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "extra", None) for i, t in enumerate(texts)], "k long, t string, id string, class string")
    sets = [shingles(t or "", 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and len(sets[i] & sets[j]) * 2 >= len(sets[i] | sets[j])}
    got = {(r.a, r.b): r.similarity for r in neardup.pairs(df, "k", ["t"], shingle=3, threshold=0.5).collect()}
    assert set(got) == want
    assert all(abs(s - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9 for (a, b), s in got.items())
    few = {(r.a, r.b) for r in neardup.pairs(df, "k", ["t"], shingle=3, threshold=0.5, expand=3).collect()}
    copies = [i for i, t in enumerate(texts) if t == max(texts, key=texts.count)]
    assert {p for p in few if p[0] in copies and p[1] in copies} == {(copies[0], c) for c in copies[1:]}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {r.id: (r.group_id, r.copies) for r in neardup.groups(df, "k", ["t"], shingle=3, threshold=0.5).collect()}
    assert {k: g for k, (g, _) in groups.items()} == {i: root(i) for i in range(len(texts)) if any(i in p for p in want)}
    assert all(groups[c][1] == len(copies) - 1 for c in copies)
    assert neardup.pairs(df.limit(0), "k", ["t"]).count() == 0


def test_bands_reach_the_recall():
    for threshold, rows, recall in ((0.5, 3, 0.99), (0.8, 3, 0.99), (0.8, 5, 0.999)):
        b = neardup.bands_for(threshold, rows, recall)
        assert 1 - (1 - threshold**rows) ** b >= recall > 1 - (1 - threshold**rows) ** (b - 1)


def test_many_copies_cost_a_row_each(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("one two three four five six seven").alias("t"))
    assert neardup.pairs(df, "k", ["t"], shingle=3, threshold=0.5).count() == 2999


@pytest.mark.parametrize(("copies", "how"), [(70, {}), (6, {"expand": 3})])
def test_different_texts_of_many_rows_are_all_paired(spark, copies, how):
    one, near = "one two three four five six seven", "one two three four five six eight"
    kinds = [(one, None)] * copies + [(one.upper(), None)] * 3 + [(one.replace(" ", ", "), ""), ("one", one[4:]), (one, "")] + [(near, None)] * copies + [(near.title(), None)] * 2
    rnd = random.Random(3)
    rnd.shuffle(kinds)
    kinds = [(i, *k) for i, k in enumerate(kinds)]
    least = {}
    for i, t, u in kinds:
        least.setdefault((t, u or ""), i)
    crowded = {(one, ""), (near, "")}
    stands = {i for i, t, u in kinds if (t, u or "") not in crowded or least[t, u or ""] == i}
    want = {(i, j) for i in stands for j in stands if i < j} | {(least[t, u or ""], i) for i, t, u in kinds if i not in stands}
    df = spark.createDataFrame(kinds, "k long, t string, u string")
    got = [(r.a, r.b) for r in neardup.pairs(df, "k", ["t", "u"], shingle=3, threshold=0.5, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("copies", "part"), [(2, 1000), (70, 1000), (30, 4)])
def test_the_pairs_of_cards_are_all_pairs_whatever_the_copies(spark, tmp_path, monkeypatch, copies, part):
    monkeypatch.setattr(neardup, "PART", part, raising=False)
    one, near, far = "one two three four five six seven", "one two three four five six eight", "four five six seven eight"
    cards = [(one, None)] * copies + [(near, "")] * copies + [(one.title(), None), ("one", one[4:]), (far, None), (far, None), ("one two", None), (None, None)]
    random.Random(4).shuffle(cards)
    sets = [shingles(f"{t or ''} {b or ''}".lower(), 3) for t, b in cards]
    spark.createDataFrame([(i, t, None, b) for i, (t, b) in enumerate(cards)], "card_id long, tag string, cite string, body string").write.parquet(f"{tmp_path}/cards.parquet")
    want = sorted((i, j) for j in range(len(cards)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) * 2 >= len(sets[i] | sets[j]))
    assert sorted((r.card_a, r.card_b) for r in queries.p1_found(spark, str(tmp_path)).collect()) == want


def test_pairs_of_cards_that_share_just_half_are_all_found(spark, tmp_path):
    cards = []
    for i in range(0, 4000, 2):
        both = " ".join(f"w{i}x{k}" for k in range(8))
        cards += [(i, both, None, f"{i} a{i} b{i}"), (i + 1, None, both, f"{i + 1} c{i} d{i}")]
    sets = [shingles(" ".join(t or "" for t in c[1:]), 3) for c in cards]
    want = {(i, i + 1) for i in range(0, 4000, 2)}
    assert all(len(sets[i] & sets[j]) * 2 == len(sets[i] | sets[j]) for i, j in want)
    spark.createDataFrame(cards, "card_id long, tag string, cite string, body string").write.parquet(f"{tmp_path}/cards.parquet")
    assert {(r.card_a, r.card_b) for r in queries.p1_found(spark, str(tmp_path)).collect()} == want


def test_cards_without_an_id_are_in_no_pair(spark, tmp_path):
    one, near = "one two three four five six seven", "one two three four five six eight"
    cards = [(None, one), (None, one), (1, near), (2, near), (None, near), (3, "one two three four five six nine")]
    spark.createDataFrame([(i, None, None, t) for i, t in cards], "card_id long, tag string, cite string, body string").write.parquet(f"{tmp_path}/cards.parquet")
    assert sorted((r.card_a, r.card_b) for r in queries.p1_found(spark, str(tmp_path)).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, rnd.randrange(101, 140)) for _ in range(30)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[x] for a, x in edges if a == 100} == {100} and got[201] == 200 and len(got) == 41 + 1 + len({x for a, x in edges if a == 100}) + 2
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shared_by_hand(bodies, n):
    where = collections.defaultdict(set)
    split = {k: [w for w in (t or "").split(" ") if w] for k, t in bodies.items()}
    for k, w in split.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(k)
    out = []
    for k, w in split.items():
        hit = [False] * (len(w) + 1)
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                hit[i : i + n] = [True] * n
        i = 0
        while i < len(w):
            if hit[i]:
                j = i
                while hit[j]:
                    j += 1
                out.append((k, i, j - i))
                i = j
            i += 1
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 2])
def test_shared_spans_equal_brute_force(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rnd = random.Random(11)
    passages = [prose(rnd, n) for n in (25, 26, 40, 90, 24)]
    bodies = {}
    for k in range(120):
        parts = [prose(rnd, rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages).split(" ")
            a = rnd.randrange(0, 8)
            parts += [" ".join(p[a : a + rnd.randrange(20, 90)]), prose(rnd, rnd.randrange(0, 12))]
        bodies[k] = " ".join(x for x in parts if x)
    bodies |= {200: None, 201: "", 202: "a " * 80, 203: "a " * 80, 204: "a " * 30 + "b", 205: passages[2] + " " + passages[2], 206: "C " + passages[2].upper()}
    df = spark.createDataFrame([(k, t, 1) for k, t in bodies.items()], "card_id long, body string, id int")
    assert rows(spans.shared_spans(df, "card_id", "body")) == sorted(shared_by_hand(bodies, 25), key=repr)
    assert spans.shared_spans(df.limit(0), "card_id", "body").count() == 0
    got = {r.card_id: (r.n_words, r.shared_words) for r in spans.shares(df, "card_id", "body").collect()}
    assert len(got) == len(bodies) and got[200] == (0, 0) and got[202] == (80, 80)


def test_a_span_within_one_record_is_not_shared(spark):
    rnd = random.Random(1)
    p = prose(rnd, 40)
    assert spans.shared_spans(spark.createDataFrame([(1, p + " x " + p)], "k long, t string"), "k", "t").count() == 0


def test_log_entropy(spark):
    docs = {1: "Fish fish​ ｆish cat", 2: "cat", 3: None, 4: "dog dog dog dog"}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "k long, t string, term string")
    got = {(r.k, r.term): (r.tf, r.df, r.score) for r in terms.log_entropy(df, "k", ["t"]).collect()}
    assert got[1, "fish"] == (3, 1, pytest.approx(math.log(4)))
    assert got[1, "cat"] == (1, 2, pytest.approx(math.log(2) * (1 - math.log(2) / math.log(4))))
    assert len(got) == 4
    assert {(r.k, r.term) for r in terms.log_entropy(df, "k", ["t"], least_tf=4, most_df=1).collect()} == {(4, "dog")}
    assert terms.log_entropy(df.limit(0), "k", ["t"]).count() == 0
    assert terms.log_entropy(df.where("k = 2"), "k", ["t"]).first().score == pytest.approx(math.log(2))


def test_frequencies_of_ngrams_equal_counting(spark):
    rnd = random.Random(2)
    docs = [" ".join(rnd.choice("ab") + rnd.choice(["", "x"]) for _ in range(rnd.randrange(9))) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(t, 1) for t in docs], "t string, n int")
    occ, rec = collections.Counter(), collections.Counter()
    for t in docs:
        w = (t or "").split()
        g = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        occ.update(g)
        rec.update(set(g))
    got = {r.term: (r.occurrences, r.records) for r in vocabulary.frequencies(df, ["t"], longest=3).collect()}
    assert got == {g: (occ[g], rec[g]) for g in occ}
    assert vocabulary.frequencies(df.limit(0), ["t"]).count() == 0


def test_ngrams_of_cards_are_a_query(spark, tmp_path):
    cards = [(1, "A b", "c a B"), (2, None, "b c, a"), (3, "x", None)]
    spark.createDataFrame(cards, "card_id long, tag string, body string").write.parquet(f"{tmp_path}/cards.parquet")
    got = {r.term: (r.n, r.occurrences, r.records) for r in queries.queries()["p5_ngrams"](spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 3, 2), "b": (1, 3, 2), "c": (1, 2, 2), "x": (1, 1, 1), "a b": (2, 2, 1), "b c": (2, 2, 2), "c a": (2, 2, 2), "a b c": (3, 1, 1), "b c a": (3, 2, 2), "c a b": (3, 1, 1)}


def test_marks(spark):
    df = spark.createDataFrame([("a", 36), ("b", 35), ("c", 2), ("d", 3)], "term string, records long")
    assert {r.term: r.mark for r in vocabulary.marked(df, 100, rare=2, common=(35, 100)).collect()} == {"a": "common", "b": None, "c": "rare", "d": None}


def repeated_by_hand(w, n):
    seen = collections.defaultdict(list)
    for i in range(len(w) - n + 1):
        seen[tuple(w[i : i + n])].append(i)
    inside = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + n)}
    longest = 0
    for m in range(n, len(w)):
        if len({tuple(w[i : i + m]) for i in range(len(w) - m + 1)}) < len(w) - m + 1:
            longest = m
    return len(inside), longest


def test_repetition_equals_brute_force(spark):
    rnd = random.Random(9)
    docs = []
    for _ in range(60):
        parts = [prose(rnd, rnd.randrange(4, 20)) for _ in range(3)]
        docs.append(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))))
    docs += [None, "", "x " * 100, "one two three four five six seven", "a b c d e f g h a b c d e f g h"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(docs)], "k long, t string, share double")
    got = {r.k: r for r in repetition.repetition(df, "k", "t").collect()}
    for i, t in enumerate(docs):
        w = (t or "").split()
        assert (got[i].n_words, got[i].repeated_words, got[i].longest) == (len(w), *repeated_by_hand(w, 8)), i
    assert got[60].share == 0 and got[62].share == 1


RECORD = "file_id long, stem string, highlighted long, words long, year string, a string, b string, n int"


def test_stems(spark):
    same = ["1AC_K_Ganeboma_VCX_2024-25", "1AC-K-Ganeboma-VCX-2024-﻿25 (1)", "1AC KRIT­IK GANEBOMA VCX 2024-25 (1)", "Copy of 1ac.kritik.ganeboma.vcx.2024-25", "1AC_K_Ganeboma_VCX_2024-25 - Copy", "1AC_K_Ganeboma_VCX_2024-25_v3 FINAL", "1AC_K_Ganeboma_VCX_2024-25 (recovered)", "1AC_K_Ganeboma_VCX_2024-25 copy 2"]
    other = ["1AC_K_Ganeboma_VCX_2023-24", "2AC_K_Ganeboma_VCX_2024-25", "Lesson_03_Fish", "Lesson_04_Fish", "A2 Fish", None, ""]
    df = spark.createDataFrame(list(enumerate(same + other)), "file_id long, stem string")
    got = {r.file_id: r.group_key for r in survivors.stem_key(df, "file_id", "stem").collect()}
    assert len({got[i] for i in range(len(same))}) == 1
    assert [got[len(same) + i] for i in range(7)] == ["1ac k ganeboma vcx 2023 24", "2ac k ganeboma vcx 2024 25", "lesson 03 fish", "lesson 04 fish", "at fish", "", ""]


def test_survivors(spark):
    rows = [
        (1, "g", 5, 10, "2020", None, "b1", 1), (2, "g", 9, 5, None, None, None, 1), (3, "g", 9, 7, "2019", None, None, 1), (4, "g", 1, 1, "2025", "a4", "b4", 1), (5, "g", 9, 7, "2019", None, None, 1), (6, "g", None, None, "1999", "a6", "b6", 1),
        (7, "h", None, None, None, None, None, 1), (8, None, 1, 1, "2020", "x", "y", 1),
    ]
    df = spark.createDataFrame(rows, RECORD)
    year = F.col("year")
    got = {r.stem: r for r in survivors.survivors(df, "file_id", "stem", ["highlighted", "words"], year, ["a", "b", "highlighted"]).collect()}
    g = got["g"]
    assert (g.n, g.first_id, g.best_id, g.skyline) == (6, 1, 3, 3)  # 3 by trust, 1 by year, 4 by year and completeness
    assert (g.a, g.b, g.highlighted) == ("a4", "b1", 9)
    assert (got["h"].best_id, got["h"].a, got["h"].n) == (7, None, 1) and len(got) == 2
    assert survivors.survivors(df.limit(0), "file_id", "stem", ["words"], year, ["a"]).count() == 0


def test_survivors_have_every_column_of_files(spark, tmp_path):
    text = ("stem", "cmir_path", "docx_path", "format", "position", "argtype", "year", "attribution", "outline", "topic", "division", "orig_folder", "collection")
    count = ("words", "highlighted", "underlined", "tagline_emph", "shaded", "card_nodes", "analytics_n", "evidence", "analytics")
    schema = ", ".join(["file_id long", *(f"{c} string" for c in text), *(f"{c} long" for c in count)])
    best = {"file_id": 2, "stem": "Aff Case", "cmir_path": "p2", "year": "2020", "highlighted": 9, "words": 50, "shaded": 4, "evidence": 7}
    other = {"file_id": 1, "stem": "aff_case - copy", "cmir_path": "p1", "year": "2020", "highlighted": 5, "outline": "o1", "format": "f1", "shaded": 3, "tagline_emph": 6, "card_nodes": 8, "analytics_n": 1, "analytics": 2}
    names = ("file_id", *text, *count)
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in (best, other)], schema).write.parquet(f"{tmp_path}/files.parquet")
    (got,) = queries.p6_survivors(spark, str(tmp_path)).collect()
    known = {c: best.get(c, other.get(c)) for c in names[1:]}
    assert {c: got[c] for c in known} == known and (got.best_id, got.n) == (2, 2)
    # the other knows more fields, though fewer of those of names and folders, so neither dominates
    assert got.skyline == 2


def test_layers_equal_peeling():
    rnd = random.Random(4)
    points = [(rnd.randrange(4), rnd.randrange(4), i) for i in rnd.sample(range(30), 20)]
    out = survivors.layers(points)
    assert sorted(i for layer in out for i in layer) == list(range(20))
    left = set(range(20))
    for layer in out:
        best = {i for i in left if not any(j != i and all(x >= y for x, y in zip(points[j], points[i], strict=True)) for j in left)}
        assert best == set(layer)
        left -= best


AUTHORS = [(1, "Zoë Lindström", "person", "Calder Society"), (2, "Robert Merricley", "person", None), (3, "Ursula Merricley", "person", "Oakmere Council"), (4, "Calder Society for Rural Development", "organisation", None), (5, "Brennick Institute for Polar Studies", "organisation", None), (6, None, "person", None)]
CITES = {
    "Lindström 04 (x)": {1}, "LINDSTRÖM, Z. '98 — y": {1}, "Lindstroem ZK 2001 [a": {1}, "Zoe Lidnström, PhD, 2004. t": {1}, "Lindström (Zoë) 2004 — Calder Society, “T,” J": {1}, "Lindström 2004 — Oakmere Council, “T,” J": set(), "Anna Lindström 2004": set(), "A. Lindström 2004": set(),
    "Bob Merricley 99 x": {2}, "Merricley, U. et al. 2010": {3}, "Dr. Ursula K. Merricly & Zoë Lindström ’22 (": {1, 3}, "Anna Merricley 2010": set(), "Peters 2004 (Calder Society, “T”)": set(),
    "C.S.R.D. 2004 — x": {4}, "BIPS ’20 (": {5}, "Calder Soc. for Rural Dev., 2003. x": {4}, "The Brennick Institute on Polar Studies 99": {5}, "Institute for Polar Studies, Brennick 2003 (": {5}, "Brenick Institue for Polar Studis 2003": {5}, "Brennick Society for Polar Studies 2003": set(),
    "L​indstrоm 2004": {1}, "": set(), "2004": set(), "No year here": set(),
}


def test_names(spark):
    cards = spark.createDataFrame([(i, c, "x") for i, c in enumerate([*CITES, None])], "card_id long, cite string, author string")
    authors = spark.createDataFrame(AUTHORS, "author_id long, name string, kind string, affiliation string")
    got = collections.defaultdict(set)
    for r in names.attribute(cards, "card_id", "cite", authors, "author_id").collect():
        got[r.card_id].add(r.author)
    for i, (cite, want) in enumerate(CITES.items()):
        assert got[i] == want, cite
    assert names.attribute(cards.limit(0), "card_id", "cite", authors, "author_id").count() == 0
    assert names.attribute(cards, "card_id", "cite", authors.limit(0), "author_id").count() == 0


def test_long_citations_lose_no_author(spark):
    many = "; ".join(f"Peters{chr(97 + k % 26)}ov, A." for k in range(60))
    cites = [f"{many} & Zoë Lindström 2004 (x)", f"Zoe Lindström{' ' * 600}2004 — Oakmere Council, “T,” J", "Lindström & " + " " * 50_000 + "Bob Merricley" + " ," * 50_000 + "99 x"]
    cards = spark.createDataFrame(list(enumerate(cites)), "k long, cite string")
    authors = spark.createDataFrame(AUTHORS, "author_id long, name string, kind string, affiliation string")
    got = {(r.k, r.author) for r in names.attribute(cards, "k", "cite", authors, "author_id").collect()}
    assert got == {(0, 1), (2, 1), (2, 2)}  # the second is another of that name, at another place


def test_frequent_spellings_are_names_of_their_own(spark):
    authors = spark.createDataFrame(AUTHORS[:1], "author_id long, name string, kind string, affiliation string")
    cites = [f"Lindstram {2000 + i} x" for i in range(8)] + ["Lindström 2003 x", "Lindstrim 2003 x"]
    cards = spark.createDataFrame(list(enumerate(cites)), "k long, cite string")
    assert {r.k for r in names.attribute(cards, "k", "cite", authors, "author_id").collect()} == {8, 9}


def test_edits():
    for a, b, n in (("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xbc", 1), ("abc", "bac", 1), ("abc", "cab", None), ("abcd", "abxy", None)):
        assert names.near(a, b) == n == names.near(b, a)


def test_leaks_equal_brute_force(spark, rows):
    rnd = random.Random(13)
    stock = "read the passage and answer the question below"
    items = {i: (stock + " " if i % 2 else "") + prose(rnd, rnd.randrange(20, 50)) for i in range(20)} | {50: None, 51: "short item here", 52: stock + " only"}
    docs = {}
    for k in range(150):
        parts = [prose(rnd, rnd.randrange(5, 30))]
        if rnd.random() < 0.5:
            w = items[rnd.randrange(20)].split()
            a, n = rnd.randrange(0, 10), rnd.randrange(9, 30)
            parts += [" ".join(w[a : a + n]).upper(), prose(rnd, 9)]
        if rnd.random() < 0.3:
            parts.insert(0, stock)
        docs[k] = ", ".join(parts)
    docs |= {500: None, 501: ""}
    want = {(k, i) for k, d in docs.items() for i, t in items.items() if shingles((d or "").lower().replace(",", ""), 12) & shingles(t or "", 12)}
    d = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, seeds string")
    b = spark.createDataFrame([(i, t, "s") for i, t in items.items()], "item_id long, text string, suite string")
    found = leaks.leaks(d, "doc_id", "text", b, "item_id", "text")
    assert set(rows(found.where("longest_run >= 12"), "doc_id", "item_id")) == want and want
    assert leaks.leaks(d.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leaks.leaks(d, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def test_leaks_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k l m y")], "k long, t string")
    b = spark.createDataFrame([(i, "a b c d e f g h i j k l m" + " z" * i) for i in range(6)], "i long, t string")
    assert rows(leaks.leaks(d, "k", "t", b, "i", "t"), "k", "i", "longest_run") == [(1, i, 13) for i in range(6)]


def test_leaks_of_edited_copies_with_short_runs(spark, rows):
    rnd = random.Random(17)
    item = [f"i{k}" for k in range(60)]
    runs = {}
    for k in range(30):  # changed words 7 to 12 apart, so runs of 6 to 11 words, elsewhere in each copy
        w, at = list(item), rnd.randrange(6, 12)
        while at < len(w):
            w[at] = f"x{k}"
            at += rnd.randrange(7, 13)
        runs[k] = " ".join([prose(rnd, 20), *w, prose(rnd, 20)])
    once = {100: " ".join(["a", *item[24:30], "b", *item[31:37], "c", *item[38:44], "d"])}  # its seeds also stand in many others
    d = spark.createDataFrame([*runs.items(), *once.items()], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, prose(rnd, 40))], "item_id long, text string")
    found = leaks.leaks(d, "doc_id", "text", b, "item_id", "text")
    assert rows(found, "doc_id", "item_id") == sorted([(k, 1) for k in (*runs, *once)], key=repr)
    assert found.where("longest_run > 11 or longest_run < 6").count() == 0
    alone = leaks.leaks(d.where("doc_id = 0"), "doc_id", "text", b, "item_id", "text")
    assert rows(alone, "doc_id", "item_id") == [(0, 1)]
    whole = spark.createDataFrame([(200, " ".join(item))], "doc_id long, text string")  # seeds across a change are the rarest
    beside = leaks.leaks(d.where("doc_id = 0").union(whole), "doc_id", "text", b, "item_id", "text")
    assert rows(beside, "doc_id", "item_id") == [(0, 1), (200, 1)]


def test_alignments_at_once_equal_single_ones(monkeypatch):
    monkeypatch.setattr(leaks, "CELLS", 50)
    rnd = np.random.default_rng(4)
    docs, items = ([rnd.integers(2, 7, rnd.integers(1, n)).astype(np.uint64) for _ in range(60)] for n in (30, 40))
    best, longest = leaks.aligned(docs, items)
    assert [*zip(best, longest, strict=True)] == [align(a, b) for a, b in zip(docs, items, strict=True)]


def test_alignment_equals_the_full_table():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        a, b = rnd.integers(0, 5, rnd.integers(1, 20)), rnd.integers(0, 5, rnd.integers(1, 12))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        run = np.zeros_like(h)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                same = a[j - 1] == b[i - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        assert align(a.astype(np.uint64), b.astype(np.uint64)) == (h.max(), run.max())


def test_quotas():
    q = mixture.quotas({"a": 100, "b": 100, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": None, "c": None}, 200)
    assert q == pytest.approx({"a": 100, "b": 100, "c": 0})
    assert mixture.quotas({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20.0}
    assert mixture.quotas({}, {"a": 1.0}, {"a": None}, 100) == {"a": 0.0}
    fall = mixture.slopes({"a": 10, "b": 100}, {"a": 50.0, "b": 50.0}, 0.5)
    assert fall["a"] < 0 < fall["b"] and fall["a"] * 50 + fall["b"] * 50 == 0


def test_mixture(spark):
    rnd = random.Random(21)
    docs = [(i, prose(rnd, rnd.randrange(5, 40)), rnd.choice(["Big Source", "big_source ", "small", "other", None]), "x") for i in range(400)] + [(900, None, "small", "x"), (901, "", "small", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("big_source", 0.3, None), ("small", 0.6, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = mixture.mix(d, "doc_id", "text", "source", t).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    per = collections.Counter((r.doc_id, r.source) for r in rows)
    assert {s for _, s in per} == {"big_source", "small"} and max(n for (_, s), n in per.items() if s == "small") <= 3
    counts = collections.Counter(n for (_, s), n in per.items() if s == "big_source")
    assert max(counts) - min(counts) <= 1  # whole rounds before anything repeats again
    line = {r.source: r for r in mixture.report(d, "doc_id", "text", "source", t).collect()}
    assert line["gone"].mixed_tokens == 0 and abs(line["small"].actual_share - 0.6667) < 0.02
    total = sum(r.tokens for r in rows)
    assert total == sum(x.mixed_tokens for x in line.values()) and abs(total - (line["small"].supply_tokens + line["big_source"].supply_tokens)) < 100
    half = [r for r in rows if r.position < total / 2]
    assert abs(sum(r.tokens for r in half) - total / 2) < 0.05 * total  # demand is even over training
    late = sum(r.tokens for r in rows if r.source == "small" and r.position > total / 2)
    assert rows and late != sum(r.tokens for r in rows if r.source == "small") / 2
    assert mixture.mix(d.limit(0), "doc_id", "text", "source", t).count() == 0
    assert mixture.mix(d, "doc_id", "text", "source", t.limit(0)).count() == 0


def test_nulls_in_keys_do_not_crash(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (1, "one two three four five six"), (None, None)], "k long, t string")
    assert terms.log_entropy(df, "k", ["t"]).count() == 12
    assert repetition.repetition(df, "k", "t").count() == 3
    assert neardup.pairs(df, "k", ["t"], shingle=3, threshold=0.5).count() <= 1
    assert spans.shared_spans(df, "k", "t", span=9).count() == 0
