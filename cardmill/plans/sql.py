"""The same results as the queries, as SQL for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..functions import text as T
from ..operators import dedupe, evaluate, facets, intent, recover

EVERY = 50
SPACE = T.SPACE


def lit(s: object) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern of Java as one of RE2: code points in braces."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


def words(values: object) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def text(*columns: str) -> str:
    return " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)


def tokens(expr: str, pattern: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {lit(pattern)})"


def alone(word: str) -> str:
    return f"(?:^|[^A-Za-z0-9])(?:{word})(?:[^A-Za-z0-9]|$)"


def first_match(c: str, patterns: tuple[tuple[str, str], ...], default: str = "NULL") -> str:
    """Look-arounds become the characters themselves, as only whether it matches counts."""
    out = "CASE"
    for value, p in patterns:
        p = p.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "(?:[^A-Za-z0-9]|$)")
        out += f" WHEN regexp_matches({c}, {lit('(?i)' + p)}) THEN {lit(value)}"
    return f"{out} ELSE {default} END"


ASKED = f"asked AS (SELECT card_id AS query_id, array_to_string(list_slice(string_split(tag, ' '), 1, 3), ' ') AS q FROM cards WHERE card_id % {EVERY} = 0 AND tag <> '')"
NAMED = f"named AS (SELECT file_id AS query_id, stem AS q FROM files WHERE file_id % {EVERY} = 0 AND stem <> '')"
TYPED = f"mistyped AS (SELECT query_id, substr(w, 1, 3) || substr(w, 5) AS q FROM (SELECT query_id, list_filter({tokens('q', T.QUERY_TOKEN)}, lambda x: length(x) >= 6)[1] AS w FROM asked) WHERE w IS NOT NULL)"
POSTS = f"posts AS (SELECT DISTINCT unnest({tokens(text('tag', 'cite', 'body'), T.INDEX_TOKEN)}) AS term, card_id FROM cards)"
VOCAB = "vocab AS (SELECT term, count(*)::BIGINT AS df FROM posts GROUP BY term HAVING count(*) <= floor((SELECT count(*) FROM cards) * 0.35))"
EVALDF = f"evaldf AS (SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT unnest({tokens(text('tag', 'cite', 'body', 'stem'), T.QUERY_TOKEN)}) AS term, card_id FROM cards JOIN files USING (file_id)) GROUP BY term)"
INDEX = "idx AS (SELECT card_id, row_number() OVER (ORDER BY card_id) - 1 AS card_idx FROM cards)"
DELTA = "delta AS (SELECT term, card_idx, (card_idx - coalesce(lag(card_idx) OVER (PARTITION BY term ORDER BY card_idx), 0))::BIGINT AS delta FROM posts JOIN vocab USING (term) JOIN idx USING (card_id))"


def expand(source: str) -> str:
    """known(query_id?, term, word) for the terms of a relation with a column term."""
    return f"""wanted AS (SELECT DISTINCT term FROM {source}),
known AS (SELECT term, term AS word FROM wanted WHERE term IN (SELECT term FROM vocab)
 UNION ALL SELECT term, word FROM (SELECT w.term, v.term AS word, row_number() OVER (PARTITION BY w.term ORDER BY v.term) AS k FROM wanted w JOIN vocab v ON starts_with(v.term, w.term) WHERE w.term NOT IN (SELECT term FROM vocab)) WHERE k <= 41)"""


def matches(queries: str) -> str:
    return f"""qt AS (SELECT query_id, {tokens('q', T.QUERY_TOKEN)} AS toks FROM {queries}),
each AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM qt),
{expand('each')},
found AS (SELECT query_id, count(DISTINCT term) AS n FROM each WHERE term IN (SELECT term FROM known) GROUP BY query_id),
hits AS (SELECT e.query_id, p.card_id, count(DISTINCT e.term) AS k FROM each e JOIN known k ON e.term = k.term JOIN posts p ON p.term = k.word GROUP BY ALL),
matched AS (SELECT query_id, card_id FROM hits JOIN found USING (query_id) WHERE k = n)"""


LEX = f"""{ASKED}, {POSTS}, {VOCAB}, {matches('asked')},
lex AS (SELECT m.query_id, m.card_id, (1 + coalesce(list_sum(list_transform(toks, lambda t: 8 * contains(lower(coalesce(stem, '')), t)::INT + 10 * contains(lower(coalesce(tag, '')), t)::INT + 4 * contains(lower(coalesce(cite, '')), t)::INT)), 0)
  + CASE WHEN is_evidence <> 0 THEN 2 ELSE 0 END + CASE WHEN length(tag) > 12 THEN 1 ELSE 0 END)::BIGINT AS score
 FROM matched m JOIN qt USING (query_id) JOIN cards c USING (card_id) JOIN files f ON c.file_id = f.file_id),
page AS (SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id)::INT AS rank FROM lex)"""
TITLE = f"""{NAMED}, nt AS (SELECT query_id, {tokens('q', T.QUERY_TOKEN)} AS toks FROM named),
tf AS (SELECT query_id, file_id, len(toks) AS n FROM nt JOIN files ON len(toks) > 0 AND len(list_filter(toks, lambda t: NOT contains(lower(coalesce(stem, '')), t))) = 0),
titled AS (SELECT query_id, card_id, (n * 10 + e)::BIGINT AS score FROM (SELECT query_id, card_id, n, CASE WHEN is_evidence <> 0 THEN 1 ELSE 0 END AS e, row_number() OVER (PARTITION BY query_id, tf.file_id ORDER BY CASE WHEN is_evidence <> 0 THEN 1 ELSE 0 END DESC, card_id) AS k FROM tf JOIN cards USING (file_id)) WHERE k = 1)"""
VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
W3 = evaluate.CONFIGS["lexical-first + phrase + title"]
FTS = r"regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def fts() -> str:
    parts = " UNION ALL ".join(f"SELECT card_id, '{f}' AS field, {FTS.format(f)} AS w FROM cards JOIN files USING (file_id) WHERE {f} <> ''" for f in ("tag", "cite", "body", "stem"))
    return f"ftsw AS ({parts})"


def lexical(w: evaluate.Weights, name: str) -> str:
    return f"""{name} AS (SELECT query_id, card_id, sum(idf * (1.0 + CASE WHEN contains(tag, term) THEN {w.w_tag} ELSE 0 END + CASE WHEN contains(cite, term) THEN {w.w_cite} ELSE 0 END + CASE WHEN contains(stem, term) THEN {w.w_title} ELSE 0 END))
 + max(CASE WHEN phrase <> '' AND contains(tag || ' ' || body, phrase) THEN {w.w_phrase} ELSE 0 END + CASE WHEN phrase <> '' AND contains(stem, phrase) THEN {w.w_title * 2} ELSE 0 END + CASE WHEN is_evidence <> 0 THEN {w.w_eviden} ELSE 0 END) AS score
 FROM scored GROUP BY ALL)"""


FIRST_HITS = f" QUALIFY row_number() OVER (PARTITION BY term ORDER BY card_id) <= {evaluate.HITS}"


def eval_rows(cut: str = "") -> str:
    return f"""{ASKED}, {EVALDF}, {fts()},
et0 AS (SELECT query_id, {tokens('q', T.QUERY_TOKEN)} AS raw FROM asked),
et AS (SELECT query_id, CASE WHEN len(list_filter(raw, lambda t: NOT list_contains({words(evaluate.STOP)}, t))) > 0 THEN list_filter(raw, lambda t: NOT list_contains({words(evaluate.STOP)}, t)) ELSE raw END AS toks FROM et0),
eterm AS (SELECT query_id, array_to_string(toks, ' ') AS phrase, unnest(toks) AS term FROM et),
pat AS (SELECT DISTINCT term, ' ' || array_to_string(regexp_extract_all(term, '[a-z0-9]+'), ' ') || ' ' AS needle FROM eterm),
eh AS (SELECT term, card_id FROM (SELECT DISTINCT term, card_id FROM pat JOIN ftsw ON contains(' ' || array_to_string(w, ' ') || ' ', needle)){cut}),
scored AS (SELECT query_id, card_id, term, phrase, ln(1 + ((SELECT count(*) FROM cards) - df + 0.5) / (df + 0.5)) AS idf, lower(coalesce(tag, '')) AS tag, lower(coalesce(cite, '')) AS cite, lower(coalesce(body, '')) AS body, lower(coalesce(stem, '')) AS stem, is_evidence
 FROM eterm JOIN eh USING (term) JOIN evaldf USING (term) JOIN cards USING (card_id) JOIN files USING (file_id))"""


def semantic(limit: int | None) -> str:
    cut = "" if limit is None else f" QUALIFY k <= {limit}"
    return f"""{VEC}, near AS (SELECT query_id, card_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, card_id) AS k FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS card_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON true WHERE a.vec_id % {EVERY} = 0 AND a.vec_id IN (SELECT query_id FROM asked)){cut})"""


def ranker() -> str:
    out = f"{eval_rows()}, {semantic(None)}"
    for i, w in enumerate(evaluate.CONFIGS.values()):
        out += f""", {lexical(w, f'lex{i}')}, size{i} AS (SELECT query_id, count(*) AS n, max(score) AS most FROM lex{i} GROUP BY query_id),
both{i} AS (SELECT query_id, card_id, round(sum(score), 6) AS score FROM (SELECT query_id, card_id, CASE WHEN most <> 0 THEN {w.a_lex} * score / most ELSE 0 END AS score FROM lex{i} JOIN size{i} USING (query_id)
 UNION ALL SELECT near.query_id, near.card_id, {w.a_sem} * (1 - {w.sem_damp} * least(1.0, coalesce(n, 0) / {float(w.lex_sat)})) * near.similarity / coalesce(nullif(f.similarity, 0), 1) FROM near JOIN near f ON f.query_id = near.query_id AND f.k = 1 LEFT JOIN size{i} ON size{i}.query_id = near.query_id) GROUP BY ALL),
best{i} AS (SELECT query_id, card_id, coalesce(stem, '') AS stem, score FROM both{i} JOIN cards USING (card_id) JOIN files USING (file_id) QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(stem, '') ORDER BY score DESC, card_id) = 1)"""
    rows = " UNION ALL ".join(f"SELECT {lit(name)} AS config, query_id, stem, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id)::INT AS rank FROM best{i} QUALIFY rank <= {evaluate.BEST}" for i, name in enumerate(evaluate.CONFIGS))
    return f"""{out}, results AS ({rows}),
answers AS (SELECT DISTINCT query_id, coalesce(stem, '') AS stem FROM asked JOIN cards ON card_id = query_id JOIN files USING (file_id))"""


METRICS = f"""configs AS (SELECT unnest({words(evaluate.CONFIGS)}) AS config), firsts AS (SELECT config, query_id, min(rank) AS r FROM results JOIN answers USING (query_id, stem) GROUP BY ALL),
measured AS (SELECT config, count(*)::BIGINT AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr
 FROM (SELECT config, query_id FROM configs, (SELECT DISTINCT query_id FROM answers)) LEFT JOIN firsts USING (config, query_id) GROUP BY config)"""
SCAN = f"""facts AS (SELECT path, md5, coalesce(hl, 0) AS hl, coalesce(words, 0) AS words, CASE WHEN contains(path, {lit(dedupe.CURATED)}) THEN 0 ELSE 1 END AS curated, length(path) - length(replace(path, '/', '')) AS depth, lower(regexp_extract(path, '[^/]*$')) AS name FROM scan WHERE md5 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY curated, depth, length(path), path) AS k, min(path) OVER (PARTITION BY md5) AS first FROM facts),
alive AS (SELECT path, name, hl, words, row_number() OVER (PARTITION BY name ORDER BY hl DESC, words DESC, curated, first)::INT AS version FROM ranked WHERE k = 1)"""
MOVES = f"""{SCAN}, named AS (SELECT path, regexp_extract(path, '[^/]*$') AS n, CASE WHEN version = 1 THEN 'kept' ELSE 'version superseded' END AS disposition FROM alive),
moves AS (SELECT path, CASE WHEN k = 1 THEN n ELSE regexp_extract(n, '^(.*?)(\\.[^.]*)?$', 1) || '_' || k || regexp_extract(n, '^(.*?)(\\.[^.]*)?$', 2) END AS new_name, disposition FROM (SELECT *, row_number() OVER (PARTITION BY disposition, lower(n) ORDER BY path) AS k FROM named)
 UNION ALL SELECT path, '', 'exact duplicate removed' FROM ranked WHERE k > 1)"""
MARKS = "list_filter([CASE WHEN l_returnflag = 'R' THEN 'highlight' END, CASE WHEN l_linestatus = 'O' THEN 'underline_mark' END, CASE WHEN l_quantity > 40 THEN 'shading' END], lambda x: x IS NOT NULL)"
RUNS = f"""pieces AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS pos, string_split(l_partkey || ' ' || l_suppkey || CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE '' END, ' ') AS p, {MARKS} AS marks, CASE WHEN l_returnflag = 'R' THEN 'c' || (l_partkey % 9) END AS color FROM lineitem),
flat AS (SELECT doc, pos, marks, color, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM pieces),
wids AS (SELECT *, sum(CASE WHEN j > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos, j) AS wid FROM flat),
wordrows AS (SELECT doc, wid, list_distinct(flatten(list(marks))) AS marks, list_distinct(list(color) FILTER (color IS NOT NULL)) AS colors FROM wids WHERE piece <> '' GROUP BY ALL)"""
HEADS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
heads AS (SELECT doc_id, pos::INT AS pos, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+:') THEN 'hat' WHEN regexp_matches(line, '^[0-9]+[.]') THEN 'block' WHEN length(line) < 60 THEN 'pocket' ELSE 'card' END AS type, nullif(substr(line, 1, 120), '') AS l0 FROM lines),
labelled AS (SELECT doc_id, pos, type, CASE WHEN type <> 'card' THEN l0 END AS l FROM heads)"""
def n_words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, {lit(re2('[' + SPACE + ']+'))}), lambda x: x <> ''))"



PARAS = "paras AS (" + " UNION ALL ".join(f"SELECT file_id AS doc_id, ordinal * 3 + {k} AS pos, coalesce({f}, '') AS text, {n_words(f"coalesce({f}, '')")} AS words, {b} AS bold, {'underlined' if f == 'body' else '0'} AS ul, {'highlighted' if f == 'body' else '0'} AS hl FROM cards" for k, f, b in ((0, "tag", "true"), (1, "cite", "false"), (2, "body", "false"))) + ")"
TRIMMED = f"regexp_replace(text, {lit(re2('^[' + SPACE + ']+|[' + SPACE + ']+$'))}, '', 'g')"
KINDS = f"""{PARAS}, kinds AS (SELECT *, CASE WHEN {TRIMMED} = '' OR regexp_matches(text, {lit(recover.LINK)}) THEN NULL WHEN words >= 40 AND (ul > 0 OR hl > 0) THEN 'body' WHEN words <= 90 AND regexp_matches({TRIMMED}, {lit(re2(recover.CITE))}) THEN 'cite' WHEN words <= 60 AND bold THEN 'tag' END AS kind FROM paras)"""
SEG = "list_filter(string_split({0}, '/'), lambda p: p <> '' AND NOT starts_with(p, '.'))"


def season(c: str) -> str:
    p = lit(T.SEASON)
    g = [f"regexp_extract({c}, {p}, {i})" for i in range(6)]
    return f"CASE WHEN {g[1]} <> '' THEN {g[1]} || '-' || {g[2]} WHEN {g[3]} <> '' THEN {g[3]} WHEN {g[4]} <> '' THEN '20' || {g[4]} || '-' || {g[5]} END"


def year_first(c: str) -> str:
    p = lit(T.SEASON_FIRST)
    g = [f"regexp_extract({c}, {p}, {i})" for i in range(5)]
    return f"CASE WHEN {g[1]} <> '' THEN {g[1]} WHEN {g[2]} <> '' THEN {g[2]} WHEN {g[4]} <> '' THEN '20' || {g[4]} END"


def mapping(values: dict[str, str], x: str) -> str:
    return "CASE " + x + "".join(f" WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END"


def path_facets(source: str, key: str, folder: str) -> str:
    m = T.FolderMap()
    seg = SEG.format(folder)
    topic = f"trim(replace(trim(regexp_replace(parts[list_position(parts, 'Topics') + 1], {lit(T.SEASON)}, '', 'g'), '_- '), '_', ' '))"
    return f"""pf0 AS (SELECT *, {seg} AS parts FROM (SELECT *, nullif({folder}, '') AS fo FROM {source})),
pf AS (SELECT {key}, CASE WHEN list_position(parts, 'Topics') > 0 AND length({topic}) >= 3 AND NOT list_contains({words(m.stop)}, {topic}) THEN substr({topic}, 1, 40) END AS topic,
 list_filter(list_transform(list_reverse(parts), lambda p: {season('p')}), lambda y: y IS NOT NULL)[1] AS year,
 list_filter(list_transform(list_reverse(parts), lambda p: {mapping(m.position, 'p')}), lambda y: y IS NOT NULL)[1] AS position,
 list_filter(list_transform(list_reverse(parts), lambda p: {mapping(m.argtype, 'p')}), lambda y: y IS NOT NULL)[1] AS argtype,
 {mapping(m.division, "string_split(fo, '/')[1]")} AS division,
 nullif(substr(array_to_string(list_transform(list_slice(parts, 1, 2), lambda p: replace(p, '_', ' ')), ' / '), 1, 48), '') AS collection FROM pf0)"""


def intent_sql(source: str, columns: str) -> str:
    toks = tokens("q", T.INTENT_TOKEN)
    return f"""SELECT {columns} FROM (SELECT query_id, q, {toks} AS toks, list_filter({toks}, lambda t: NOT list_contains({words(intent.STRUCTURAL)}, t)) AS content, list_filter({toks}, lambda t: regexp_matches(t, '^[12][an][crm]$') AND list_contains({words(intent.STRUCTURAL)}, t))[1] AS form FROM {source})"""


FILEQ = "fq AS (SELECT {0} AS query_id, replace(coalesce({1}, ''), '_', ' ') AS q FROM {2})"


def filename_terms(source: str) -> str:
    both = intent.expansions()
    more = "CASE t " + " ".join(f"WHEN {lit(k)} THEN {words(v)}" for k, v in both.items()) + " ELSE []::VARCHAR[] END"
    toks = tokens("q", T.INTENT_TOKEN)
    return f"""fx AS (SELECT query_id, flatten(list_transform(list_filter({toks}, lambda t: NOT list_contains({words(intent.STRUCTURAL)}, t) OR list_contains({words(both)}, t)), lambda t: list_concat([{{'term': t, 'weight': 1.0::DOUBLE}}], list_transform({more}, lambda e: {{'term': e, 'weight': 0.85::DOUBLE}})))) AS l FROM {source}),
fe AS (SELECT query_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM fx),
ff AS (SELECT query_id, x.term AS term, min(pos) AS pos, arg_min(x.weight, pos) AS weight FROM fe GROUP BY ALL),
ft AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS place, term, weight FROM ff)"""


def vocabulary() -> str:
    chips = " UNION ALL ".join(f"SELECT * FROM (SELECT '{f}' AS facet, {f} AS value, row_number() OVER (ORDER BY count(*) DESC, {f})::INT AS rank FROM files WHERE {f} <> '' GROUP BY {f}) WHERE rank <= {n}" for f, n in facets.SHOWN.items())
    return f"{chips} UNION ALL SELECT * FROM (SELECT 'year' AS facet, year AS value, row_number() OVER (ORDER BY year DESC)::INT AS rank FROM (SELECT DISTINCT year FROM files WHERE regexp_matches(year, '^[0-9]+$'))) WHERE rank <= {facets.YEARS}"


def top(facet: str, n: int, value: str) -> str:
    return f"SELECT {value} AS value, count(*)::BIGINT AS n FROM files WHERE {value} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"




def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, {lit(re2('[' + SPACE + ']+'))}, ' ', 'g'))"



TEXTS = f"texts AS (SELECT card_id, lower(array_to_string(list_filter([nullif(tag, ''), nullif(cite, ''), nullif(substr(body, 1, 1200), ''), nullif(stem, '')], lambda x: x IS NOT NULL), ' ')) AS text FROM cards JOIN files USING (file_id))"
BADGES = "array_to_string(list_filter([CASE WHEN is_evidence <> 0 THEN 'evidence' ELSE 'analytic' END, nullif(f.argtype, ''), nullif(f.position, ''), nullif(f.topic, ''), nullif(f.year, ''), nullif(substr(section, 1, 46), '')], lambda x: x IS NOT NULL), '|')"
ESCAPED = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def statements() -> dict[str, str]:
    cite_year = f"ltrim(regexp_extract(substr(cite, 1, 80), {lit(T.YEAR)}, 1), '''’')"
    broad, closing = lit(intent.BROAD), lit(intent.CLOSING)
    vague = f"""{broad} || ' ' || CASE WHEN form IS NOT NULL THEN 'Add the topic or argument: instead of "' || q || '", try "' || form || ' answers to the states counterplan" or "' || form || ' fish arctic".' ELSE 'Add a topic or argument name — instead of "' || q || '", try "nuclear war impacts" or "answers to the cap K".' END || ' ' || {closing}"""
    kind = "CASE WHEN len(toks) = 0 THEN 'empty' WHEN len(content) > 0 THEN 'ok' ELSE 'vague' END"
    dym = f"""WITH {ASKED}, {TYPED}, {POSTS}, {VOCAB}, {matches('mistyped')},
miss AS (SELECT query_id, arg_min(term, pos) AS missing FROM (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM qt) WHERE term NOT IN (SELECT term FROM known) AND query_id NOT IN (SELECT query_id FROM matched) GROUP BY query_id)"""
    near = """near0 AS (SELECT t.term, v.term AS suggestion, v.df, row_number() OVER (PARTITION BY t.term ORDER BY v.df DESC, v.term) AS k FROM {0} t JOIN vocab v ON abs(length(t.term) - length(v.term)) <= CASE WHEN length(t.term) <= 4 THEN 1 ELSE 2 END AND (substr(t.term, 1, 1) = substr(v.term, 1, 1) OR substr(t.term, 2, 1) = substr(v.term, 2, 1) AND substr(t.term, 2, 1) <> '') AND levenshtein(t.term, v.term) <= CASE WHEN length(t.term) <= 4 THEN 1 ELSE 2 END)"""
    s = {
        "term_df_web": f"WITH {POSTS}, {VOCAB} SELECT term, df FROM vocab",
        "term_df_eval": f"WITH {EVALDF} SELECT term, df FROM evaldf",
        "postings_delta": f"WITH {POSTS}, {VOCAB}, {INDEX}, {DELTA} SELECT term, card_idx, delta FROM delta",
        "postings_roundtrip": f"WITH {POSTS}, {VOCAB}, {INDEX} SELECT term, count(*)::BIGINT AS n, sum(card_idx)::BIGINT AS total FROM posts JOIN vocab USING (term) JOIN idx USING (card_id) GROUP BY term",
        "postings_fts": f"WITH {fts()} SELECT term, field, count(*)::BIGINT AS df FROM (SELECT DISTINCT card_id, field, unnest(w) AS term FROM ftsw) GROUP BY ALL",
        "dense_file_index": "SELECT card_id, file_idx FROM cards JOIN (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS file_idx FROM files) USING (file_id)",
        "browse_facets": "SELECT card_id, 0::BIGINT AS score FROM cards JOIN files USING (file_id) WHERE is_evidence = 1 AND files.format = 'Policy' AND files.argtype = 'Kritik'",
        "title_search": f"WITH {TITLE} SELECT * FROM titled",
        "exact_search": f"WITH {LEX} SELECT query_id, card_id, score, rank FROM page WHERE rank <= 60",
        "prefix_expand": f"WITH {ASKED}, {POSTS}, {VOCAB}, heads AS (SELECT DISTINCT substr(w, 1, 4) AS term FROM (SELECT unnest({tokens('q', T.QUERY_TOKEN)}) AS w FROM asked)), {expand('heads')} SELECT term, word FROM known",
        "missing_terms": f"WITH {ASKED}, {TYPED}, {POSTS}, {VOCAB}, {matches('mistyped')} SELECT query_id, term FROM (SELECT query_id, unnest(toks) AS term FROM qt) WHERE term NOT IN (SELECT term FROM known)",
        "suggest_terms": f"WITH {ASKED}, {TYPED}, {POSTS}, {VOCAB}, w AS (SELECT DISTINCT q AS term FROM mistyped), {near.format('w')} SELECT term, suggestion, df FROM near0 WHERE k = 1",
        "did_you_mean": f"{dym}, w AS (SELECT DISTINCT missing AS term FROM miss), {near.format('w')} SELECT query_id, missing, suggestion, substr(q, 1, strpos(lower(q), missing) - 1) || suggestion || substr(q, strpos(lower(q), missing) + length(missing)) AS corrected FROM miss JOIN mistyped USING (query_id) LEFT JOIN (SELECT * FROM near0 WHERE k = 1) n ON n.term = missing",
        "trigram_search": f"WITH {ASKED} SELECT query_id, card_id FROM asked JOIN (SELECT card_id, lower({text('tag', 'cite', 'stem')}) AS whole FROM cards JOIN files USING (file_id)) ON length(substr(q, 3, 9)) >= 3 AND contains(whole, lower(substr(q, 3, 9)))",
        "smart_search": f"""WITH {LEX}, {semantic(400)}, top AS (SELECT query_id, max(score) AS most FROM lex GROUP BY query_id),
blended AS (SELECT query_id, card_id, round(sum(score), 6) AS score FROM (SELECT lex.query_id, card_id, CASE WHEN lex.query_id IN (SELECT query_id FROM near) THEN 0.6 * score / greatest(most, 1) ELSE score::DOUBLE END AS score FROM lex JOIN top USING (query_id)
 UNION ALL SELECT near.query_id, near.card_id, 0.4 * near.similarity / coalesce(nullif(f.similarity, 0), 1) FROM near JOIN near f ON f.query_id = near.query_id AND f.k = 1 WHERE near.card_id IN (SELECT card_id FROM cards JOIN files USING (file_id))) GROUP BY ALL)
SELECT query_id, card_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id)::INT AS rank FROM blended QUALIFY rank <= 60""",
        "explain_panel": f"""WITH {LEX}, r AS (SELECT p.query_id, c.file_id, p.score, p.rank, lower(coalesce(tag, '')) AS tag, lower(substr(coalesce(body, ''), 1, 320)) AS body FROM page p JOIN cards c USING (card_id) WHERE rank <= 120),
g AS (SELECT query_id, file_id, count(*)::BIGINT AS cards, sum(score)::BIGINT AS score, min(rank) AS first, arg_min(tag, rank) AS tag, arg_min(body, rank) AS body FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS place FROM g)
SELECT query_id, place, stem, cards, score, CASE WHEN place = 1 THEN array_to_string(list_filter(toks, lambda t: contains(tag, t) OR contains(body, t)), ', ') ELSE '' END AS matched FROM o JOIN files USING (file_id) JOIN qt USING (query_id) WHERE place <= 4""",
        "result_labels": f"WITH {TITLE} SELECT query_id, n, format('{{:,}}', n) || CASE WHEN n = 1 THEN ' match' ELSE ' matches' END || ' · titles' AS label FROM (SELECT query_id, count(card_id)::BIGINT AS n FROM named LEFT JOIN titled USING (query_id) GROUP BY query_id)",
        "display_cards": f"SELECT card_id, CASE WHEN tag <> '' THEN tag WHEN body <> '' THEN substr(body, 1, 140) || '…' ELSE '(untagged card)' END AS title, length(coalesce(tag, '')) < 12 AS weak, substr(coalesce(cite, ''), 1, 190) AS cite, {BADGES} AS badges, stem, '../' || replace(replace(replace(replace(replace(url_encode(coalesce(nullif(docx_path, ''), stem || '.docx')), '~', '%7E'), '%2A', '*'), '%2a', '*'), '+', '%2B'), '%20', '%20') AS link FROM cards JOIN files f USING (file_id)",
        "highlighted_tags": f"""WITH {LEX} SELECT query_id, card_id, list_reduce(list_prepend({ESCAPED.replace('{0}', 'tag')}, list_filter(toks, lambda t: length(t) >= 2)), lambda acc, t: regexp_replace(acc, '(?i)(' || regexp_escape(t) || ')', '<mark>\\1</mark>', 'g')) AS html FROM page JOIN cards USING (card_id) JOIN qt USING (query_id) WHERE rank <= 60""",
        "eval_lexical": f"WITH {eval_rows(FIRST_HITS)}, {lexical(W3, 'lex')} SELECT query_id, card_id, round(score, 4) AS score FROM lex",
        "rank_metrics": f"WITH {ranker()}, {METRICS} SELECT * FROM measured",
        "rank_best": f"WITH {ranker()}, {METRICS} SELECT * FROM measured ORDER BY mrr DESC, hit3 DESC, config LIMIT 1",
        "rank_report": f"WITH {ranker()} SELECT config, query_id, rank, stem, (query_id, stem) IN (SELECT (query_id, stem) FROM answers) AS good FROM results",
        "intent_assess": intent_sql("(SELECT card_id AS query_id, coalesce(section, '') AS q FROM cards)", f"query_id, {kind} AS kind, array_to_string(content, ' ') AS content, CASE {kind} WHEN 'empty' THEN 'Type something to search for.' WHEN 'vague' THEN {vague} END AS message"),
        "intent_assess_df": f"WITH {EVALDF}, i AS ({intent_sql('(SELECT card_id AS query_id, tag AS q FROM cards WHERE tag <> {0})'.format(lit('')), 'query_id, toks, content')}), r AS (SELECT query_id, bool_or(coalesce(df, 0) < (SELECT count(*) FROM cards) * 0.25) AS rare FROM (SELECT query_id, unnest(content) AS term FROM i) LEFT JOIN evaldf USING (term) GROUP BY query_id) SELECT query_id, CASE WHEN len(toks) = 0 THEN 'empty' WHEN rare THEN 'ok' ELSE 'vague' END AS kind FROM i LEFT JOIN r USING (query_id)",
        "filename_terms": f"WITH {FILEQ.format('file_id', 'stem', 'files')}, {filename_terms('fq')} SELECT query_id, place, term, weight FROM ft",
        "filename_score": f"WITH {NAMED}, {FILEQ.format('query_id', 'q', 'named')}, {filename_terms('fq')} SELECT query_id, file_id, round(sum(s), 6) AS score FROM (SELECT query_id, file_id, CASE WHEN length(term) <= 2 THEN CASE WHEN list_contains(string_split_regex(lower(coalesce(stem, '')), '[^a-z0-9]+'), term) THEN 6 * weight END WHEN contains(lower(coalesce(stem, '')), term) THEN 4 * weight END AS s FROM ft JOIN files ON true) WHERE s IS NOT NULL GROUP BY ALL",
        "facets_from_stem": f"SELECT file_id, {first_match('s', tuple((p, T.alone(p)) for p in T.POSITIONS))} AS position, {first_match('s', T.ARGTYPES)} AS argtype, {first_match('s', T.FORMATS, lit('Policy'))} AS format, {season('s')} AS year FROM (SELECT file_id, coalesce(stem, '') AS s FROM files)",
        "facets_from_stem_first": f"SELECT file_id, {first_match('s', tuple((p, chr(92) + 'b' + p + chr(92) + 'b') for p in T.POSITIONS))} AS position, {first_match('s', T.ARGTYPES_FIRST)} AS argtype, {first_match('s', T.FORMATS_FIRST, lit('Policy'))} AS format, {year_first('s')} AS year FROM (SELECT file_id, coalesce(stem, '') AS s FROM files)",
        "attribution": f"SELECT file_id, nullif({squeezed(f"regexp_extract(coalesce(stem, ''), {lit(T.ATTRIBUTION)}, 1)")}, '') AS attribution FROM files",
        "path_facets": f"WITH {path_facets('files', 'file_id', 'orig_folder')} SELECT * FROM pf",
        "facets_combined": f"""WITH kn AS (SELECT stem, max(orig_folder) AS folder FROM files WHERE orig_folder IS NOT NULL GROUP BY stem), src AS (SELECT file_id, stem, folder FROM files LEFT JOIN kn USING (stem)), {path_facets('src', 'file_id', 'folder')},
m AS (SELECT file_id, folder, {first_match('s', tuple((p, T.alone(p)) for p in T.POSITIONS))} AS p, {first_match('s', T.ARGTYPES)} AS a, {first_match('s', T.FORMATS)} AS f, {season('s')} AS y FROM (SELECT file_id, folder, coalesce(stem, '') AS s FROM src))
SELECT file_id, coalesce(p, position) AS position, coalesce(a, argtype) AS argtype, coalesce(f, division, 'Policy') AS format, coalesce(y, year) AS year, topic, division, folder AS orig_folder, collection FROM m JOIN pf USING (file_id)""",
        "facet_vocab": vocabulary(),
        "facet_coverage": " UNION ALL ".join(f"SELECT '{f}' AS facet, count(nullif({f}, ''))::BIGINT AS n, coalesce(round(count(nullif({f}, '')) / nullif(count(*), 0) * 100, 4), 0.0) AS percent FROM files" for f in ("division", "collection", "argtype", "position", "year", "topic")),
        "topn_argtype": top("argtype", 12, "coalesce(argtype, '(unlabelled)')"),
        "topn_collection": top("collection", 10, "collection"),
        "topn_topic": top("topic", 10, "topic"),
        "cite_parse": f"SELECT card_id, nullif(trim(regexp_extract(cite, {lit(re2(T.AUTHOR))}, 1), ' .,-'), '') AS author, CASE WHEN length({cite_year}) = 2 THEN CASE WHEN {cite_year}::INT > 30 THEN '19' ELSE '20' END || {cite_year} ELSE nullif({cite_year}, '') END AS year FROM cards",
        "manifest_folders": f"WITH {MOVES}, m AS (SELECT path, CASE WHEN new_name = '' THEN '(removed)' ELSE new_name END AS n, CASE WHEN contains(path, '/') THEN regexp_replace(trim(path), '/[^/]*$', '') ELSE '' END AS folder FROM moves) SELECT regexp_replace(trim(n), '(.)\\.[^.]*$', '\\1') AS stem, arg_max(folder, path) AS folder FROM m WHERE folder NOT IN ('', '.') GROUP BY 1",
        "docx_lookup": "SELECT file_id, name FROM files LEFT JOIN (SELECT regexp_extract(n, '(?i)^(.*)\\.(docx|doc|docm)$', 1) AS stem, max(n) AS name FROM (SELECT regexp_extract(path, '[^/]*$') AS n FROM scan) GROUP BY 1) USING (stem)",
        "word_marks": f"WITH {RUNS} SELECT doc, count(*)::BIGINT AS words, (count(*) FILTER (list_contains(marks, 'highlight')) + count(*) FILTER (list_contains(marks, 'shading')))::BIGINT AS highlighted, count(*) FILTER (list_contains(marks, 'underline_mark'))::BIGINT AS underlined, 0::BIGINT AS tagline_emph, count(*) FILTER (list_contains(marks, 'shading'))::BIGINT AS shaded FROM wordrows GROUP BY doc",
        "word_colours": f"WITH {RUNS} SELECT color, count(*)::BIGINT AS n FROM (SELECT unnest(colors) AS color FROM wordrows) GROUP BY color ORDER BY n DESC, color LIMIT 6",
        "file_card_counts": "SELECT f.file_id, count(card_id)::BIGINT AS card_nodes, count(*) FILTER (is_analytic <> 0)::BIGINT AS analytics_n, count(*) FILTER (c.is_evidence <> 0)::BIGINT AS evidence, (count(card_id) - count(*) FILTER (c.is_evidence <> 0) - count(*) FILTER (is_analytic <> 0))::BIGINT AS analytics FROM files f LEFT JOIN cards c ON c.file_id = f.file_id GROUP BY f.file_id",
        "corpus_totals": "SELECT *, round(highlighted / greatest(words, 1), 6) AS highlighted_share, round(underlined / greatest(words, 1), 6) AS underlined_share FROM (SELECT count(*)::BIGINT AS files, coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(highlighted), 0)::BIGINT AS highlighted, coalesce(sum(underlined), 0)::BIGINT AS underlined, coalesce(sum(card_nodes), 0)::BIGINT AS card_nodes, coalesce(sum(evidence), 0)::BIGINT AS evidence FROM files)",
        "section_path": f"""WITH {HEADS}, g AS (SELECT *, sum(CASE WHEN type = 'hat' AND l IS NOT NULL THEN 1 ELSE 0 END) OVER w AS gh, sum(CASE WHEN type IN ('hat', 'pocket') AND l IS NOT NULL THEN 1 ELSE 0 END) OVER w AS gp FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, section FROM (SELECT doc_id, pos, type, nullif(concat_ws(' > ', last_value(CASE WHEN type = 'hat' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), last_value(CASE WHEN type = 'pocket' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id, gh ORDER BY pos), last_value(CASE WHEN type = 'block' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id, gp ORDER BY pos)), '') AS section FROM g) WHERE type = 'card'""",
        "outline_heads": f"WITH {HEADS} SELECT doc_id, string_agg(type || ':' || l, ' | ' ORDER BY pos) AS outline FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM labelled WHERE l IS NOT NULL) WHERE k <= 60 GROUP BY doc_id",
        "recover_triples": f"""WITH {KINDS}, k AS (SELECT doc_id, pos, kind, {', '.join(f"lead(coalesce(substr(kind, 1, 1), '-'), {i}, '$') OVER w AS k{i}, lead(pos, {i}) OVER w AS p{i}" for i in range(1, 6))} FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, k1 || k2 || k3 || k4 || k5 AS line, length(regexp_extract(k1 || k2 || k3 || k4 || k5, '^([^tc$]{{0,1}}c)', 1)) AS c FROM k WHERE kind = 'tag'),
b AS (SELECT *, length(regexp_extract(substr(line, c + 1, 3), '^([^tcb$]{{0,2}}b)', 1)) AS b FROM c WHERE c > 0)
SELECT doc_id, pos AS tag_pos, [p1, p2, p3, p4, p5][c] AS cite_pos, [p1, p2, p3, p4, p5][c + b] AS body_pos FROM b WHERE b > 0""",
        "paragraph_kinds": f"WITH {KINDS} SELECT kind, count(*)::BIGINT AS n FROM kinds WHERE kind IS NOT NULL GROUP BY kind",
        "tree_cards": f"SELECT file_id, count(*)::BIGINT AS cards, count(*) FILTER (is_analytic = 0 AND cite <> '')::BIGINT AS evidence, sum(CASE WHEN is_analytic = 0 THEN {n_words("coalesce(tag, '')")} + {n_words("coalesce(cite, '')")} ELSE 0 END + {n_words("coalesce(body, '')")})::BIGINT AS words FROM cards WHERE is_analytic = 0 OR {n_words("coalesce(body, '')")} > 0 GROUP BY file_id",
        "exact_dups": f"WITH {SCAN} SELECT path FROM ranked WHERE k > 1",
        "version_groups": f"WITH {SCAN} SELECT path, CASE WHEN version = 1 THEN 'keep' ELSE 'review' END AS disposition, version FROM alive",
        "dedupe_moves": f"WITH {MOVES} SELECT * FROM moves",
        "dedupe_summary": f"WITH {SCAN} SELECT (SELECT count(*) FROM scan)::BIGINT AS scanned, (SELECT count(*) FROM ranked WHERE k > 1)::BIGINT AS exact_removed, count(*)::BIGINT AS survivors, count(*) FILTER (version = 2)::BIGINT AS version_groups, count(*) FILTER (version > 1)::BIGINT AS to_review, count(*) FILTER (version = 1)::BIGINT AS final FROM alive",
        "dedupe_conflicts": f"WITH {SCAN} SELECT name, version, '  ' || CASE WHEN version = 1 THEN 'KEEP  ' ELSE 'review' END || ' hl=' || lpad(format('{{:,}}', hl), 6, ' ') || ' textruns=' || lpad(format('{{:,}}', words), 7, ' ') || '  ' || path AS line FROM alive WHERE name IN (SELECT name FROM alive WHERE version = 2)",
        "envelope_latest": "SELECT file_id, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS loaded_at, cmir_path, lower(format) AS format, exports FROM (SELECT *, count(*) OVER (PARTITION BY file_id)::BIGINT AS exports, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC, cmir_path DESC, lower(format) DESC) AS k FROM envelopes) WHERE k = 1",
        "cosine_topk": f"WITH {VEC} SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON true WHERE a.vec_id % {EVERY} = 0) QUALIFY rank <= 10",
        "quantize_vectors": f"WITH {VEC}, s AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS scale FROM vec) SELECT vec_id, list_sum(list_transform(list_transform(v, lambda x: round_even(x / scale * 127, 0)), lambda x, i: x * i))::BIGINT AS checksum, round(scale, 6) AS scale FROM vec, s",
        "vector_roundtrip": f"WITH {VEC}, s AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS scale FROM vec) SELECT vec_id, round(list_sum(list_transform(v, lambda x: pow(round_even(x / scale * 127, 0) * scale / 127, 2))), 6) AS norm2 FROM vec, s",
        "vector_realign": "SELECT card_id, embedding IS NOT NULL AS matched, round(coalesce(embedding[1]::DOUBLE, 0.0), 6) AS first FROM cards LEFT JOIN embeddings ON vec_id = card_id",
        "query_embedding": "WITH u AS (SELECT event_type AS query_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM events JOIN embeddings ON vec_id = user_id), m AS (SELECT query_id, d, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL) SELECT query_id, round(max(x / n) FILTER (d = 1), 6) AS first, round(sum(x / n * d), 4) AS checksum FROM m JOIN n USING (query_id) WHERE n > 0 GROUP BY query_id",
        "vector_text": f"WITH {TEXTS} SELECT * FROM texts",
        "tfidf_weights": f"""WITH {TEXTS}, tf AS (SELECT card_id, term, count(*) AS tf FROM (SELECT card_id, unnest(regexp_extract_all(text, {lit(T.QUERY_TOKEN)})) AS term FROM texts) GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 4 AND count(*) <= 0.4 * (SELECT count(*) FROM texts) ORDER BY total DESC, term LIMIT 40000),
raw AS (SELECT card_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT card_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY card_id)), 6) AS weight FROM raw""",
        "event_json": "SELECT event_type, count(*)::BIGINT AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type",
        "payload_cards": f"WITH {INDEX} SELECT card_idx, coalesce(tag, '') AS tag, substr(coalesce(body, ''), 1, 320) AS preview FROM cards JOIN idx USING (card_id)",
    }
    return s
