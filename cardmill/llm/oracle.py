"""SQL for the queries of this folder that SQL can express, by plain counting and joins."""

from __future__ import annotations

import unicodedata

from . import glyphs, survivors


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ranges(pairs: tuple) -> str:
    return "[" + "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in pairs) + "]"


def consistent(c: str) -> str:
    """The consistent form of a column as an expression."""
    blanks = [(9, 9)] + [(x, x) for x in range(0x21, 0x3001) if unicodedata.category(chr(x)) == "Zs"]
    x = f"regexp_replace(coalesce({c}, ''), {lit(_ranges(glyphs.WIDTHLESS))}, '', 'g')"
    x = f"regexp_replace({x}, {lit(_ranges(tuple(blanks)))}, ' ', 'g')"
    single, several = {}, {}
    for a, b in glyphs.COMPATIBLE:
        for k in range(a, b + 1):
            form = unicodedata.normalize("NFKC", chr(k))
            (single if len(form) == 1 else several)[chr(k)] = form
    for a, b in several.items():
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = f"nfc_normalize(translate({x}, {lit(''.join(single))}, {lit(''.join(single.values()))}))"
    look, latin = "".join(glyphs.LOOKALIKE), "".join(glyphs.LOOKALIKE.values())
    word = f"CASE WHEN regexp_matches(t, '\\p{{Latin}}') THEN translate(t, {lit(look)}, {lit(latin)}) ELSE t END"
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: {word}), ''))"


def words(c: str, kind: str = r"[\p{L}\p{N}]+") -> str:
    return f"regexp_extract_all(lower({consistent(c)}), {lit(kind)})"


def grams(source: str, key: str, column: str, n: int, name: str) -> str:
    """name(key, i, g): runs of n words of a list column, from position 0."""
    return f"{name} AS (SELECT {key}, i, array_to_string(list_slice({column}, i + 1, i + {n}), ' ') AS g FROM (SELECT {key}, {column}, unnest(range(0, greatest(len({column}) - {n - 1}, 0))) AS i FROM {source}))"


CARD = "coalesce(tag, '') || ' ' || coalesce(cite, '') || ' ' || coalesce(body, '')"
TAGBODY = "coalesce(tag, '') || ' ' || coalesce(body, '')"


def _pairs() -> str:
    return f"""w AS (SELECT card_id, {words(CARD)} AS l FROM cards), {grams('w', 'card_id', 'l', 3, 'g0')}, g AS (SELECT DISTINCT card_id, g FROM g0), n AS (SELECT card_id, count(*) AS n FROM g GROUP BY card_id),
both_ AS (SELECT a.card_id AS a, b.card_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.card_id < b.card_id GROUP BY ALL),
pairs AS (SELECT a, b FROM both_ JOIN n na ON na.card_id = a JOIN n nb ON nb.card_id = b WHERE 2 * k >= na.n + nb.n - k)"""


def _runs() -> str:
    return f"""w AS (SELECT card_id, list_filter(string_split(coalesce(body, ''), ' '), lambda x: x <> '') AS l FROM cards), {grams('w', 'card_id', 'l', 25, 'g')},
several AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT card_id) > 1), hit AS (SELECT card_id, i FROM g WHERE g IN (SELECT g FROM several)),
mark AS (SELECT card_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY card_id ORDER BY i) + 25 OR lag(i) OVER (PARTITION BY card_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit),
isl AS (SELECT card_id, i, sum(new) OVER (PARTITION BY card_id ORDER BY i) AS k FROM mark),
runs AS (SELECT card_id, min(i)::BIGINT AS start_word, (max(i) + 25 - min(i))::BIGINT AS n_words FROM isl GROUP BY card_id, k)"""


def _terms() -> str:
    return f"occ AS (SELECT card_id, unnest({words(TAGBODY, '[' + chr(92) + 'p{L}]+')}) AS term FROM cards), tf AS (SELECT card_id, term, count(*) AS tf FROM occ GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS gf, sum(tf * ln(tf)) AS s FROM tf GROUP BY term)"


def _stems() -> str:
    x = f"' ' || trim(regexp_replace(lower({consistent('stem')}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for long, short in survivors.TYPES:
        x = f"replace({x}, {lit(f' {long} ')}, {lit(f' {short} ')})"
    x = f"regexp_replace(trim({x}), '^(copy (\\d+ )?of )+', '')"
    return f"keyed AS (SELECT file_id, highlighted, words, regexp_replace({x}, {lit('( (' + '|'.join(survivors.MARKS) + '))+$')}, '') AS k FROM files)"


def oracle_sql() -> dict[str, str]:
    changed = " UNION ALL ".join(f"SELECT card_id, '{f}' AS field FROM cards WHERE {consistent(f)} <> coalesce({f}, '')" for f in ("body", "tag", "cite"))
    forms = " UNION ALL ".join(f"SELECT card_id, '{f}' AS field, {consistent(f)} AS text, {consistent(f)} <> coalesce({f}, '') AS changed FROM cards" for f in ("body", "tag", "cite"))
    mark = "CASE WHEN df * 100 > (SELECT count(*) FROM cards) * 35 THEN 'common' WHEN df <= 2 THEN 'rare' END"
    leaked = f"d AS (SELECT doc_id, {words('text')} AS l FROM documents), b AS (SELECT item_id, {words('text')} AS l FROM benchmark), {grams('d', 'doc_id', 'l', 12, 'gd')}, {grams('b', 'item_id', 'l', 12, 'gb')}"
    repeat = f"""d AS (SELECT doc_id, {words('text')} AS l FROM documents), {grams('d', 'doc_id', 'l', 8, 'g')}, again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g JOIN again USING (doc_id, g)) GROUP BY doc_id)"""
    return {
        "p1_found": f"WITH {_pairs()} SELECT a AS card_a, b AS card_b FROM pairs",
        "p1_groups": f"""WITH RECURSIVE {_pairs()}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
cls AS (SELECT card_id, array_to_string(l, ' ') AS c FROM w)
SELECT id AS card_id, min(r) AS group_id, (SELECT count(DISTINCT y.c) FROM e JOIN cls x ON x.card_id = e.a JOIN cls y ON y.card_id = e.b WHERE e.a = reach.id AND x.c <> y.c)::BIGINT AS links, (SELECT count(*) - 1 FROM cls x JOIN cls y ON x.c = y.c WHERE x.card_id = reach.id)::BIGINT AS copies FROM reach GROUP BY id""",
        "p2_found": f"WITH {_runs()} SELECT card_id, start_word, n_words FROM runs",
        "p2_shares": f"WITH {_runs()}, s AS (SELECT card_id, sum(n_words)::BIGINT AS s FROM runs GROUP BY card_id) SELECT card_id, len(l)::BIGINT AS n_words, coalesce(s, 0)::BIGINT AS shared_words, CASE WHEN len(l) > 0 THEN round(coalesce(s, 0) / len(l), 6) ELSE 0.0 END AS share FROM w LEFT JOIN s USING (card_id)",
        "p3_found": changed,
        "p3_text": forms,
        "p4_found": f"WITH {_terms()} SELECT card_id, term FROM tf JOIN df USING (term) WHERE tf >= 4 AND df <= 5",
        "p4_scores": f"WITH {_terms()} SELECT card_id, term, tf::BIGINT AS tf, df::BIGINT AS df, round(ln(1 + tf) * (1 - (ln(gf) - s / gf) / ln((SELECT count(*) FROM cards))), 6) AS score FROM tf JOIN df USING (term)",
        "p5_found": f"WITH {_terms()} SELECT term, {mark} AS mark FROM df WHERE {mark} IS NOT NULL",
        "p5_terms": f"WITH {_terms()} SELECT term, gf::BIGINT AS occurrences, df::BIGINT AS records, {mark} AS mark FROM df",
        "p5_ngrams": f"""WITH w AS (SELECT card_id, {words(TAGBODY, '[' + chr(92) + 'p{L}]+')} AS l FROM cards), {', '.join(grams('w', 'card_id', 'l', n, f'g{n}') for n in (1, 2, 3))}
SELECT g AS term, n, count(*)::BIGINT AS occurrences, count(DISTINCT card_id)::BIGINT AS records FROM ({' UNION ALL '.join(f'SELECT card_id, g, {n}::INTEGER AS n FROM g{n}' for n in (1, 2, 3))}) GROUP BY g, n""",
        "p6_found": f"WITH {_stems()} SELECT min(file_id) AS first_id, arg_max(file_id, (coalesce(highlighted, -1), coalesce(words, -1), -file_id)) AS best_id FROM keyed WHERE k <> '' GROUP BY k HAVING count(*) > 1",
        "p8_found": f"WITH {leaked} SELECT DISTINCT doc_id, item_id FROM gd JOIN gb USING (g)",
        "p10_shares": f"""WITH {repeat}, pos AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM d), eq AS (SELECT doc_id, a.i, b.i - a.i AS gap FROM pos a JOIN pos b USING (doc_id, w) WHERE a.i < b.i),
isl AS (SELECT doc_id, gap, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS k FROM eq), runs AS (SELECT doc_id, count(*) AS n FROM isl GROUP BY doc_id, gap, k), most AS (SELECT doc_id, max(n) AS n FROM runs WHERE n >= 8 GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(inside.k, 0)::BIGINT AS repeated_words, round(coalesce(inside.k, 0) / greatest(len(l), 1), 6) AS share, coalesce(most.n, 0)::BIGINT AS longest FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN most USING (doc_id)""",
        "p10_found": f"WITH {repeat} SELECT doc_id FROM d JOIN inside USING (doc_id) WHERE k * 10 >= len(l) * 3",
    }
