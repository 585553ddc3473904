"""Column expressions for text: tokens, cleaning, citations, facets of names and paths."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Token patterns of queries and vectors, of the index, and of intent and file names.
QUERY_TOKEN = r"[a-z][a-z'\-]{1,}"
INDEX_TOKEN = r"[a-z][a-z'\-]{2,}"
INTENT_TOKEN = r"[a-z0-9][a-z0-9']*"


def text(*columns: str | Column) -> Column:
    """The columns with one space between; null is the empty text."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:])


def tokens(c: Column, pattern: str) -> Column:
    """All matches of the pattern in the lower-cased text, in order, with repeats; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def extracted(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Letters without their accents."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def clean(c: Column) -> Column:
    """Compatibility form, white space collapsed and cut at the ends; '' for null."""
    return F.trim(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), f"[{SPACE}]+", " "))


def fts_tokens(c: Column) -> Column:
    """Runs of letters and digits of the lower-cased text without accents."""
    return F.regexp_extract_all(without_marks(F.lower(F.coalesce(c, F.lit("")))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; none for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


# --- citations -----------------------------------------------------------------------------------------------------
# An author at the start of a citation, and a year in its first characters.
AUTHOR = rf"^[{SPACE}]*([A-Z][A-Za-z.\-']+(?:[{SPACE}]+(?:et[{SPACE}]+al\.?|and|&|[A-Z][A-Za-z.\-']+)){{0,3}})"
YEAR = r"\b((?:19|20)\d{2}|['’]?\d{2})\b"
YEAR_CHARS, PIVOT = 80, 30


def cite_author(c: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(c, AUTHOR, 1), F.lit(" .,-")), F.lit(""))


def cite_year(c: Column) -> Column:
    """Four digits; two digits above the pivot are of the last century."""
    y = F.ltrim(F.regexp_extract(F.substring(c, 1, YEAR_CHARS), YEAR, 1), F.lit("'’"))
    return F.when(F.char_length(y) == 2, F.concat(F.when(y.cast("int") > PIVOT, "19").otherwise("20"), y)).otherwise(F.nullif(y, F.lit("")))


# --- facets of names -----------------------------------------------------------------------------------------------
def alone(word: str) -> str:
    """The word with no ASCII letter or digit at either side."""
    return rf"(?<![A-Za-z0-9])(?:{word})(?![A-Za-z0-9])"


# Speech positions, and patterns of argument types and formats in order of precedence.
POSITIONS = ("1AC", "2AC", "1NC", "2NC", "1AR", "2AR", "1NR", "2NR")
ARGTYPES = (
    ("Disadvantage", alone("DA|Disad")), ("Counterplan", alone("CP") + r"|\bcounterplan\b"), ("Kritik", alone("K") + r"|\bkritik\b"), ("Topicality", alone("T") + r"|\btopicality\b"),
    ("Answers To", alone("AT|A2")), ("Aff", alone("AFF")), ("Neg", alone("NEG|CaseNeg|1NR")), ("Drill", r"\bdrill"), ("Impacts", r"\bimpacts?\b"), ("Teaching", r"\blesson|\blecture|\bclass\b|\bteach"),
    ("Flowing", r"\bflow(?:ing)?\b"), ("Feedback", r"\bfeedback\b|\bsurvey\b|\brubric\b"), ("Template", r"\btemplate\b|\bblank\b"), ("Round", r"\bround\b|\bflows?\b|\bvs?\.?\b"),
)
FORMATS = (("Public Forum", alone("PF") + r"|\bpublic\s*forum\b"), ("Smart Debate", alone("SD") + r"|\bsmart\s*debate\b"), ("Lincoln-Douglas", alone("LD") + r"|\blincoln"), ("Policy", alone("CX|NCX|VCX|JVCX|Policy")))
# The earlier patterns, kept for comparison.
ARGTYPES_FIRST = (
    ("Disadvantage", r"^DA[_\- ]|\bDA\b"), ("Counterplan", r"^CP[_\- ]|\bCP\b"), ("Kritik", r"^K[_\- ]|\bkritik\b"), ("Topicality", r"^T[_\- ]|\btopicality\b"), ("Answers To", r"^AT[_\- ]|^A2[_\- ]"), ("Aff", "^AFF"),
    ("Neg", "^(NEG|CaseNeg)"), ("Drill", r"^Drill|\bdrill\b"), ("Impacts", "^Impact"), ("Teaching", r"\blesson\b|\blecture\b"), ("Flowing", r"\bflow\b|\bflowing\b"),
)
FORMATS_FIRST = (("Public Forum", r"^PF[_\- ]|\bpublic forum\b"), ("Smart Debate", r"^SD[_\- ]|\bsmart debate\b"), ("Lincoln-Douglas", r"\bLD\b|\blincoln[- ]douglas\b"))
SEASON = r"(20\d{2})[-–_](\d{2})|(20\d{2})|['’](\d{2})[-–]['’](\d{2})"
SEASON_FIRST = r"\b(20\d{2})\b|\b(\d{4})-(\d{2})\b|['’](\d{2})[-–]['’](\d{2})"
ATTRIBUTION = r"\(([^)]{2,60})\)"


def first_match(c: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first pattern that is found, without case; null if none is."""
    return F.coalesce(*(F.when(F.regexp_like(c, F.lit(f"(?i){p}")), value) for value, p in patterns), F.lit(None).cast("string"))


def position(c: Column) -> Column:
    return first_match(c, tuple((p, alone(p)) for p in POSITIONS))


def season(c: Column) -> Column:
    """2025-26, 2025, or '25-'26 as 2025-26: of the first place that has one of them."""
    g = [F.regexp_extract(c, SEASON, i) for i in range(6)]
    return F.when(g[1] != "", F.concat(g[1], F.lit("-"), g[2])).when(g[3] != "", g[3]).when(g[4] != "", F.concat(F.lit("20"), g[4], F.lit("-"), g[5]))


def year_first(c: Column) -> Column:
    g = [F.regexp_extract(c, SEASON_FIRST, i) for i in range(5)]
    return F.when(g[1] != "", g[1]).when(g[2] != "", g[2]).when(g[4] != "", F.concat(F.lit("20"), g[4]))


# --- facets of paths -----------------------------------------------------------------------------------------------
# What folders mean, and folders that are no topic.
DIVISIONS = {"Policy_Debate": "Policy", "Public_Forum": "Public Forum", "Smart_Debate": "Smart Debate", "Lincoln_Douglas": "Lincoln-Douglas", "Classroom_Materials": "Policy"}
FOLDER_ARGTYPES = {
    "DAs": "Disadvantage", "Disads": "Disadvantage", "CPs": "Counterplan", "Counterplans": "Counterplan", "Kritiks": "Kritik", "K Answer Backfiles": "Kritik", "T_Blocks": "Topicality", "Topicality": "Topicality",
    "AFF_Blocks": "Aff", "Neg_Blocks": "Neg", "Drill_Docs": "Drill", "Drills": "Drill", "Impacts": "Impacts", "Cards_Backfiles": "Cards", "Round_Flows": "Round", "Speeches": "Round", "Lessons": "Teaching",
    "Lectures": "Teaching", "Scripts": "Teaching", "Gamification": "Teaching", "Novice Files": "Teaching", "Templates": "Template",
}
NO_TOPIC = ("Topics", "Misc", "Generic", "Undated", "Unknown", "Condo", "WIP", "Dump", "Lit", "CX", "PF", "Media", "Resources", "Backfiles", "Toolbox", "Tools", "user_approval", "duplicates", "scripts")


class FolderMap:
    """What folders mean: the defaults above, with a user's entries over them. Keys that begin with _ are notes; a
    user's list of folders that are no topic takes the place of the default one."""

    def __init__(self, user: dict | None = None) -> None:
        user = user or {}
        extra = {k: {a: b for a, b in (user.get(k) or {}).items() if not a.startswith("_")} for k in ("division", "position", "argtype")}
        self.division = DIVISIONS | extra["division"]
        self.position = {p: p for p in POSITIONS} | extra["position"]
        self.argtype = FOLDER_ARGTYPES | extra["argtype"]
        stop = user.get("stop_topic") or {}
        stop = stop.get("values") if isinstance(stop, dict) else stop
        self.stop = sorted({*(stop or NO_TOPIC), *self.position, *self.argtype})


def lookup(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def segments(folder: Column) -> Column:
    """Parts of a path that are not empty and do not begin with a dot."""
    return F.filter(F.split(folder, "/"), lambda p: (p != "") & ~p.startswith("."))


def deepest(parts: Column, values: dict[str, str]) -> Column:
    """What the last part that has a meaning means."""
    known = F.filter(F.transform(F.reverse(parts), lambda p: lookup(values, p)), lambda v: v.isNotNull())
    return F.try_element_at(known, F.lit(1))


def path_year(folder: Column) -> Column:
    years = F.filter(F.transform(F.reverse(segments(folder)), season), lambda y: y.isNotNull())
    return F.try_element_at(years, F.lit(1))


def path_topic(folder: Column, folders: FolderMap) -> Column:
    """The folder right under the first Topics, without its year, if it names a topic."""
    parts = segments(folder)
    at = F.array_position(parts, F.lit("Topics"))
    raw = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    base = F.trim(F.replace(F.btrim(F.regexp_replace(raw, SEASON, ""), F.lit("_- ")), F.lit("_"), F.lit(" ")))
    return F.when((F.char_length(base) >= 3) & ~base.isin(folders.stop), F.substring(base, 1, 40))


def path_collection(folder: Column) -> Column:
    parts = F.slice(segments(folder), 1, 2)
    return F.nullif(F.substring(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("_"), F.lit(" "))), " / "), 1, 48), F.lit(""))


def path_division(folder: Column, folders: FolderMap) -> Column:
    return lookup(folders.division, F.split(folder, "/")[0])


# --- display -------------------------------------------------------------------------------------------------------
def escape(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.coalesce(c, F.lit("")))


def highlight(c: Column, terms: Column) -> Column:
    """Escaped, with each term of two or more characters marked, one after the other; a later term can hit the marks of an earlier one."""

    def mark(text: Column, term: Column) -> Column:
        quoted = F.concat(F.lit("(?i)("), F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(")"))
        return F.when(F.char_length(term) >= 2, F.regexp_replace(text, quoted, F.lit("<mark>$1</mark>"))).otherwise(text)

    return F.aggregate(terms, escape(c), mark)


def open_link(docx: Column, stem: Column) -> Column:
    return F.concat(F.lit("../"), F.replace(F.url_encode(F.coalesce(F.nullif(docx, F.lit("")), F.concat(stem, F.lit(".docx")))), F.lit("+"), F.lit("%20")))
