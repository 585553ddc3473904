"""Problem 7: variant spellings of names, attached to a register by a noisy-channel model."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import glyphs, words

# Short forms of given names, by the full form.
NICKNAMES = {
    "alexander": "alex sasha xander sandy lex", "amara": "mara ami", "charles": "chuck charlie charley chas", "deborah": "debbie deb debby", "dmitri": "dima mitya dmitry",
    "elizabeth": "liz beth betty lizzie eliza betsy", "francisco": "paco frank pancho cisco", "frederick": "fred freddie freddy rick", "gabriela": "gaby gabi gabby", "haruto": "haru harry",
    "henrietta": "etta hettie hetty henny", "ignacio": "nacho iggy", "jacqueline": "jackie jacqui", "jennifer": "jen jenny jenn", "katherine": "kate kathy katie kat kathryn", "leonard": "len lenny leo lennie",
    "margaret": "peggy maggie meg marge", "michael": "mike mick mikey", "nathaniel": "nate nat nathan", "ngozi": "ngo zizi", "oliver": "ollie olly", "penelope": "penny nell", "priya": "pri", "robert": "bob rob bobby robbie bert",
    "susannah": "sue susie suzy susan", "theodore": "ted theo teddy", "thomas": "tom tommy", "ursula": "ulla ursi uschi", "valentina": "tina val vale", "victoria": "vicky tori vicki vickie", "william": "bill will billy liam",
    "yolanda": "yoli yola", "zachary": "zach zack zac", "zoe": "zo zozo", "edouard": "eddie ed ned", "edward": "ed eddie ted ned", "richard": "dick rick rich", "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "patricia": "pat patty trish", "anthony": "tony", "daniel": "dan danny", "samuel": "sam sammy", "benjamin": "ben benny", "christopher": "chris kit", "stephen": "steve", "matthew": "matt", "andrew": "andy drew", "rebecca": "becky", "barbara": "barb", "catherine": "cathy kate",
}
# Short forms of words in names of organisations.
SHORT = {
    "association": "assn assoc ass'n", "center": "ctr cntr cent centre", "commission": "comm comn commn", "council": "coun cncl cnl", "foundation": "fdn found fndn fnd", "institute": "inst instit", "society": "soc socy", "university": "univ u uni",
    "international": "intl int'l int", "constitutional": "const constl", "economic": "econ", "energy": "en energ", "transition": "trans", "development": "dev devt", "research": "res rsch", "studies": "stud stds", "policy": "pol", "security": "sec", "critical": "crit", "thought": "tht", "maritime": "mar marit", "nuclear": "nuc nucl", "public": "pub publ", "health": "hlth", "rural": "rur", "polar": "pol", "risk": "rsk",
}
CACHE_CHARS = 20_000_000  # of citations whose authors are kept in a task
KINDS = ("association", "center", "commission", "council", "foundation", "institute", "society", "university")
SMALL = {"the", "for", "on", "of", "and", "study", "in"}
TITLES = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|sir|rev)\b\.?\s+|(?:,\s*|(?<!\s)\s+)?\b(?:(?:ph\.?d|m\.?d|j\.?d|jr|sr|esq|eds?)\b\.?|et\.? al\b\.?,?)|\bothers\b", re.I)
YEAR = re.compile(r"\b(?:(?:19|20)\d\d|\d\d)\b")
# Blanks are tried from the start of their run only, so that time is linear in the length of a citation.
SPLIT = re.compile(r"(?<!\s)\s+(?:and|with)\s+|(?:(?<!\s)\s+)?[&;]\s*", re.I)
PLACE = re.compile(r"\b([A-Z][\w'-]+ (?:%s))\b(?! (?:for|on)\b)" % "|".join(k.capitalize() for k in KINDS))
# Log likelihoods of what a typist does to a name.
EXACT, FOLDED, NICK, INITIAL, BARE, TYPO, WRONG_PLACE, RIGHT_PLACE = 0.0, -0.1, -1.5, -1.0, -1.2, -4.0, -9.0, 1.0


@lru_cache(1 << 16)
def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower().replace("ø", "o").replace("ß", "ss").replace("ł", "l")


def spelt(s: str) -> set[str]:
    """Foldings of a name: accents dropped, and umlauts written out."""
    out = {fold(s)}
    wide = s.lower().replace("ö", "oe").replace("ä", "ae").replace("ü", "ue").replace("å", "aa")
    return out | {fold(wide)}


@lru_cache(1 << 16)
def near(a: str, b: str, most: int = 1) -> int | None:
    """Edits (insert, delete, replace, swap) between a and b if at most `most`, else None."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return None
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return None
        prev2, prev = prev, row
    return prev[-1] if prev[-1] <= most else None


def deletions(s: str) -> set[str]:
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


class Register:
    """The known names, indexed for near spellings. It is one row a name: its size is checked where it is read."""

    def __init__(self, rows: list[dict]) -> None:
        self.persons: dict[int, tuple[str, str, str | None]] = {}  # id: given, family, affiliation
        self.families: dict[str, list[int]] = defaultdict(list)
        self.orgs: dict[int, tuple[str, ...]] = {}
        self.acronyms: dict[str, list[int]] = defaultdict(list)
        for r in rows:
            if not r["name"]:
                continue
            if r["kind"] == "person":
                given, _, family = r["name"].strip().rpartition(" ")
                self.persons[r["id"]] = fold(given), fold(family), fold(r["affiliation"]) if r["affiliation"] else None
                for f in spelt(family):
                    self.families[f].append(r["id"])
            else:
                tokens = tuple(t for t in re.findall(r"[^\W_]+", fold(r["name"])) if t not in SMALL)
                self.orgs[r["id"]] = tokens
                self.acronyms["".join(t[0] for t in tokens)].append(r["id"])
                self.acronyms["".join(t[0] for t in re.findall(r"[^\W_]+", fold(r["name"])))].append(r["id"])
        self.deletes: dict[str, set[str]] = defaultdict(set)
        for f in self.families:
            for d in deletions(f):
                self.deletes[d].add(f)
        self.first: dict[str, set[int]] = defaultdict(set)  # organisations by deletions of a token's spellings
        for i, tokens in self.orgs.items():
            for d in deletions(tokens[0]):
                self.first[d].add(i)
        self.nick: dict[str, set[str]] = defaultdict(set)
        for full, short in NICKNAMES.items():
            for s in short.split():
                self.nick[s].add(full)
        self._family: dict[str, dict[str, int]] = {}
        # what is longer than the longest name by more than an edit, or by more than a word, is near none
        self.longest = max(map(len, self.families), default=0) + 1
        self.longest_first = max((len(t[0]) for t in self.orgs.values()), default=0) + 1
        self.most_tokens = max(map(len, self.orgs.values()), default=0) + 1

    def family(self, x: str) -> dict[str, int]:
        """Registered spellings of the family name within one edit; only itself if it is one."""
        if len(x) > self.longest:
            return {}
        if x not in self._family:
            if len(self._family) > 1 << 18:
                self._family.clear()
            found = {x} if x in self.families else {f for d in deletions(x) for f in self.deletes.get(d, ())} if len(x) > 4 else set()
            self._family[x] = {f: n for f in found if (n := near(x, f)) is not None}
        return self._family[x]

    def given(self, typed: str, full: str) -> float | None:
        """Log likelihood that a full given name is typed so; None where it can't be."""
        if not typed:
            return BARE
        if typed == full:
            return EXACT
        if len(typed) == 1:
            return INITIAL if full[:1] == typed else None
        if full in self.nick.get(typed, ()):
            return NICK
        if len(typed) > 3 and near(typed, full) is not None:
            return TYPO
        if len(typed) > 3 and any(near(typed, s) is not None for s in NICKNAMES.get(full, "").split() if len(s) > 3):
            return NICK + TYPO
        return None

    def org(self, part: str) -> dict[int, float]:
        """Organisations that a part can mean."""
        letters = re.sub(r"[.\s]", "", part)
        if 2 < len(letters) <= 8 and letters.isupper() and (" " not in part.strip() or "." in part) and (ids := self.acronyms.get(fold(letters))):
            return dict.fromkeys(ids, INITIAL)
        tokens = [t for t in re.findall(r"[^\W_]+(?:'[^\W_]+)?\.?", fold(part)) if t.rstrip(".") not in SMALL]
        if not 3 <= len(tokens) <= self.most_tokens:
            return {}
        some = {i for t in tokens if len(t.rstrip(".")) <= self.longest_first for d in deletions(t.rstrip(".")) for i in self.first.get(d, ())}
        out = {}
        for i in some:
            score, left = 0.0, list(tokens)
            for want in self.orgs[i]:
                best = max(((self.token(t, want), k) for k, t in enumerate(left)), default=(-99.0, 0))
                if best[0] < -9:
                    break
                score += best[0]
                left.pop(best[1])
            else:
                if len(left) <= 1:
                    out[i] = score + TYPO * len(left)
        return out

    @staticmethod
    @lru_cache(1 << 16)
    def token(typed: str, want: str) -> float:
        bare = typed.rstrip(".")
        if bare == want:
            return EXACT
        if bare in SHORT.get(want, "").split() or typed.endswith(".") and len(bare) > 1 and want.startswith(bare):
            return INITIAL
        n = near(bare, want, 2 if len(want) > 7 else 1)
        return -99.0 if n is None or len(want) < 4 else TYPO * n


@lru_cache(16)
def lead_place(rest: str) -> tuple[str, str | None]:
    """What stands between the year and the title, and the affiliation in it."""
    lead = re.split(r"[“\"]", rest, maxsplit=1)[0]
    found = PLACE.search(lead)
    return lead, fold(found[1]) if found else None


class Part:
    """One name of a citation: given is a full given name, a single letter, or empty."""

    __slots__ = ("family", "given", "place", "text")

    def __init__(self, text: str, rest: str) -> None:
        self.text = text
        lead, self.place = lead_place(rest)
        t = TITLES.sub(" ", text).strip(" ,.-—–'’‘")
        given, family = "", t
        if m := re.match(r"^([^(,]+)\(([^)]+)\)?", t):
            family, given = m[1].rstrip() or m[1][0], m[2]
        elif "," in t:
            family, given = (x.strip() for x in t.split(",", 1))
        elif m := re.match(r"^(\S+)\s+((?:[^\W\d_]\.?\s?-?){1,3})$", t):
            family, given = (m[1], m[2]) if m[2].replace(".", "").replace(" ", "").isupper() and len(m[2].replace(".", "").replace(" ", "")) <= 3 else (m[2], m[1])
        elif " " in t:
            given, _, family = t.rpartition(" ")
        elif m := re.match(r"^((?:[^\W\d_]\.)+)([^\W\d_]{2,})$", t):
            given, family = m[1], m[2]
        self.family = fold(family.strip(" .,"))
        name = re.findall(r"[^\W\d_]+", fold(given))
        self.given = name[0] if name else ""
        if len(self.given) > 1 and re.match(r"^[^\W\d_]{2,3}$", given.strip()) and given.strip().isupper():
            self.given = self.given[0]
        if len(self.given) <= 1 and (m := re.match(r"^\W*\(([^,()]+),", lead)):
            full = re.findall(r"[^\W\d_]+", fold(m[1]))
            if len(full) > 1 and near(full[-1], self.family) is not None and full[0][:1] == (self.given or full[0][:1]):
                self.given = full[0]


def parts(cite: str) -> list[Part]:
    if m := YEAR.search(cite):
        head, rest = cite[: m.start()], cite[m.end() :]
        for marks in ("’'‘", "(["):
            head = head[:-1] if head.endswith(tuple(marks)) else head
        k = len(head)
        while k and (head[k - 1].isspace() or head[k - 1] == ","):
            k -= 1
        head = head[:k]
    else:
        head, rest = re.split(r"[“\"(\[—]", cite, maxsplit=1)[0], ""
    return [Part(x, rest) for x in SPLIT.split(head) if x.strip(" ,.")]


class Channel:
    """Prior times likelihood. known: uses of each author in full; other: by family and first letter the most uses of another
    full name; own: uses of frequent spellings near a registered family name that are names of their own."""

    def __init__(self, register: Register, known: dict[int, int], other: dict[tuple[str, str], int], own: dict[str, int]) -> None:
        self.register, self.known, self.own = register, known, own
        self.rivals: Counter[tuple[str, str]] = Counter()
        for (family, letter), n in other.items():
            self.rivals[family, ""] = max(self.rivals[family, ""], n)
            self.rivals[family, letter] = n

    def resolve(self, part: Part) -> int | None:
        """The author of the greatest posterior; None if a name that is not in the register has a greater one."""
        r = self.register
        if orgs := r.org(part.text):
            return min(orgs, key=lambda i: (-(orgs[i] + math.log(self.known.get(i, 0) + 1)), i))
        best: tuple[float, int] | None = None
        rival = math.log(self.own[part.family] + 1) if part.family in self.own else -99.0
        for family, edits in r.family(part.family).items():
            for i in r.families[family]:
                given, _, place = r.persons[i]
                how = r.given(part.given, given)
                if how is None:
                    continue
                score = math.log(self.known.get(i, 0) + 1) + how + TYPO * edits
                if part.place:
                    score += RIGHT_PLACE if place == part.place else WRONG_PLACE
                if best is None or (-score, i) < (-best[0], best[1]):
                    best = score, i
            if len(part.given) <= 1 and (n := self.rivals.get((family, part.given), 0)):
                rival = max(rival, math.log(n + 1) + (INITIAL if part.given else BARE) + TYPO * edits)
        if best is None or rival > best[0] or part.place and best[0] < WRONG_PLACE / 2:
            return None
        return best[1]


def _evidence(register: Register, cites: list[str]) -> Iterator[tuple[str, str, str]]:
    """What full names and spellings of families say: kind, name and detail."""
    for cite in cites:
        for p in parts(cite):
            if orgs := register.org(p.text):
                yield "known", str(min(orgs, key=lambda i: (-orgs[i], i))), ""
                continue
            for family, edits in register.family(p.family).items():
                if edits:
                    yield "own", p.family, ""
                if len(p.given) > 1 and not edits:
                    hit = [i for i in register.families[family] if register.given(p.given, register.persons[i][0]) is not None]
                    yield ("known", str(hit[0]), "") if hit else ("other", family, p.given)
                yield "family", family, ""


def attribute(df: DataFrame, key: str, cite: str, authors: DataFrame, author_key: str, *, least: int = 5, most: int = 200_000) -> DataFrame:
    """(key, author, spelling): the entries of `authors` (with name, kind, affiliation) that a citation names at its start, one
    row each, and how they were typed.

    Names are cut from the text before the year, of any length. Given and family names, or the words of an organisation, may be typed
    with one edit a word, without accents, as nicknames, initials, short forms or acronyms and in any order. Of the
    candidates within that, the one of greatest prior times likelihood is taken. Priors are uses in full, counted over all
    rows of df with equal citations counted once; names outside the register are candidates by the same counts: other given
    names of a family, and spellings near a family's that are used at least `least` times and a quarter as often as it.
    A given affiliation must be the entry's own.

    Null or empty citations name nobody. The register is sent to all executors: more than `most` names raise an error.
    Counts gathered are bounded by the register: entries, first letters by family, and spellings within an edit of a family.
    """
    register_rows = authors.where(F.col(author_key).isNotNull()).select(F.col(author_key).alias("id"), "name", "kind", "affiliation").limit(most + 1).collect()
    if len(register_rows) > most:
        raise ValueError(f"the register has more than {most} names")
    spark = df.sparkSession
    rows = spark.sparkContext.broadcast([r.asDict() for r in register_rows])
    kind = df.schema[key].dataType.simpleString()
    out_kind = authors.schema[author_key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("_key"), F.col(cite).cast("string").alias("_cite")).where("_cite <> ''")

    def formed(part: pa.RecordBatch) -> list[str]:
        cp, at, _ = glyphs.consistent(*glyphs.decode(part.column("_cite")))
        return glyphs.encode(cp, at).to_pylist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        register = Register(rows.value)
        for batch in batches:
            for part in words.slices(batch, "_cite"):
                seen = Counter(_evidence(register, formed(part)))
                cols = list(zip(*seen, strict=True)) or [(), (), ()]
                yield words.record(what=pa.array(cols[0], pa.string()), name=pa.array(cols[1], pa.string()), detail=pa.array(cols[2], pa.string()), n=np.fromiter(seen.values(), np.int64, len(seen)))

    counted = narrow.select("_cite").distinct().mapInArrow(count, "what string, name string, detail string, n bigint").groupBy("what", "name", "detail").agg(F.sum("n").alias("n"))
    # of other given names only the most frequent by first letter matters, so what is gathered is bounded by the register
    counted = counted.groupBy("what", "name", F.substring("detail", 1, 1).alias("detail")).agg(F.max("n").alias("n"))
    counted = counted.where((F.col("what") != "own") & (F.col("what") != "other") | (F.col("n") >= F.when(F.col("what") == "own", least).otherwise(2)))
    known: dict[int, int] = {}
    other: dict[tuple[str, str], int] = {}
    own: dict[str, int] = {}
    family: dict[str, int] = {}
    for what, name, detail, n in counted.collect():
        if what == "known":
            known[int(name)] = n
        elif what == "other":
            other[name, detail] = n
        else:
            (own if what == "own" else family)[name] = n
    plain = Register([r.asDict() for r in register_rows])
    own = {x: n for x, n in own.items() if any(4 * n >= family.get(f, 0) for f in plain.family(x))}
    model = spark.sparkContext.broadcast((known, other, own))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(Register(rows.value), *model.value)
        cache: dict[str, list[tuple[int, str]]] = {}
        held = 0  # characters of the cache's keys
        for batch in batches:
            for part in words.slices(batch, "_cite"):
                index, ids, typed = [], [], []
                for k, text in enumerate(formed(part)):
                    if text not in cache:
                        if len(cache) > 50_000 or held > CACHE_CHARS:
                            cache.clear()
                            held = 0
                        held += len(text)
                        found: dict[int, str] = {}
                        for p in parts(text):
                            if (i := channel.resolve(p)) is not None:
                                found.setdefault(i, p.text.strip(" ,"))
                        cache[text] = list(found.items())
                    for i, spelling in cache[text]:
                        index.append(k), ids.append(i), typed.append(spelling)
                yield words.record(_key=part.column("_key").take(pa.array(index, pa.int64())), author=pa.array(ids, pa.int64()), spelling=pa.array(typed, pa.string()))

    found = narrow.mapInArrow(link, f"_key {kind}, author bigint, spelling string")
    return found.select(F.col("_key").alias(key), F.col("author").cast(out_kind).alias("author"), "spelling")
