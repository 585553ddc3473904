"""One consistent form for text, on whole Arrow columns.

A column is copied to one numpy array of code points with row offsets. Mapping, expansion of joined forms, composition
of accents and the look-alike rule are gathers and segmented sums over that array; no string call is made per row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

# Format characters that show nothing (ranges, both ends included).
WIDTHLESS = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0001, 0xE01EF))
# Ranges whose compatibility form is the plain form (full-width forms, joined letters).
COMPATIBLE = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFF01, 0xFF5E), (0xFFE0, 0xFFE6))
# Letters of Cyrillic, Greek and Armenian that look like a Latin letter.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "Ս": "U",
}
TOP = sys.maxunicode + 1
PLAIN, BLANK, GONE, MAPPED, WIDE, MARK, ALIKE, JOIN = range(8)


class Tables:
    """Look-up tables over all code points; built once for a Python process."""

    def __init__(self) -> None:
        self.kind = np.zeros(TOP, np.uint8)
        self.to = np.arange(TOP, dtype=np.uint32)
        self.lower = np.arange(TOP, dtype=np.uint32)
        self.letter = np.zeros(TOP, bool)
        self.digit = np.zeros(TOP, bool)
        self.latin = np.zeros(TOP, bool)
        self.rank = np.zeros(TOP, np.uint8)  # canonical combining class
        self.alike = np.arange(TOP, dtype=np.uint32)
        self.wide: dict[int, np.ndarray] = {}
        pairs: dict[tuple[int, int], int] = {}
        compose: dict[str, str] = {}
        for c in range(TOP):
            if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x4E00 <= c <= 0x9FFF or 0x17000 <= c <= 0x1BFFF or 0x20000 <= c <= 0x2F7FF or 0x2FA20 <= c <= 0x3FFFF:
                self.letter[c] = not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] == "L"
                continue
            s = chr(c)
            kind = unicodedata.category(s)
            if kind == "Cn":
                continue
            self.letter[c] = kind[0] == "L"
            self.digit[c] = kind[0] == "N"
            if len(low := s.lower()) >= 1:
                self.lower[c] = ord(low[0])
            if kind[0] == "M" and (r := unicodedata.combining(s)):
                self.kind[c], self.rank[c] = MARK, r
            elif kind == "Zs" and c != 0x20 or c == 9:
                self.kind[c], self.to[c] = BLANK, 0x20
            if kind[0] == "L" and "LATIN" in unicodedata.name(s, ""):
                self.latin[c] = True
            parts = unicodedata.decomposition(s).split()
            form = unicodedata.normalize("NFC", s)
            if form != s:  # only ever stands for others
                if len(form) == 1:
                    self.to[c] = ord(form)
                    self.kind[c] = self.kind[c] or MAPPED
                else:
                    self.kind[c], self.wide[c] = WIDE, np.array([ord(x) for x in form], np.uint32)
            elif len(parts) == 2 and parts[0][0] != "<":
                a, b = (int(x, 16) for x in parts)
                pairs[a, b] = c
                compose[chr(a) + chr(b)] = s
                if not unicodedata.combining(chr(b)):
                    self.kind[b] = JOIN
        for first, last in WIDTHLESS:
            self.kind[first : last + 1] = GONE
        for first, last in COMPATIBLE:
            for c in range(first, last + 1):
                if (form := unicodedata.normalize("NFKC", chr(c))) == chr(c):
                    continue
                if len(form) == 1:
                    self.kind[c], self.to[c] = MAPPED, ord(form)
                else:
                    self.kind[c], self.wide[c] = WIDE, np.array([ord(x) for x in form], np.uint32)
        look = dict(LOOKALIKE)
        for (a, b), c in pairs.items():  # an accented look-alike becomes the accented Latin letter
            if chr(a) in look and (x := compose.get(look[chr(a)] + chr(b))):
                look[chr(c)] = x
        self.apart = {c: np.array([ord(x) for x in unicodedata.normalize("NFD", chr(c))], np.uint32) for c in pairs.values()}
        # Hangul: 19 initials, 21 vowels, 27 finals; a syllable without a final begins each 28
        for syllable in range(0xAC00, 0xD7A4):
            initial, rest = divmod(syllable - 0xAC00, 21 * 28)
            vowel, final = divmod(rest, 28)
            pairs[(syllable - final, 0x11A7 + final) if final else (0x1100 + initial, 0x1161 + vowel)] = syllable
        self.kind[0x1161:0x1176], self.kind[0x11A8:0x11C3] = JOIN, JOIN
        for a, b in look.items():
            self.kind[ord(a)], self.alike[ord(a)] = ALIKE, ord(b)
        self.inword = self.letter | self.digit
        self.special = self.kind != PLAIN
        keys = np.array([a << 21 | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.pair, self.composed = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.accented = np.zeros(TOP, bool)
        self.accented[list(self.apart)] = True


@cache
def tables() -> Tables:
    return Tables()


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and where each row starts (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), at
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]


def encode(cp: np.ndarray, at: np.ndarray) -> pa.Array:
    """The reverse of decode."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])


def rows_of(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def pick(cp: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some rows only."""
    size = np.diff(at)[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    return cp[np.repeat(at[rows] - to[:-1], size) + np.arange(to[-1])], to


def _keep(cp: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cp[mask], np.concatenate([[0], np.cumsum(mask)])[at]


def _expand(cp: np.ndarray, at: np.ndarray, where: np.ndarray, forms: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The characters at these places as the several that they stand for."""
    if not len(where):
        return cp, at
    parts = [forms[c] for c in cp[where].tolist()]
    size = np.ones(len(cp), np.int64)
    size[where] = [len(x) for x in parts]
    to = np.concatenate([[0], np.cumsum(size)])
    own = size[where]
    out = np.repeat(cp, size)
    out[np.repeat(to[where] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())] = np.concatenate(parts)
    return out, to[at]


def _compose(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical composition: marks go into their letters, then letters that join the one before (vowel signs, the parts
    of a syllable), again until nothing joins."""
    cp, at = _marks(cp, at)
    while (joined := _join(cp, at)) is not None:
        cp, at = _marks(*joined)
    return cp, at


def _join(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Letters that make one with the letter right before; of two such in a row the first. None if there are none."""
    t = tables()
    second = t.kind[cp] == JOIN
    second[at[:-1][at[:-1] < len(cp)]] = False
    where = np.nonzero(second)[0]
    if not len(where):
        return None
    key = cp[where - 1].astype(np.uint64) << np.uint64(21) | cp[where].astype(np.uint64)
    found = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
    hit = t.pair[found] == key
    where, found = where[hit], found[hit]
    first = np.append(True, np.diff(where) > 1)[: len(where)]
    where, found = where[first], found[first]
    if not len(where):
        return None
    cp, keep = cp.copy(), np.ones(len(cp), bool)
    cp[where - 1] = t.composed[found]
    keep[where] = False
    return _keep(cp, at, keep)


def _marks(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and the marks that follow them, as one letter where there is one: marks in canonical order, each tried in
    turn with the letter so far unless a mark of its class that found no partner stands between."""
    t = tables()
    mark = t.kind[cp] == MARK
    if not mark.any():
        return cp, at
    before = np.append(mark[1:], False)
    before[at[1:][at[1:] > 0] - 1] = False
    accented = np.nonzero(before & t.accented[cp])[0]  # a letter that has an accent and gets another
    if len(accented):
        cp, at = _expand(cp, at, accented, t.apart)
        mark = t.kind[cp] == MARK
    start = ~mark
    start[at[:-1][at[:-1] < len(cp)]] = True  # a mark that begins a row belongs to no letter before
    run = np.cumsum(start) - 1
    if (mark[1:] & mark[:-1]).any():
        cp = cp[np.lexsort((np.where(mark, t.rank[cp], 0), run))]
    begin = np.nonzero(start)[0]
    size = np.diff(np.append(begin, len(cp)))
    base = np.nonzero((size > 1) & ~mark[begin])[0]
    cp, keep = cp.copy(), np.ones(len(cp), bool)
    skipped = np.zeros(len(base), np.int64)
    k = 1
    while len(base):
        left, right = begin[base], begin[base] + k
        key = cp[left].astype(np.uint64) << np.uint64(21) | cp[right].astype(np.uint64)
        found = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        rank = t.rank[cp[right]].astype(np.int64)
        hit = (t.pair[found] == key) & (skipped < rank)
        cp[left[hit]] = t.composed[found[hit]]
        keep[right[hit]] = False
        skipped = np.where(hit, skipped, rank)
        k += 1
        more = size[base] > k
        base, skipped = base[more], skipped[more]
    return _keep(cp, at, keep)


def _alike(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Look-alikes to Latin in the words that have Latin letters; a mark belongs to its word here."""
    t = tables()
    alike = t.kind[cp] == ALIKE
    if not alike.any():
        return cp
    inside = t.inword[cp] | (t.kind[cp] == MARK)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(cp)]
    first[begins] = inside[begins]
    word = np.cumsum(first)
    has = np.zeros(int(word[-1]) + 1, bool)
    has[word[inside & t.latin[cp]]] = True
    return np.where(alike & inside & has[word], t.alike[cp], cp)


def consistent(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consistent form, and which rows it changed."""
    t = tables()
    changed = np.zeros(len(at) - 1, bool)
    special = np.nonzero(t.special[cp])[0]
    if not len(special):
        return cp, at, changed
    some = np.unique(np.searchsorted(at, special, "right") - 1)
    part, pat = pick(cp, at, some)
    was, wat = part, pat
    kind = t.kind[part]
    part, kind, pat = part[k := kind != GONE], kind[k], np.concatenate([[0], np.cumsum(k)])[pat]
    part, pat = _expand(part, pat, np.nonzero(kind == WIDE)[0], t.wide)
    part, pat = _compose(t.to[part], pat)
    part, pat = _compose(_alike(part, pat), pat)
    same = np.diff(pat) == np.diff(wat)
    if same.any():
        a, _ = pick(was, wat, np.nonzero(same)[0])
        b, bat = pick(part, pat, np.nonzero(same)[0])
        differs = np.concatenate([[0], np.cumsum(a != b)])
        same[np.nonzero(same)[0]] = differs[bat[1:]] == differs[bat[:-1]]
    changed[some[~same]] = True
    if not changed.any():
        return cp, at, changed
    size = np.diff(at).copy()
    size[some] = np.diff(pat)
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(to[-1], np.uint32)
    rest = np.ones(len(size), bool)
    rest[some] = False
    other = np.nonzero(rest)[0]
    for src, sat, rows, index in ((cp, at, other, other), (part, pat, np.arange(len(some)), some)):
        n = np.diff(sat)[rows]
        start = np.concatenate([[0], np.cumsum(n)])
        step = np.arange(start[-1])
        out[np.repeat(to[index] - start[:-1], n) + step] = src[np.repeat(sat[rows] - start[:-1], n) + step]
    return out, to, changed
