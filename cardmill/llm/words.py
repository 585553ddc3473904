"""Words, terms and their hashes, for whole Arrow columns at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import glyphs

CHARS = 1 << 20  # characters handled at once; a longer text is handled alone
U = np.uint64
ODD, CHAIN = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(glyphs.TOP, dtype=U) * ODD + U(1))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    key = (int(base), inverse)
    if len(_powers.get(key, ())) < max(n, 1):
        b = U(pow(int(base), -1, 1 << 64)) if inverse else base
        p = np.full(max(n, 1 << 16), b, U)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def chained(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of x[start:end] for each range, equal for equal ranges wherever they stand."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(x * powers(base, len(x)))])
    return mix((sums[ends] - sums[starts]) * powers(base, len(x) + 1, True)[starts] + (ends - starts).astype(U))


def slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHARS characters."""
    total = np.zeros(batch.num_rows + 1, np.int64)
    for c in columns:
        total[1:] += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64)
    total = np.cumsum(total)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + CHARS, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def joined(batch: pa.RecordBatch, *columns: str) -> pa.Array:
    """The columns' texts with a space between; null counts as empty."""
    if len(columns) == 1:
        return pc.fill_null(batch.column(columns[0]), "")
    return pc.binary_join_element_wise(*(batch.column(c) for c in columns), " ", null_handling="replace", null_replacement="")


class Words:
    """Words of each row: cp are the code points, start and end their range in it, at the first word of each row, hash
    a 64-bit hash of each word's characters, row the row of each word."""

    def __init__(self, column: pa.Array, *, form: bool = True, letters: bool = False, blanks: bool = False) -> None:
        """form: use the lower-cased consistent form. letters: runs of letters only. blanks: what plain spaces separate."""
        t = glyphs.tables()
        cp, at = glyphs.decode(column)
        if form:
            cp, at, _ = glyphs.consistent(cp, at)
            cp = t.lower[cp]
        inside = cp != 0x20 if blanks else t.letter[cp] if letters else t.inword[cp]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = at[:-1][at[:-1] < len(cp)]
        first[begins] = inside[begins]
        ends = at[1:][at[1:] > 0] - 1
        last[ends] = inside[ends]
        self.cp, self.rows = cp, len(at) - 1
        self.start, self.end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        self.at = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.at))
        self.hash = chained(_letters()[cp], self.start, self.end, ODD)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words within a row."""
        first = np.nonzero(np.arange(len(self.row)) + n <= self.at[1:][self.row])[0]
        return first, chained(self.hash, first, first + n, CHAIN)

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words themselves."""
        size = self.end[which] - self.start[which]
        to = np.concatenate([[0], np.cumsum(size)])
        return glyphs.encode(self.cp[np.repeat(self.start[which] - to[:-1], size) + np.arange(to[-1])], to)


def over(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], *columns: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f on parts of each batch that are bounded in characters of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, *columns):
                if (out := f(part)) is not None and out.num_rows:
                    yield out

    return run


def record(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
