"""Suffix arrays of words and common prefixes of their neighbours, for many rows at once."""

from __future__ import annotations

import numpy as np

from . import words


class Suffixes:
    """The suffixes of rows of words in the order of their words (told apart by hash), to the depth asked for or whole.

    Ranks come from prefix doubling; a suffix that is alone with its prefix keeps its rank and drops out of further doubling.
    Ranks of every doubling are kept: common prefixes are read off them from the longest step down. With apart, the
    row comes first in the order, so suffixes of different rows share no prefix.
    """

    def __init__(self, row: np.ndarray, at: np.ndarray, word: np.ndarray, *, apart: bool, depth: int | None = None) -> None:
        n = len(row)
        self.row, self.end = row, at[1:][row]
        first = (row.astype(np.uint64) * words.ODD) ^ words.mix(word) if apart else word
        order = np.argsort(first)
        new = np.append(True, first[order][1:] != first[order][:-1])
        begin = np.nonzero(new)[0]
        rank = np.zeros(n + 1, np.int64)
        rank[order] = begin[np.cumsum(new) - 1]
        rank[n] = -1
        size = np.diff(np.append(begin, n))
        active = order[np.repeat(size > 1, size)]
        self.levels = [(1, rank)]
        span = 1
        while len(active) and (depth is None or span < depth):
            second = np.where(active + span < self.end[active], rank[np.minimum(active + span, n)], -1)
            order = np.lexsort((second, rank[active]))
            active, second = active[order], second[order]
            group = rank[active]
            outer = np.append(True, group[1:] != group[:-1])
            inner = outer | np.append(True, second[1:] != second[:-1])
            index = np.arange(len(active))
            rank = rank.copy()
            rank[active] = group + index[inner][np.cumsum(inner) - 1] - index[outer][np.cumsum(outer) - 1]
            size = np.diff(np.append(index[inner], len(active)))
            active = active[np.repeat(size > 1, size)]
            span *= 2
            self.levels.append((span, rank))
        self.order = np.argsort(rank[:n], kind="stable")  # equal to the depth: in order of rows

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y have in common at their start, up to the depth."""
        size = np.zeros(len(x), np.int64)
        for step, rank in reversed(self.levels):
            for _ in range(2):
                i, j = x + size, y + size
                ok = (i < self.end[x]) & (j < self.end[y])
                ok[ok] = rank[i[ok]] == rank[j[ok]]
                if not ok.any():
                    break
                size += ok * step
        return size

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of the longest stretch from there that occurs again, where it has at least `least` words."""
        rank = max((s, k) for k, (s, _) in enumerate(self.levels) if s <= least)[1]
        lead = self.levels[rank][1][self.order]
        near = np.nonzero(lead[1:] == lead[:-1])[0]
        x, y = self.order[near], self.order[near + 1]
        size = self.common(x, y)
        best = np.zeros(len(self.row), np.int64)
        np.maximum.at(best, x, size)
        np.maximum.at(best, y, size)
        keep = np.nonzero(best >= least)[0]
        return keep, best[keep]

    def intervals(self, length: int, prefix: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of `length` words: a place of it, its occurrences and its rows. Neighbours whose common prefix is at
        least so long are one interval; an occurrence whose row has another before it in the interval adds no row.

        prefix: common prefixes of neighbours; before: for each place in the order the last before it of the same row, or -1.
        """
        new = np.append(True, prefix < length)
        interval = np.cumsum(new) - 1
        begin = np.nonzero(new)[0]
        size = np.diff(np.append(begin, len(new)))
        again = (before >= 0) & (interval[before] == interval)
        rows = size - np.add.reduceat(again.astype(np.int64), begin)
        place = self.order[begin]
        whole = place + length <= self.end[place]  # else a row ends before the run does
        return place[whole], size[whole], rows[whole]

    def before(self) -> np.ndarray:
        row = self.row[self.order]
        by = np.argsort(row, kind="stable")
        out = np.full(len(row), -1, np.int64)
        same = row[by][1:] == row[by][:-1]
        out[by[1:][same]] = by[:-1][same]
        return out
