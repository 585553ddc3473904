"""Problem 2: long exact spans shared between records, by suffix automata of routed shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

ANCHOR = 8  # words of an anchor
HOT = 256  # different stretches of one anchor above which each window is routed by its own words
SHARD = 30_000  # words of one automaton


def anchors(w: words.Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the anchors: of the runs of ANCHOR words in each window of `span` words the one with the
    least hash, the first of equal ones. Equal windows have equal anchors, so none is missed."""
    first, h = w.grams(ANCHOR)
    inner = span - ANCHOR + 1
    if not len(first):
        return first, h
    row = w.row[first]
    # least position in each window of `inner` runs, by doubling: ranks make it one integer comparison with ties to the left
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(np.append(0, h[order][1:] != h[order][:-1]))
    value = rank * (len(h) + 1) + np.arange(len(h))
    size, low = 1, value
    while size * 2 <= inner:
        low = np.minimum(low[: len(low) - size], low[size:]) if len(low) > size else low[:0]
        size *= 2
    rest = inner - size
    if len(value) < inner:
        return first[:0], h[:0]
    low = np.minimum(low[: len(value) - inner + 1], low[rest : rest + len(value) - inner + 1])
    whole = row[: len(low)] == row[inner - 1 :]
    chosen = np.unique(low[whole] % (len(h) + 1))
    return first[chosen], h[chosen]


class Automaton:
    """Suffix automaton of several word sequences, with the least and the greatest owner of each state."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.low: list[int] = [1 << 62]
        self.high: list[int] = [-1]

    def _state(self, length: int, nxt: dict[str, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.low.append(1 << 62)
        self.high.append(-1)
        return len(self.len) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, text: list[str], low: int, high: int) -> None:
        last = 0
        for word in text:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.len[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
                last = new
            self.low[last], self.high[last] = min(self.low[last], low), max(self.high[last], high)

    def finish(self, span: int) -> None:
        """Owners of suffixes too; then `several`: whether the last `span` words of a state belong to several owners."""
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in reversed(by_length):
            p = self.link[v]
            self.low[p], self.high[p] = min(self.low[p], self.low[v]), max(self.high[p], self.high[v])
        top = list(range(len(self.len)))
        self.several = [False] * len(self.len)
        for v in by_length:
            if self.len[v] >= span:
                p = self.link[v]
                top[v] = top[p] if self.len[p] >= span else v
                self.several[v] = self.low[top[v]] != self.high[top[v]]

    def stream(self, text: list[str], span: int) -> list[tuple[int, int]]:
        """Maximal spans of text that are covered by stretches of `span` words of several owners: where the matching
        statistics reach that length."""
        state = length = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(text):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= span and self.several[state]:
                begin = i + 1 - span
                if out and begin <= out[-1][1]:
                    out[-1] = out[-1][0], i + 1
                else:
                    out.append((begin, i + 1))
        return out


def shared_spans(df: DataFrame, key: str, text: str, *, span: int = 25) -> DataFrame:
    """(key, start_word, n_words): maximal runs of words of a row's text, split at plain spaces and compared as stored, of
    which each lies in some `span` consecutive words that also stand in another row's text.

    Anchors (see `anchors`) find which stretches may be shared: an anchor of one row only rules out all windows around it. The
    stretch around an anchor of several rows is routed to the shard of that anchor, where all its occurrences meet; equal
    stretches are one there, kept with their least and greatest id. A suffix automaton of each shard gives the matching
    statistics of each stretch. Stretches of an anchor that has more than HOT different ones are routed by their windows' own
    words, so no shard grows with a text that is copied or quoted everywhere. Null and empty texts and those of fewer words have no row; keys must be unique.
    """
    narrow = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("_text")).where(F.length("_text") >= 2 * span - 1)

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        w = words.Words(part.column("_text"), form=False, blanks=True)
        first, h = anchors(w, span)
        row = w.row[first]
        around = words.chained(w.hash, np.maximum(first - before, w.at[row]), np.minimum(first + after, w.at[row + 1]), words.CHAIN)
        return words.record(id=part.column("id").take(pa.array(row)), at=(first - w.at[row]).astype(np.int32), anchor=words.signed(h), around=words.signed(around))

    before, after = span - ANCHOR, span
    spots = narrow.mapInArrow(words.over(find, "_text"), "id bigint, at int, anchor bigint, around bigint")
    several = spots.groupBy("anchor", "around").agg(F.min("id").alias("low"), F.max("id").alias("high")).groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    several = several.where("low <> high").select("anchor", (F.col("n") > HOT).alias("hot"))
    wanted = spots.select("id", "at", "anchor").join(several, "anchor").groupBy("id").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("spots"))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, routes, starts, texts = [], [], [], []
            for i, body, found in zip(*(batch.column(c).to_pylist() for c in ("id", "_text", "spots")), strict=True):
                split = [x for x in body.split(" ") if x]
                done: set[int] = set()
                for spot in found:
                    begin, end = max(0, spot["at"] - before), min(len(split), spot["at"] + after)
                    if not spot["hot"]:
                        ids.append(i), routes.append(spot["anchor"]), starts.append(begin), texts.append(" ".join(split[begin:end]))
                        continue
                    for k in range(begin, end - span + 1):
                        if k not in done:
                            done.add(k)
                            ids.append(i), routes.append(None), starts.append(k), texts.append(" ".join(split[k : k + span]))
            yield words.record(id=pa.array(ids, pa.int64()), route=pa.array(routes, pa.int64()), start=pa.array(starts, pa.int32()), stretch=pa.array(texts, pa.string()))

    pieces = narrow.join(wanted, "id").select("id", "_text", "spots").mapInArrow(stretch, "id bigint, route bigint, start int, stretch string")
    pieces = pieces.withColumn("piece", F.xxhash64("stretch")).withColumn("route", F.coalesce("route", "piece"))
    distinct = pieces.groupBy("route", "stretch", "piece").agg(F.min("id").alias("low"), F.max("id").alias("high"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[list[tuple[int, int, str, int, int]]] = []
        group: list[tuple[int, int, str, int, int]] = []
        size = 0

        def solve() -> pa.RecordBatch:
            automaton, out = Automaton(), []
            alone = [g for g in shard if len(g) == 1]
            rest = [[(r, p, s.split(" "), a, b) for r, p, s, a, b in g] for g in shard if len(g) > 1]
            for g in rest:
                for _, _, s, a, b in g:
                    automaton.add(s, a, b)
            automaton.finish(span)
            for r, p, s, a, b in (x for g in alone for x in g):
                if a != b and (n := s.count(" ") + 1) >= span:
                    out.append((r, p, 0, n))
            for g in rest:
                for r, p, s, a, b in g:
                    out += [(r, p, x, y) for x, y in ([(0, len(s))] if a != b and len(s) >= span else automaton.stream(s, span))]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return words.record(route=pa.array(cols[0], pa.int64()), piece=pa.array(cols[1], pa.int64()), first=pa.array(cols[2], pa.int32()), last=pa.array(cols[3], pa.int32()))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("route", "piece", "stretch", "low", "high")), strict=True):
                if group and group[0][0] != row[0]:
                    shard.append(group)
                    group = []
                    if size > SHARD:
                        yield solve()
                        shard, size = [], 0
                group.append(row)
                size += row[2].count(" ") + 1
        if group:
            shard.append(group)
        yield solve()

    parts = distinct.select("route", "piece", "stretch", "low", "high").repartition("route").sortWithinPartitions("route")
    spans = parts.mapInArrow(match, "route bigint, piece bigint, first int, last int")
    hits = pieces.select("id", "route", "piece", "start").join(spans, ["route", "piece"])
    hits = hits.select("id", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("end")).distinct()
    runs = shared.islands(hits, "id", "start", "end")
    return runs.select(F.col("id").alias(key), F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))


def shares(df: DataFrame, key: str, text: str, *, span: int = 25) -> DataFrame:
    """(key, n_words, shared_words, share) for each row of df: how much of its text stands in other rows' texts. Null and
    empty texts have 0 words and share 0."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda x: x != ""))
    runs = shared_spans(df, key, text, span=span).groupBy(key).agg(F.sum("n_words").alias("shared_words"))
    out = df.select(key, n.cast("long").alias("n_words")).join(runs, key, "left").select(key, "n_words", F.coalesce("shared_words", F.lit(0)).cast("long").alias("shared_words"))
    return out.withColumn("share", F.when(F.col("n_words") > 0, F.col("shared_words") / F.col("n_words")).otherwise(0.0))
