"""Maximal periodic runs of words by an enhanced suffix array.

The suffixes of each text are ranked by prefix doubling, all texts of a few
megabytes at once. A text in which no window of words repeats that is as long
as any run needs is done then. For the others the suffix array, its inverse
(ISA) and the longest common prefixes (LCP) follow from the ranks.

A run of period q ends with exactly one square of two equal stretches of q words
that the next word breaks off. Its two halves have a longest common prefix of q,
so both begin suffixes of one LCP interval of depth q, in different children.
For every interval, the suffixes i of all children but the largest are asked
whether ISA[i + q] or ISA[i - q] lies in the interval. Intervals and children are
ranges of the arrays; there are no tree nodes. A square is rotated to the left as
far as the period holds, and squares that give the same stretch are merged into
the run of the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import with_results
from tessera.llm.words import array_slices, split_words

LEAST_LENGTH = 24
LEAST_POWER = 3
CHUNK = 2**20           # suffixes asked at once
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def doubled(rank: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Ranks of windows of twice ``width`` words; a text's end is the smallest word."""
    at = np.arange(len(rank)) + width
    held = at < end
    following = np.where(held, rank[np.minimum(at, len(rank) - 1)] + 1, 0)
    return dense(rank * np.int64(len(rank) + 1) + following)


def repetitive(code: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """The texts that hold some window of ``window`` words (or the next smaller
    power of two) twice. ``text`` ascends."""
    rank, width = dense(text * np.int64(code.max(initial=0) + 1) + code), 1
    while len(rank):
        distinct = np.flatnonzero(np.bincount(rank) > 1)
        again = np.isin(rank, distinct)
        live = np.isin(text, np.unique(text[again]))
        if 2 * width > window or not live.any():
            return np.unique(text[live])
        text, rank = text[live], dense(rank[live])
        end = np.searchsorted(text, text, side="right")
        rank, width = doubled(rank, end, width), 2 * width
    return np.zeros(0, dtype=np.int64)


class SuffixArray:
    """Of several texts side by side: suffixes of one text adjoin, and a common
    prefix ends with the text."""

    def __init__(self, code: np.ndarray, text: np.ndarray):
        self.code = code
        self.first = np.searchsorted(text, text, side="left")
        self.end = np.searchsorted(text, text, side="right")
        rank, width = dense(text * np.int64(code.max(initial=0) + 1) + code), 1
        self.levels = [rank.astype(np.int32)]
        while len(rank) and rank.max() + 1 < len(rank):
            rank, width = doubled(rank, self.end, width), 2 * width
            self.levels.append(rank.astype(np.int32))
        self.isa = rank
        self.sa = np.empty_like(rank)
        self.sa[rank] = np.arange(len(rank))
        self.lcp = np.zeros(len(rank), dtype=np.int64)
        if len(rank) > 1:
            a, b = self.sa[:-1], self.sa[1:]
            same = np.flatnonzero(self.first[a] == self.first[b])
            self.lcp[same + 1] = self.common(a[same], b[same])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes i and j, i <> j, of one text."""
        i, j = i.copy(), j.copy()
        start, end, last = i.copy(), self.end[i], len(self.code) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            equal = (i < end) & (j < end) & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)])
            i[equal] += 2**k
            j[equal] += 2**k
        return i - start

    def smaller_children(self) -> tuple[np.ndarray, ...]:
        """Ranges (low, high) of the children but the largest of every LCP
        interval, with the interval's range and depth."""
        lcp = self.lcp.tolist()
        n = len(lcp)
        left, right, open_ = [0] * n, [n] * n, []
        for k, depth in enumerate(lcp):         # the previous and the next smaller value
            while open_ and lcp[open_[-1]] > depth:
                right[open_.pop()] = k
            left[k] = 0 if not open_ else left[open_[-1]] if lcp[open_[-1]] == depth else open_[-1]
            open_.append(k)
        left, right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        longest = (self.end - self.first)[self.sa] // LEAST_POWER
        cut = np.flatnonzero((self.lcp > 0) & (self.lcp <= longest))
        cut = cut[np.lexsort((cut, right[cut], left[cut]))]
        l, r = left[cut], right[cut]
        new = np.ones(len(cut), dtype=bool)
        new[1:] = (l[1:] != l[:-1]) | (r[1:] != r[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(cut)) if len(cut) else begin
        low, high = np.insert(cut, begin, l[begin]), np.insert(cut, end, r[begin])
        owner = np.repeat(np.arange(len(begin)), end - begin + 1)
        if not len(begin):
            return (np.zeros(0, dtype=np.int64),) * 5
        heads = begin + np.arange(len(begin))
        size = high - low
        largest = np.where(size == np.maximum.reduceat(size, heads)[owner], np.arange(len(size)), len(size))
        keep = np.ones(len(size), dtype=bool)
        keep[np.minimum.reduceat(largest, heads)] = False
        depth = self.lcp[cut[begin]]
        return low[keep], high[keep], l[begin][owner[keep]], r[begin][owner[keep]], depth[owner[keep]]

    def squares(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, q): branching squares of period q at i whose period goes on to the
        left far enough for a run."""
        low, high, l, r, depth = self.smaller_children()
        total = np.cumsum(high - low)
        part = total // CHUNK
        for c in np.unique(part):
            these = np.flatnonzero(part == c)
            size = (high - low)[these]
            owner = np.repeat(these, size)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
            p, q = self.sa[at], depth[owner]
            for step in (q, -q):
                other = p + step
                inside = (other >= self.first[p]) & (other < self.end[p])
                held = np.zeros(len(p), dtype=bool)
                there = self.isa[other[inside]]
                held[inside] = (there >= l[owner[inside]]) & (there < r[owner[inside]])
                i, d = np.minimum(p, other)[held], q[held]
                stop = i + 2 * d
                branching = (stop == self.end[i]) | (self.code[np.minimum(stop, len(self.code) - 1)] != self.code[i + d])
                need = np.maximum(LEAST_LENGTH, LEAST_POWER * d)
                enough = branching & (stop - need >= self.first[i])
                i, d, need, stop = i[enough], d[enough], need[enough], stop[enough]
                long = self.common(stop - need, stop - need + d) >= need - d
                yield i[long], d[long]

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs, sorted."""
        found = sorted({(q, i + 2 * q) for i_, q_ in self.squares() for i, q in zip(i_.tolist(), q_.tolist())})
        ending: dict[int, list[tuple[int, int]]] = {}
        out = []
        for q, end in found:
            known = ending.setdefault(end, [])
            if any(q % period == 0 and end - start >= 2 * q for start, period in known):
                continue                        # a power of a shorter period
            start, floor, step = end - 2 * q, int(self.first[end - 1]), 64
            while start > floor:                # rotate to the left
                low = max(floor, start - step)
                differs = np.flatnonzero(self.code[low:start] != self.code[low + q:start + q])
                if len(differs):
                    start = low + int(differs[-1]) + 1
                    break
                start, step = low, 2 * step
            known.append((start, q))
            out.append((start, end, q))
        return sorted(out)


def runs_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and its words without the repeats, joined by blanks."""
    found = split_words(texts)
    code, _ = found.codes()
    window = LEAST_LENGTH - LEAST_LENGTH // LEAST_POWER
    some = np.isin(found.text, repetitive(code, found.text, window))
    at = np.flatnonzero(some)
    kept = np.ones(len(code), dtype=bool)
    starts, lengths, periods, owners = [], [], [], []
    if len(at):
        array = SuffixArray(dense(code[at]), found.text[at])
        for start, end, q in array.runs():
            kept[at[start + q:end]] = False
            starts.append(start - int(array.first[start]))
            lengths.append(end - start)
            periods.append(q)
            owners.append(int(found.text[at[start]]))

    def per_text(owner: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32))

    items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], fields=list(RUN_TYPE))
    runs = pa.ListArray.from_arrays(per_text(np.array(owners, dtype=np.int64)), items)
    words = pa.ListArray.from_arrays(per_text(found.text[kept]), found.words.filter(pa.array(kept)))
    return runs, pc.binary_join(words, " ").cast(pa.string())


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus runs (array of start, length, period, in words, by start and
    period) and collapsed_text.

    Words are what lies between ASCII white space, numbered from 0. A run is a
    stretch of words with smallest period q (words q apart are equal), at least
    LEAST_LENGTH words and LEAST_POWER periods long, that no neighbouring word
    extends with that period. In collapsed_text the words of a run after its first
    period are left out, and the others are joined by one blank. A null text is
    empty: no runs, an empty collapsed_text. Rows are independent: null or
    repeated ids, ties and extra columns pass through; the results replace
    columns of those names; an empty table gives an empty result. Texts are read
    whole, at O(n log n) steps.
    """
    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed_text:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for _, texts in array_slices(batch):
                yield pa.StructArray.from_arrays([*runs_of(texts)], names=["runs", "collapsed_text"])
    return with_results(docs, run(F.col(text_col)), ["runs", "collapsed_text"])
