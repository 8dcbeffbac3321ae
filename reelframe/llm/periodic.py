"""Periodic runs of words: k-gram masking, then Main-Lorentz on what survives.

A run of period q and at least ``max(LEAST, TIMES * q)`` words repeats at distance q over all but q of its words, so
over ``overlap()`` words at least whatever q is. Each of its words therefore lies in a k-gram, k = that overlap, which
occurs twice in the document: a word outside all repeated k-grams joins no run, and cuts the text into segments.

Main-Lorentz halves each segment again and again; a run is found where it crosses the middle of the smallest part that
holds it. Half of the run's words are on one side, so a square of its period stands against the middle on that side:
one comparison of two blocks for each period. Those that pass are extended both ways. All segments of a slice of
texts go through a level together, in numpy passes. Blocks are compared by prefix sums of word values; the runs
found are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship
from .common import slices, tidy
from .hashing import _BASE, U64, Words, mix, powers

#: A run has so many words at least, and its period so many times.
LEAST, TIMES = 6, 4
_AS_IT_IS = np.arange(256, dtype=np.uint8)


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words over which a run equals itself moved by its period: least - 1 or, for long periods, a multiple of them."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def segments(words: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that lie in k-grams which occur twice between first[d] and last[d] (a document)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first)), last - first)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = mix(grams + words[j : j + n - k + 1])
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])  # k-grams inside one document
    keys = mix(grams[at] + doc[at].astype(np.uint64) * U64(_BASE))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + k, -1)
    covered = np.cumsum(depth[:-1]) > 0
    before = np.zeros(n, bool)
    before[1:] = covered[:-1] & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(covered & ~before)
    after = np.zeros(n, bool)
    after[:-1] = covered[1:] & (doc[1:] == doc[:-1])
    return starts, np.flatnonzero(covered & ~after) + 1


class Blocks:
    """Comparison of blocks of a sequence of 64-bit values, by prefix sums of value * base^position modulo 2^64."""

    def __init__(self, values: np.ndarray):
        self.up = powers(_BASE, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether values[a : a + size] and values[b : b + size] are the same; a <= b."""
        return (self.sums[a + size] - self.sums[a]) * self.up[b - a] == self.sums[b + size] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many values, ``most`` at most, are the same from a and b onwards (step 1), or before a and b (step -1): by halving."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            size = np.where(open_, (low + high + 1) // 2, 0)
            back = 0 if step > 0 else size
            same = self.equal(a - back, b - back, size)
            low = np.where(open_ & same, size, low)
            high = np.where(open_ & ~same, size - 1, high)
        return low


def _stretched(values: np.ndarray, low: int, high: int, at: int, period: int) -> tuple[int, int]:
    """The stretch around ``at`` that has the period, word by word."""
    differ = np.flatnonzero(values[low : high - period] != values[low + period : high]) + low
    cut = int(np.searchsorted(differ, at))
    start = int(differ[cut - 1]) + 1 if cut else low
    end = int(differ[cut]) if cut < len(differ) else high - period
    return start, end + period


def _holds(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray, words: int = 1 << 20) -> np.ndarray:
    """Whether each stretch has its period, word by word, so many words at a time."""
    sizes = ends - starts - periods
    good = np.ones(len(starts), bool)
    first = 0
    total = np.cumsum(sizes)
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + words)))
        n = sizes[first:end]
        run = np.repeat(np.arange(first, end), n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + starts[run]
        good[run[values[at] != values[at + periods[run]]]] = False
        first = end
    return good


def main_lorentz(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of the runs in values[low[i] : high[i]], by start, then end; ``times`` is 4 or more.

    A stretch has each multiple of its smallest period too: the smallest of a stretch is kept. A run of n words is
    crossed at the middle of one part only, with a square of its period on the longer side.
    """
    blocks = Blocks(values)
    room = np.stack([low, high, low, high]).astype(np.int64)  # part, and the segment it belongs to
    found = [np.zeros((5, 0), np.int64)]
    while (room := room[:, room[1] - room[0] >= least]).shape[1]:
        middle = (room[0] + room[1]) // 2
        for after in (True, False):
            half = np.minimum((room[1] - middle if after else middle - room[0]) // 2, (room[1] - room[0]) // times)
            part = np.repeat(np.arange(len(half)), half)
            period = np.arange(len(part)) - np.repeat(np.cumsum(half) - half, half) + 1
            at = middle[part] - (0 if after else 2 * period)
            square = blocks.equal(at, at + period, period)
            at, period, part = at[square], period[square], part[square]
            start = at - blocks.reach(at, at + period, at - room[2, part], -1)
            end = at + period + blocks.reach(at, at + period, room[3, part] - at - period, 1)
            long = end - start >= np.maximum(least, times * period)
            found.append(np.stack([start, end, period, at, part])[:, long])
            found[-1][4] = room[2, found[-1][4]]
        room = np.hstack([np.stack([room[0], middle, room[2], room[3]]), np.stack([middle, room[1], room[2], room[3]])])
    start, end, period, at, segment = np.hstack(found)
    once = _firsts(start, end, period)
    if not _holds(values, start[once], end[once], period[once]).all():  # sums that agree by chance: each candidate again, word by word
        tops = dict(zip(low.tolist(), high.tolist(), strict=True))
        for i in range(len(start)):
            start[i], end[i] = _stretched(values, int(segment[i]), tops[int(segment[i])], int(at[i]), int(period[i]))
        long = end - start >= np.maximum(least, times * period)
        start, end, period = start[long], end[long], period[long]
    keep = _firsts(start, end, period)
    return start[keep], end[keep], period[keep]


def _firsts(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of each stretch the place of its smallest period, by start, then end."""
    order = np.lexsort((period, end, start))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)
    return order[new]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with runs (start, length, period; by start, then period) and collapsed, in place of columns of such names.

    Words are stretches without space and U+0009 to U+000D. A run is a stretch of words with smallest period q and at
    least ``max(least, times * q)`` words that no neighbour extends. ``collapsed`` has the words, one space between, but for those in a run after
    its first q words. Null and empty texts, and texts without words, have no runs and an empty ``collapsed``. Rows are told by
    nothing but their text: repeated rows give equal rows. An empty table gives an empty result. A text is handled whole, in memory that grows with its
    length; no row meets another.
    """
    if times < 4 or least < 2:
        raise ValueError("a run repeats its period four times at least, and has two words")
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]
    column, k = rest.index(text), overlap(least, times)

    def handled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for top, bottom, data, offsets in slices(batch.column(column)):
            words = Words(data, offsets, lower=_AS_IT_IS)
            values = words.hashes()
            low, high = segments(values, words.first, words.last, k)
            start, end, period = main_lorentz(values, low, high, least, times)
            drop = np.zeros(len(values) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, end, -1)
            kept = np.cumsum(drop[:-1]) == 0
            doc = np.searchsorted(words.last, start, side="right")
            begin = start - words.first[doc]
            order = np.lexsort((period, begin, doc))
            counts = np.bincount(doc, minlength=bottom - top)
            runs = pa.StructArray.from_arrays([pa.array(x[order]) for x in (begin, end - start, period)], fields=list(_RUNS.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), runs)
            raw, collapsed = data.tobytes(), []
            for i in range(bottom - top):
                mine = raw[offsets[i] : offsets[i + 1]].split()
                collapsed.append(b" ".join(compress(mine, kept[words.first[i] : words.last[i]]) if counts[i] else mine))
            yield pa.RecordBatch.from_arrays([*batch.slice(top, bottom - top).columns, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*rest, "runs", "collapsed"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from handled(batch)

    return docs.select(rest).mapInArrow(run, docs.select(rest).schema.add("runs", StructType.fromDDL(f"x {RUNS}")["x"].dataType).add("collapsed", "string"))
