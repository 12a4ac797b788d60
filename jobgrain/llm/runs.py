"""Stretches of a text that repeat with a short period (runs), by branching tandem repeats in an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import WORD
from jobgrain.llm.linking import ragged

#: Bytes of text whose suffixes are sorted at a time, about; a longer text is sorted alone.
AT_A_TIME = 4 << 20
#: Suffixes of smaller children that are looked at together.
CELLS = 1 << 21

_OUT = "id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixArray:
    """The suffixes of many sequences laid one after the other, in order: by sequence, then by content, an end before all.

    Ranks come by prefix doubling: level k has one number for suffixes of one sequence that agree in 2 ** k places, and
    only suffixes that still share a number are looked at again. Levels also tell how far two places agree, to
    the right or to the left, in one look a level.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        self.n = n
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.first = (np.cumsum(lengths) - lengths)[self.doc]
        end = self.first + lengths[self.doc]
        key = self.doc * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n + 1, np.int64)
        rank[n] = -1
        active = self._renumber(rank, order, key[order], np.arange(n))
        self.levels: list[np.ndarray] = []
        step = 1
        while len(active):
            self.levels.append(rank.astype(np.int32) if n < 2**31 - 1 else rank.copy())
            after = np.where(active + step < end[active], rank[np.minimum(active + step, n)], -1)
            key = rank[active] * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            # groups are whole and lie in the order of their ranks, so the old rank and the place in the group give the new one
            old = rank[active[order]]
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            base = old - np.repeat(head, np.diff(np.r_[head, len(old)]))
            active = self._renumber(rank, active[order], key[order], base + np.arange(len(old)))
            step *= 2
        self.rank = rank[:n]
        self.suffix = np.empty(n, np.int64)
        self.suffix[self.rank] = np.arange(n)

    @staticmethod
    def _renumber(rank: np.ndarray, places: np.ndarray, key: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Sorted places take the first position of their group of equal keys; returns those that are not alone."""
        if not len(places):
            return places
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        rank[places] = np.repeat(where[head], size)
        return places[np.repeat(size > 1, size)]

    def common_prefixes(self) -> np.ndarray:
        """For each suffix in order, how many places it shares with the one before it; 0 before the first and after the last."""
        out = np.zeros(self.n + 1, np.int64)
        if self.levels:
            near = np.flatnonzero(self.levels[0][self.suffix[1:]] == self.levels[0][self.suffix[:-1]]) + 1
            x, y = self.suffix[near - 1], self.suffix[near]
            shared = np.zeros(len(near), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                level = self.levels[k]
                shared[level[x + shared] == level[y + shared]] += 1 << k
            out[near] = shared
        return out

    def left_of(self, places: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The smallest start from which all places up to the given ones equal those `shift` further on."""
        start = places.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], start - (1 << k)
            start = np.where((back >= self.first[places]) & (level[back] == level[back + shift]), back, start)
        return start


def _splits(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where intervals of the suffix order part into children: at, low, high say that the suffixes low..at-1 and at..high-1 share
    lcp[at] places and no suffix of the one side shares more with one of the other. An interval of many children parts at each
    border, so every pair of its children parts once. Found by doubling over range minima, without a stack or nodes."""
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return at, at, at
    run = np.diff(np.flatnonzero(np.r_[True, np.diff(at) > 1, True])).max()  # of positive values
    least = [lcp.astype(np.int32)]
    while 1 << len(least) <= run:
        a, step = least[-1], 1 << len(least) - 1
        least.append(np.minimum(a, np.concatenate([a[step:], np.zeros(step, a.dtype)])))
    depth, low, high = lcp[at], at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        back = low - (1 << k)
        low = np.where((back > 0) & (least[k][np.maximum(back, 0)] >= depth), back, low)
        on = (high + (1 << k) <= len(lcp)) & (least[k][np.minimum(high, len(lcp) - 1)] > depth)
        high = np.where(on, high + (1 << k), high)
    return at, low - 1, high


def squares(order: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half of every branching tandem repeat: the last square of each run, for each of its periods.

    Where an interval of depth d parts in two, each suffix i of the smaller side asks through its rank whether i + d or
    i - d is on the other side; then both share exactly d places, d apart.
    """
    lcp = order.common_prefixes()
    at, low, high = _splits(lcp)
    depth = lcp[at]
    left = at - low <= high - at
    begin, count = np.where(left, low, at), np.where(left, at - low, high - at)
    other, stop = np.where(left, at, low), np.where(left, high, at)
    starts, halves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut = np.searchsorted(np.cumsum(count), np.arange(CELLS, int(count.sum()) + CELLS, CELLS), "right")
    done = 0
    for k in np.unique(np.r_[cut, len(at)]).tolist():
        row, place = ragged(count[done:k])
        row += done
        i, d = order.suffix[begin[row] + place], depth[row]
        for j in (i + d, i - d):
            r = order.rank[np.clip(j, 0, order.n - 1)]
            hit = (j >= 0) & (j < order.n) & (r >= other[row]) & (r < stop[row])
            starts.append(np.minimum(i, j)[hit])
            halves.append(d[hit])
        done = k
    return np.concatenate(starts), np.concatenate(halves)


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of sequences laid one after the other, which are no shorter than `least` and `times` periods (two at least): sequence,
    start in it, length, smallest period; by sequence, start and period.

    A branching square at i of half q is rotated to the left as far as its run goes; the run ends at i + 2q. A run turns up
    once for each multiple of its period that fits in twice; the smallest is its period.
    """
    order = SuffixArray(codes, lengths)
    i, q = squares(order)
    start, end = order.left_of(i, q), i + 2 * q
    long_enough = end - start >= np.maximum(least, max(2, times) * q)
    start, end, q = start[long_enough], end[long_enough], q[long_enough]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, q = start[new], end[new], q[new]
    by = np.lexsort((q, start))
    start, end, q = start[by], end[by], q[by]
    return order.doc[start], start - order.first[start], end - start, q


def _some(texts: list[bytes], least: int, times: int) -> list[pa.Array]:
    """n_words, runs and collapsed text of some documents."""
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(lengths.sum()))
    doc, start, length, period = find_runs(codes, lengths, least, times)
    first = np.cumsum(lengths) - lengths
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, first[doc] + start + period, 1)
    np.add.at(gone, first[doc] + start + length, -1)
    kept = np.cumsum(gone)[:-1] == 0
    for d in np.unique(doc).tolist():
        mine = kept[first[d] : first[d] + lengths[d]]
        words[d] = [words[d][k] for k in np.flatnonzero(mine).tolist()]
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string(), safe=False)]


def _task(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
            start = 0
            while start < len(batch):
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + AT_A_TIME, "right")))
                some = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([some.column(0), *_some(some.column(1).to_pylist(), least, times)], ["id", "n_words", "runs", "collapsed"])
                start = stop

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row a document: id, n_words, runs (start, length, period in words, by start and period), collapsed.

    A run is a stretch of words with smallest period q, of at least `least` words and `times` periods, that no neighbouring word
    extends with that period. collapsed has the words joined by one space, without those that any run holds after its
    first period. Words are [^\\x20\\x09-\\x0D]+, compared exactly, in whole texts; all such runs are found.

    A narrow operator: texts are read some MB at a time, and a text of n words takes O(n log n) time and about 8 bytes a word for
    each doubling of its longest repeat. Null texts are empty: no words, no runs, an empty collapsed text. Ids may
    be of any type, null or repeated, and rows that are repeated are answered each; other columns are ignored; an
    empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(_task(least, times), _OUT.format(kind=docs.schema[id_col].dataType.simpleString()))


def looped(text: Column, doc_id: Column) -> Column:
    """A text that runs in circles, for one document in ten: with h = crc32 of the id in decimal, g = h div 10 and n words, where h is
    divisible by 10, each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    Other texts stay as they are, those of a null id and null texts too."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = (h / 10).cast("long")

    def circle(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + ((n - a) / (3 + g % 8)).cast("long")
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    # the array of one binds the words, which a nested function would split anew for each of them
    once = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), circle)[0]
    return F.when((h % 10 == 0) & text.isNotNull(), once).otherwise(text)


def most_periodic(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the one with the smallest start, then period. Null without runs."""
    def better(x: Column, y: Column) -> Column:
        x_more, y_more = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(x_more > y_more, x).otherwise(y)  # y came first

    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: better(x, best))
