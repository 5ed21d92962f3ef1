"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of consecutive words whose words `period` places apart are
equal, with no smaller period, of at least `least_length` words and
`least_exponent` periods, which no neighbouring word extends.

Words become numbers, and the suffixes of every document are sorted by prefix
doubling. Suffixes that are neighbours in that order are edges, weighted by the
length of their common prefix (LCP). Edges are taken by decreasing LCP and unite
suffix classes in a union-find; a class keeps its positions in order. When two
classes meet at LCP l, positions i < j that become neighbours in the united class
share exactly l words; at a distance d = j - i of at most l they begin a stretch of
period d and length l + d. It is a run if the words before them differ. No smaller
period is possible: with period g < d, i and i + g would share more than l words,
so i + g would lie in the class between i and j already. Each run is met once, at
its first position and the one a period further.

A run of the lengths asked for has an LCP of at least
`least_length * (1 - 1 / least_exponent)`, where the unions stop. Documents in which
no window of that many words occurs twice have no such edge; they are told by a sort
of window hashes (a collision costs time alone), many documents at once. A document
lies in one task, since a run may span all of it; time is n log^2 n in its words.

Cases: words are what lies between ASCII white space (space, tab to carriage
return). A null, empty or blank text has no runs and collapses to the empty text.
Repeated rows are treated row by row, runs of one start differ in period and are all
returned, and an empty table gives an empty result. Input columns of the names
`runs` and `collapsed` are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import small_batches

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Bytes of text whose documents are sorted together.
TOGETHER = 4 << 20

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
Run = tuple[int, int, int]


class Positions:
    """Whole numbers in order, in chunks, so that adding to a large set moves few of them."""

    CHUNK = 1024

    def __init__(self, first: int) -> None:
        self.chunks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The nearest members below and above x, which is none itself."""
        at = max(bisect_right(self.lows, x) - 1, 0)
        chunk = self.chunks[at]
        k = bisect_left(chunk, x)
        below = chunk[k - 1] if k else None
        if k < len(chunk):
            return below, chunk[k]
        return below, self.lows[at + 1] if at + 1 < len(self.lows) else None

    def add(self, x: int) -> None:
        at = max(bisect_right(self.lows, x) - 1, 0)
        chunk = self.chunks[at]
        insort(chunk, x)
        self.lows[at] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * self.CHUNK:
            self.chunks[at:at + 1] = [chunk[:self.CHUNK], chunk[self.CHUNK:]]
            self.lows[at:at + 1] = [chunk[0], chunk[self.CHUNK]]


def has_repeat(symbols: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Per document, which ends at `ends`, whether a window of `width` symbols may occur twice in it.

    Symbols of different documents differ. Hashes of shorter windows are joined by the bits of `width`.
    """
    starts = np.r_[0, ends[:-1]]
    last = np.repeat(ends, ends - starts) - width
    at = np.flatnonzero(np.arange(len(symbols)) <= last)
    if not len(at):
        return np.zeros(len(ends), bool)
    with np.errstate(over="ignore"):
        piece = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        piece ^= piece >> np.uint64(29)
        factor, size, taken, h = np.uint64(0xBF58476D1CE4E5B9), 1, 0, np.zeros(len(at), np.uint64)
        while True:
            if width & size:
                h = h * factor + piece[at + taken]
                taken += size
            if taken == width:
                break
            joined = piece.copy()
            joined[:-size] = piece[:-size] * factor + piece[size:]
            piece, factor, size = joined ^ (joined >> np.uint64(31)), factor * factor, size * 2
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    found = np.zeros(len(ends), bool)
    found[np.searchsorted(ends, at[order[1:][twice]], side="right")] = True
    return found


def lcp_edges(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of suffixes that are neighbours in suffix order, with LCPs of at least `least`, largest first.

    Ranks of prefixes of 1, 2, 4, ... symbols: a rank is the place at which its
    class begins in suffix order, and only classes of several suffixes are
    refined. The ranks of all rounds give the LCPs by binary descent.
    """
    n = len(symbols)
    values, rank, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[rank].astype(np.int64)
    levels, size = [np.r_[rank, -1].astype(np.int32)], 1
    active = np.flatnonzero(counts[np.searchsorted(values, symbols)] > 1)
    while len(active):
        after = np.full(len(active), -1, np.int64)
        inside = active + size < n
        after[inside] = rank[active[inside] + size]
        key = rank[active] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        place = np.arange(len(active))
        opens = np.r_[True, old[1:] != old[:-1]]
        splits = np.r_[True, key[1:] != key[:-1]]
        first, within = np.maximum.accumulate(np.where(opens, place, 0)), np.maximum.accumulate(np.where(splits, place, 0))
        rank = rank.copy()
        rank[active] = old + within - first
        levels.append(np.r_[rank, -1].astype(np.int32))
        alone = splits & np.r_[splits[1:], True]
        active, size = active[~alone], size * 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    i, j = order[:-1], order[1:]
    kept = i != j
    for level, ranks in enumerate(levels):
        if 1 << level <= least:  # a common prefix of `least` symbols is one of every shorter length
            kept &= ranks[i] == ranks[j]
    i, j = i[kept], j[kept]
    lcp, a, b = np.zeros(len(i), np.int64), i.copy(), j.copy()
    for level in range(len(levels) - 1, -1, -1):
        step = (levels[level][a] == levels[level][b]).astype(np.int64) << level
        lcp, a, b = lcp + step, a + step, b + step
    long = np.flatnonzero(lcp >= least)
    long = long[np.argsort(-lcp[long], kind="stable")]
    return i[long], j[long], lcp[long]


def runs_of(symbols: np.ndarray, least_length: int, least_exponent: int) -> list[Run]:
    """The runs in a sequence of numbers (documents end to end if none shares a number with another)."""
    least = least_lcp(least_length, least_exponent)
    found: list[Run] = []
    left, right, weights = lcp_edges(symbols, least)
    names, compact = np.unique(np.r_[left, right], return_inverse=True)
    places, root = names.tolist(), list(range(len(names)))
    classes: list[Positions | None] = [None] * len(names)
    word = symbols.tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def meet(i: int, j: int, lcp: int) -> None:
        d = j - i
        if d <= lcp and lcp + d >= least_length and lcp + d >= least_exponent * d and (i == 0 or word[i - 1] != word[j - 1]):
            found.append((i, lcp + d, d))

    for a, b, lcp in zip(compact[:len(left)].tolist(), compact[len(left):].tolist(), weights.tolist()):
        a, b = find(a), find(b)
        one, other = classes[a] or Positions(places[a]), classes[b] or Positions(places[b])
        if one.size < other.size:
            a, b, one, other = b, a, other, one
        root[b], classes[a], classes[b] = a, one, None
        few = list(other)
        for k, x in enumerate(few):
            below, above = one.around(x)
            if below is not None and (k == 0 or few[k - 1] < below):
                meet(below, x, lcp)
            if above is not None and (k + 1 == len(few) or above < few[k + 1]):
                meet(x, above, lcp)
        for x in few:
            one.add(x)
    return found


def least_lcp(least_length: int, least_exponent: int) -> int:
    return max(1, -(-least_length * (least_exponent - 1) // least_exponent))


def runs_in_texts(texts: Sequence[bytes | None], least_length: int = LEAST_LENGTH,
                  least_exponent: int = LEAST_EXPONENT) -> tuple[list[list[Run]], list[bytes]]:
    """Per text its runs by start and period, and its text without what they repeat."""
    words = [t.split() if t else [] for t in texts]
    runs: list[list[Run]] = [[] for _ in words]
    ends = np.cumsum([len(w) for w in words])
    symbols = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for own, end in zip(words, ends.tolist()):  # a word is named by the place of its first occurrence
        start = end - len(own)
        symbols[start:end] = np.fromiter(map({}.setdefault, own, range(start, end)), np.int64, len(own))
    some = np.flatnonzero(has_repeat(symbols, ends, least_lcp(least_length, least_exponent))) if len(symbols) else []
    collapsed = [b" ".join(w) for w in words]
    if not len(some):
        return runs, collapsed
    parts = [symbols[ends[d] - len(words[d]):ends[d]] for d in some]
    stops = np.cumsum([len(p) for p in parts])
    for start, length, period in sorted(runs_of(np.concatenate(parts), least_length, least_exponent),
                                        key=lambda run: (run[0], run[2])):
        d = int(np.searchsorted(stops, start, side="right"))
        runs[some[d]].append((start - int(stops[d]) + len(parts[d]), length, period))
    for d in some:
        if runs[d]:
            edge = np.zeros(len(words[d]) + 1, np.int64)
            for start, length, period in runs[d]:
                edge[start + period] += 1
                edge[start + length] -= 1
            collapsed[d] = b" ".join([w for w, covered in zip(words[d], np.cumsum(edge[:-1]).tolist()) if not covered])
    return runs, collapsed


def with_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """`docs` with `runs` (array of start, length, period in words) and `collapsed` in place of `text`.

    `collapsed` are the words joined by single spaces, without those that a run holds after its first period.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("runs have two periods and one word at least")
    small_batches(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name not in ("text", "runs", "collapsed")]
    schema = T.StructType([*others, T.StructField("runs", T.ArrayType(RUN, False), False),
                           T.StructField("collapsed", T.StringType(), False)])
    read = docs.select(F.col("text").cast("binary").alias("text"), *[F.col(f"`{f.name}`") for f in others])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(t) for t in batch.column(0).fill_null(b"").to_pylist()])
            cuts = np.flatnonzero(np.diff(sizes // TOGETHER)) + 1 if len(sizes) else []
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                rows = batch.slice(low, high - low)
                runs, collapsed = runs_in_texts(rows.column(0).to_pylist(), least_length, least_exponent)
                found = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(ARROW_RUN))
                offsets = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[1:], pa.ListArray.from_arrays(offsets, each),
                     pa.array(collapsed, pa.binary()).view(pa.string())], [f.name for f in schema.fields])

    return read.mapInArrow(work, schema)
