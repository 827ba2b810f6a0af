"""Maximal runs of repeated words in documents, by suffix trees.

A run is a stretch of words with smallest period q that cannot be made longer
on either side. Every run has a Lyndon root: under one of the two opposite
orders of words, the longest Lyndon word that begins at some place inside it is
q words long. Such words end where the next smaller (or, under the opposite
order, the next larger) suffix begins, which the leaves of a suffix tree tell.
Each candidate is extended to both sides by longest common extensions: depths
of lowest common ancestors in the trees of the stretch and of its reversal,
read in constant time each as range minima over the Euler tours.

Trees (Ukkonen) are built for the stretches of a document that can hold a run.
A run of at least LEAST words and three periods repeats GRAM words at the
distance of its period, all over its length; so it lies whole inside a stretch
that is covered by grams with a near copy, and is as long there as in the
document. All other words are in no run. Grams are compared by hashes, which
can only make stretches longer.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: LEAST - LEAST / PERIODS: so many words of a run, at least, come again one period later.
GRAM = 16
RUNS = "array<struct<start: long, length: long, period: long>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 divided by the golden ratio


class Tree:
    """The suffix tree of a list of numbers that ends in one found nowhere else: Euler tour of depths, the tour's place of each suffix, and the suffixes in order."""

    def __init__(self, s: list[int]):
        n, width = len(s), max(s) + 2
        # Arcs by node and first number (from -1) in one map; nodes' other properties are numbers in arrays.
        start, end, link, arcs = array("i", [0]), array("i", [0]), array("i", [0]), {}
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest, unlinked = rest + 1, 0
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = arcs.get(key, 0)
                if not child:
                    arcs[key] = len(start)
                    at = node
                else:
                    first = start[child]
                    size = end[child] - first
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if s[first + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    at = len(start)
                    arcs[key] = at
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    start[child] = first + length
                    arcs[at * width + s[first + length]] = child
                    arcs[at * width + c] = at + 1
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = at
                unlinked = at if child else 0
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - rest + 1
        # Arcs in the order of node and number, which is that of the tour.
        keys, below = (np.fromiter(x, np.int64, len(arcs)) for x in (arcs.keys(), arcs.values()))
        arcs.clear()
        order = np.argsort(keys)
        bounds = array("i", np.searchsorted((keys[order] + 1) // width, np.arange(len(start) + 1)).astype(np.int32).tobytes())
        below = array("i", below[order].astype(np.int32).tobytes())
        tour, place, suffixes, stack = array("i"), array("i", bytes(4 * n)), array("i"), [(0, 0)]
        while stack:
            v, depth = stack.pop()
            if v >= 0:  # else back in the node of this depth
                first, last = bounds[v], bounds[v + 1]
                if first == last:
                    place[n - depth] = len(tour)
                    suffixes.append(n - depth)
                for k in range(last - 1, first - 1, -1):
                    child = below[k]
                    stack.append((-1, depth))
                    stack.append((child, depth + end[child] - start[child]))
            tour.append(depth)
        self.tour, self.place, self.order = np.array(tour, np.int32), np.array(place, np.int64), np.array(suffixes, np.int64)

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers are the same from a[k] and from b[k] on. Ranges are answered by size, so that one level of the table of minima is held at a time."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out, minima = np.empty(len(a), np.int64), self.tour
        for k in range(int(level.max(initial=-1)) + 1):
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(minima[low[of]], minima[high[of] - (1 << k) + 1])
            minima = np.minimum(minima[: -(1 << k)], minima[1 << k :])
        return out


def _next(rank: list[int], larger: bool) -> np.ndarray:
    """For each place the next one with a smaller, or larger, rank; -1 if there is none."""
    out, stack = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while stack and (rank[stack[-1]] < r if larger else rank[stack[-1]] > r):
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of numbers from 0 that have that many elements and periods (two or more), in order."""
    n = len(symbols)
    forward, backward = Tree([*symbols, -1]), Tree([*symbols[::-1], -1])
    rank = np.empty(n + 1, np.int64)
    rank[forward.order] = np.arange(n + 1)
    rank = rank.tolist()
    found: set[tuple[int, int, int]] = set()
    for larger in (False, True):
        j = _next(rank, larger)[:n]
        i = np.flatnonzero((j >= 0) & ((j - np.arange(n)) * periods <= n))
        j = j[i]
        period = j - i
        start = i.copy()
        inside = np.flatnonzero(i > 0)
        start[inside] -= backward.extensions(n - i[inside], n - j[inside])
        length = j + forward.extensions(i, j) - start
        for k in np.flatnonzero((length >= least) & (length >= periods * period)):
            found.add((int(start[k]), int(length[k]), int(period[k])))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(begin, end) of the parts that can hold a run: covered by grams that come again no further than a third of the part away."""
    n = len(words)
    if n < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    k = 1
    while k < GRAM:
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * _ODD + h[k:]
        k *= 2
    h = h ^ (h >> np.uint64(31))
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    by = np.argsort(h, kind="stable")
    gap = np.where(h[by[1:]] == h[by[:-1]], by[1:] - by[:-1], n)
    near = np.empty(len(h), np.int64)
    near[by] = np.minimum(np.append(gap, n), np.insert(gap, 0, n))
    at = np.flatnonzero(near * PERIODS <= n)
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-n) > GRAM)
        last = np.append(first[1:], len(at)) - 1
        size = at[last] + GRAM - at[first]
        keep = near[at] * PERIODS <= np.repeat(np.where(size >= LEAST, size, 0), last - first + 1)
        if keep.all():
            return list(zip(at[first].tolist(), (at[last] + GRAM).tolist(), strict=True))
        at = at[keep]
    return []


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document's words, by start, then period."""
    out = []
    for a, b in stretches(words):
        numbers: dict[bytes, int] = {}
        out += [(a + s, n, p) for s, n, p in runs_of([numbers.setdefault(w, len(numbers)) for w in words[a:b]])]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _scan(id_type: pa.DataType):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for text in batch.column("text").cast(pa.large_string()).view(pa.large_binary()):
                words = (text.as_py() or b"").split()
                found = word_runs(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(kept, pa.large_binary()).view(pa.large_string()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed of every row of docs (doc_id, text; other columns are ignored).

    Words are what is between spaces and tabs to carriage returns; collapsed
    has the words that stay, joined by one space. Null and empty texts, and
    texts without words, have no runs and collapse to the empty text. Rows are
    judged one by one, so repeated rows and rows without an id stay. A text
    counts whole and is worked on by one task, in memory proportional to its
    length. No rows: an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    return limit_batches(docs.select("doc_id", "text").mapInArrow(_scan(kind), f"doc_id {kind.simpleString()}, runs {RUNS}, collapsed string"))


def rebuilt(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one document of ten, by the checksum of its id (null: of the empty text), has a periodic tail made of its own words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.greatest(F.size("words"), F.lit(1))
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    again = F.array_join(F.concat(F.slice("words", 1, a), tail), " ")
    return rows.select("doc_id", F.when(F.size("words") > 0, again).otherwise(F.col("text")).alias("text"))


def _greatest(runs: Column) -> Column:
    """The run of the greatest exponent, exactly; ties go to the smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        more, less = x.length * y.period, y.length * x.period
        return F.when(more > less, -1).when(more < less, 1).when(x.start < y.start, -1).when(x.start > y.start, 1).when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0)

    return F.get(F.array_sort(runs, order), F.lit(0))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of periodic_runs() over the rebuilt documents."""
    found = periodic_runs(rebuilt(docs)).withColumn("best", _greatest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period")))), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
