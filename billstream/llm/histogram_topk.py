"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, several times over, but no list of
scores is kept. A first pass finds a range that must hold each query's kth
score; then histograms of the scores in that range, added up over all tasks,
tell which bin holds it, and the range shrinks to that bin until it is one
score. A last pass keeps the rows above it and, of those at it, the smallest
ids.

Queries come in blocks of bounded size, each sent to all tasks; what a pass
sends back for a query is a few bins a task. A block's result is written before
the next one starts, so plans don't grow with the number of blocks.

Scores are exact. Where doubles can't hold the sums, Python's integers do; a
score beyond the range of a long is the end of that range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

BLOCK_QUERIES = 4096
BINS = 1024
TILE = 1 << 21  # scores held at once
EXACT = 1 << 53
LONG = np.iinfo(np.int64)
TOP = np.uint64(1 << 63)


def ordered(scores: np.ndarray) -> np.ndarray:
    """Longs as unsigned ones of the same order: differences of these don't overflow."""
    return scores.view(np.uint64) ^ TOP


def scores_of(ordered_: np.ndarray) -> np.ndarray:
    return (ordered_ ^ TOP).view(np.int64)


def finite(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part: an id, and a vector without null, NaN or infinite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that dimension as rows of doubles, and which rows they are."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dim)
    if len(keep) < len(lengths):
        column = column.take(pa.array(keep))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), keep


def units(x: float) -> int:
    """floor(1024 * x), whatever the size of x."""
    return math.floor(1024.0 * x) if abs(x) < 1e300 else 1024 * int(x)


_TO_INT = np.vectorize(units, otypes=[object])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows' units, as longs; those out of their range as its ends."""
    with np.errstate(over="ignore"):
        a, b = np.floor(1024.0 * q), np.floor(1024.0 * x)
    most = math.sqrt(EXACT / q.shape[1])
    far_q, far_x = np.abs(a).max(1, initial=0) >= most, np.abs(b).max(1, initial=0) >= most
    if not far_q.any() and not far_x.any():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    near = np.ix_(~far_q, ~far_x)
    out[near] = a[~far_q] @ b[~far_x].T
    for rows, columns in ((far_q, np.ones(len(x), bool)), (~far_q, far_x)):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = np.clip(_TO_INT(q[rows]) @ _TO_INT(x[columns]).T, LONG.min, LONG.max).astype(np.int64)
    return out


def dimension(rows: DataFrame) -> int:
    """The commonest length of a vector, the shortest of those; 0 without rows."""
    found = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return found.dim if found else 0


def query_blocks(queries: DataFrame, dim: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of the queries, in blocks of about block; the first vector of an id that is repeated."""
    queries = queries.where(F.size("embedding") == dim)
    n = -(-queries.count() // block)
    for b in range(n):
        rows = sorted(map(tuple, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect())) if n else []
        first = {i: v for i, v in reversed(rows)}
        if first:
            ids = np.array(sorted(first), np.int64)
            yield ids, np.array([first[i] for i in ids.tolist()], np.float64)


def _tiles(batches, ids, q, dim):
    """Tiles of scores: the number of the first query, row ids, ordered() scores, and which of them are of other rows than the query's own."""
    for batch in batches:
        x, keep = matrix(batch.column(1), dim)
        vec_ids = batch.column(0).to_numpy()[keep]
        rows = max(1, min(len(x), 4096))
        for r in range(0, len(x), rows):
            step = max(1, TILE // rows)
            for a in range(0, len(q), step):
                others = ids[a : a + step, None] != vec_ids[None, r : r + rows]
                yield a, vec_ids[r : r + rows], ordered(products(q[a : a + step], x[r : r + rows])), others


def _range_pass(held, k, dim):
    """q, n, kth, most, least of the scores a task has for each query; kth: null if it has fewer than k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        top, n, least = np.zeros((len(q), k), np.uint64), np.zeros(len(q), np.int64), np.full(len(q), ~np.uint64(0))
        for a, _, s, others in _tiles(batches, ids, q, dim):
            b = a + len(s)
            n[a:b] += others.sum(1)
            least[a:b] = np.minimum(least[a:b], np.where(others, s, ~np.uint64(0)).min(1))
            both = np.concatenate([top[a:b], np.where(others, s, np.uint64(0))], 1)  # zeros that stand for nothing don't matter: kth is given only with k real scores
            top[a:b] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        i = np.flatnonzero(n)
        yield pa.record_batch([pa.array(i), pa.array(n[i]), pa.array(scores_of(top[i].min(1)), mask=n[i] < k), pa.array(scores_of(top[i].max(1))), pa.array(scores_of(least[i]))], names=["q", "n", "kth", "most", "least"])

    return run


def _histogram_pass(held, low, high, width, dim):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        counts: dict[int, int] = {}
        for a, _, s, others in _tiles(batches, ids, q, dim):
            i, j = np.nonzero(others & (s >= low[a : a + len(s), None]))
            score, i = s[i, j], i + a
            place = np.where(score > high[i], BINS, ((score - low[i]) // width[i]).astype(np.int64))  # the last bin: all above the range
            key, n = np.unique(i * (BINS + 1) + place, return_counts=True)
            for x, y in zip(key.tolist(), n.tolist(), strict=True):
                counts[x] = counts.get(x, 0) + y
        key = np.fromiter(counts, np.int64, len(counts))
        yield pa.record_batch([pa.array(key // (BINS + 1)), pa.array(key % (BINS + 1)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["q", "bin", "n"])

    return run


def _last_pass(held, at, ties, dim):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        out, tied = [], [np.empty(0, np.int64)] * len(q)
        for a, vec_ids, s, others in _tiles(batches, ids, q, dim):
            i, j = np.nonzero(others & (s > at[a : a + len(s), None]))
            out.append((ids[i + a], vec_ids[j], scores_of(s[i, j])))
            i, j = np.nonzero(others & (s == at[a : a + len(s), None]))
            for x in np.unique(i).tolist():
                tied[a + x] = np.sort(np.concatenate([tied[a + x], vec_ids[j[i == x]]]))[: ties[a + x]]
        out += [(np.full(len(t), ids[x]), t, np.full(len(t), scores_of(at[x : x + 1])[0])) for x, t in enumerate(tied) if len(t)]
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def histogram_topk(vectors: DataFrame, k: int = 10, divisor: int = 100, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query, ties to smaller ids.

    vectors: vec_id, embedding; other columns are ignored. Queries are the rows
    whose id is divisible by divisor. Rows without an id, and vectors that are
    null, empty, hold null or non-finite components or are of another than the
    commonest dimension take no part. Of rows with one id, each is a candidate
    for the others' queries, none for its own, and the smallest is the query.
    Queries with fewer than k candidates get all. Components of any finite size
    count exactly; scores out of the range of a long are ties at its end. No
    rows: an empty result.
    """
    spark = vectors.sparkSession
    rows = finite(vectors)
    dim = dimension(rows)
    kind, path = "query_id long, vec_id long, score long", scratch(spark, "topk")
    blocks = 0
    for ids, q in query_blocks(rows.where(F.col("vec_id") % divisor == 0), dim, block):
        held = spark.sparkContext.broadcast((ids, q))
        ends = rows.mapInArrow(_range_pass(held, k, dim), "q long, n long, kth long, most long, least long")
        ends = ends.groupBy("q").agg(F.sum("n").alias("n"), F.max("kth").alias("kth"), F.max("most").alias("most"), F.min("least").alias("least")).collect()
        low, high, total = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)  # without candidates: no range
        for r in ends:
            # A task with k scores puts the kth of all at or above its own.
            low[r.q], high[r.q] = ordered(np.array([r.least if r.kth is None else r.kth, r.most]))
            total[r.q] = r.n
        above = np.zeros(len(q), np.int64)  # scores above the range
        wanted = np.minimum(total, k)
        while True:
            width = np.array([max(1, -((x - y - 1) // BINS)) if n else 1 for x, y, n in zip(low.tolist(), high.tolist(), total, strict=True)], np.uint64)
            counts = rows.mapInArrow(_histogram_pass(held, low, high, width, dim), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
            upto = counts.withColumn("upto", F.sum("n").over(down))
            # A query with fewer than k candidates wants them all: its lowest bin.
            first = F.row_number().over(W.partitionBy("q").orderBy((F.col("upto") < k).cast("int"), F.when(F.col("upto") < k, -F.col("upto")).otherwise(F.col("upto"))))
            for r in upto.withColumn("place", first).where("place = 1").collect():
                above[r.q] = r.upto - r.n
                start = int(low[r.q]) + r.bin * int(width[r.q])
                low[r.q], high[r.q] = start, min(int(high[r.q]), start + int(width[r.q]) - 1)
            if all(w == 1 for w in width):
                break
        ties = np.maximum(wanted - above, 0)
        rows.mapInArrow(_last_pass(held, low, ties, dim), kind).write.parquet(f"{path}/block={blocks}")
        blocks += 1
    found = spark.read.schema(kind).parquet(*(f"{path}/block={b}" for b in range(blocks))) if blocks else spark.createDataFrame([], kind)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
