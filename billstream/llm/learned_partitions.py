"""Approximate nearest neighbours over learned partitions.

A bounded sample of the vectors gives a neighbour graph; the graph is cut into
parts of equal size that keep neighbours together; a small classifier learns to
tell a vector's part. It then files every row of the table under its most
probable part, and sends a query to the rows of several probable parts, where
it is compared exactly. How many parts a query needs is measured on sampled
vectors that the classifier was not trained on.

The index is written by part, and queries meet the rows of their parts in a
join by part, so parts without queries aren't read. A part with many rows, or
many queries, is dealt out in pieces; each pair of pieces is one group of
bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, staged
from .histogram_topk import dimension, finite, matrix

#: The sample, and with it the number of parts, grows with the square root of the table, from the first number of rows to the second.
SAMPLE_LEAST, SAMPLE_ROWS, SAMPLE_PER_ROOT = 8192, 32_768, 16
NEIGHBOURS = 10
PART_ROWS = 128
HIDDEN = 128
EPOCHS = 20
RECALL = 0.97
#: Rows, and queries, of a part that one group holds. Small tables have smaller pieces, so that a part with many of their rows is dealt out too.
PIECE_LEAST, PIECE_ROWS, PIECE_QUERIES = 512, 1 << 17, 8192


def neighbours(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k rows of x nearest by angle to each row of x[of], without itself; all unit vectors."""
    out, step = [], max(1, (1 << 19) // max(1, len(x)))
    for a in range(0, len(of), step):
        s = x[of[a : a + step]] @ x.T
        s[np.arange(len(s)), of[a : a + step]] = -np.inf
        out.append(np.argpartition(-s, k - 1, 1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rounds: int = 6, slack: float = 1.1) -> np.ndarray:
    """A part for each node: halves along the widest direction to start with, then moves of nodes to the part with most of their neighbours while that part has room."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, n_parts)]
    while todo:
        nodes, first, parts = todo.pop()
        if parts == 1 or len(nodes) < 2:
            part[nodes] = first
            continue
        y = x[nodes] - x[nodes].mean(0)
        direction = np.linalg.eigh(y.T @ y)[1][:, -1]
        left = parts // 2
        order = nodes[np.argsort(y @ direction, kind="stable")]
        cut = len(order) * left // parts
        todo += [(order[:cut], first, left), (order[cut:], first + left, parts - left)]
    room = int(np.ceil(slack * n / n_parts))
    for _ in range(rounds):
        votes = np.zeros((n, n_parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        to = votes.argmax(1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=n_parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[to[i]] < room:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to parts, how many parts a query is sent to, and what share of the neighbours that finds among vectors not trained on."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    recall: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @staticmethod
    def trained(x: np.ndarray, target: np.ndarray, seed: int = 7) -> Router:
        """target: for each row the shares of the parts among its neighbours and itself."""
        rng, (n, dim), parts = np.random.default_rng(seed), x.shape, target.shape[1]
        p = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)) * np.sqrt(dim) ** 0.5, np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for a in range(0, n, 256):
                i = order[a : a + 256]
                h = np.maximum(x[i] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(1, keepdims=True))
                d = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
                dh = (d @ p[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    p[j] -= 0.005 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return Router(*p)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: squares neither overflow nor vanish, and angles stay exactly what they were."""
    most = np.abs(x).max(1, initial=0)
    return np.ldexp(x, -np.frexp(most)[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fitted(x: np.ndarray, k: int = 5, recall: float = RECALL) -> Router:
    """A router learned from the rows of x; a tenth of them, left out of the training, tell how many parts to probe."""
    x = unit(x)
    n = len(x)
    n_parts = int(max(1, n // PART_ROWS))
    if n_parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    test = np.arange(n) % 10 == 0
    train = x[~test]
    graph = neighbours(train, np.arange(len(train)), min(NEIGHBOURS, len(train) - 1))
    part = balanced_parts(train, graph, n_parts)
    target = np.zeros((len(train), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1] + 1), part[np.concatenate([graph, np.arange(len(train))[:, None]], 1)].ravel()), 1.0 / (graph.shape[1] + 1))
    router = Router.trained(train, target)
    z = router.scores(x)
    filed = z.argmax(1)
    near = neighbours(x, np.flatnonzero(test), min(k, n - 1))
    place = np.argsort(np.argsort(-z[test], 1, kind="stable"), 1, kind="stable")
    needs = np.take_along_axis(place, filed[near], 1)
    shares = np.cumsum(np.bincount(needs.ravel(), minlength=n_parts)) / needs.size
    router.probes = int(np.argmax(shares >= recall)) + 1
    router.recall = float(shares[router.probes - 1])
    return router


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines, added up component by component: equal vectors get equal scores wherever they stand."""
    q, x = scaled(q), scaled(x)
    dot, qq, xx = np.zeros((len(q), len(x))), np.zeros(len(q)), np.zeros(len(x))
    for d in range(q.shape[1]):
        dot += q[:, d, None] * x[None, :, d]
        qq += q[:, d] * q[:, d]
        xx += x[:, d] * x[:, d]
    return dot / (np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :])


FOUND = "query_id long, vec_id long, score double"


def best(ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and ids of the k rows nearest to each query, those of the query's own id aside, ties to smaller ids; -inf where there are fewer."""
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for a in range(0, len(q), 512):
        some = slice(a, min(a + 512, len(q)))
        n = some.stop - a
        for r in range(0, len(x), 2048):
            i = vec_ids[r : r + 2048]
            s = cosines(q[some], x[r : r + 2048])
            s[ids[some, None] == i[None, :]] = -np.inf
            least = np.sort(s, 1)[:, -k:][:, :1]  # the kth of these, or the worst
            y, z = np.nonzero((s >= np.maximum(least, best_s[some, -1:])) & (s > -np.inf))
            score, of = np.concatenate([s[y, z], best_s[some].ravel()]), np.concatenate([y, np.repeat(np.arange(n), k)])
            vec = np.concatenate([i[z], best_i[some].ravel()])
            order = np.lexsort((vec, -score, of))
            first = np.searchsorted(of[order], np.arange(n))
            pick = order[first[:, None] + np.arange(k)]
            best_s[some], best_i[some] = score[pick], vec[pick]
    return best_s, best_i


def _compared(dim: int, k: int):
    """The k best of a piece of a part for each query of a piece of its queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, vec_ids = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        if not len(ids) or not len(vec_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (x, _), (q, _) = (matrix(t.column("embedding").combine_chunks(), dim) for t in (rows, queries))
        s, i = best(ids, q, vec_ids, x, k)
        y, z = np.nonzero(s > -np.inf)
        return pa.table({"query_id": ids[y], "vec_id": i[y, z], "score": s[y, z]})

    return run


def _by_part(values: list[int]) -> Column:
    """A part's value."""
    return F.get(F.lit(values), F.col("part"))


def _piece(key: str, pieces: list[int]) -> Column:
    return F.pmod(F.xxhash64(key), _by_part(pieces)).cast("int")


def _every(pieces: list[int]) -> Column:
    """A row for each piece of the part."""
    return F.explode(F.sequence(F.lit(0), _by_part(pieces) - 1))


def _met(index: DataFrame, sent: DataFrame, row_pieces: list[int], dim: int, k: int) -> DataFrame:
    """FOUND of the queries in sent (query_id, embedding, part) among the index's rows of these parts."""
    n = {r.part: r["count"] for r in sent.groupBy("part").count().collect()}
    query_pieces = [-(-n.get(p, 0) // PIECE_QUERIES) for p in range(len(row_pieces))]
    # Only parts with queries are read.
    rows = index.where(F.col("part").isin(sorted(n))).select("part", "piece", _every(query_pieces).alias("of"), "vec_id", "embedding")
    queries = sent.select("part", _every(row_pieces).alias("piece"), _piece("query_id", query_pieces).alias("of"), "query_id", "embedding")
    key = ("part", "piece", "of")
    return rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_compared(dim, k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, divisor: int = 50, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, parts, probes, recall: up to k near rows by cosine for each query, nearest first, ties to smaller ids; of how many parts the index has how many each query is sent to, and what share of the neighbours of sampled vectors this found.

    vectors: vec_id, embedding; other columns are ignored. Queries are the rows
    whose id is divisible by divisor. The router is fitted on a sample of at
    most about sample_rows different vectors, chosen by their hash; all rows
    are filed and can be found. Rows without an id, and vectors that are null,
    empty, zero, hold null or non-finite components or are of another than the
    commonest dimension take no part. Of rows with one id, each can be found by
    other queries, and the smallest is the query. Queries whose parts hold
    fewer than k rows are compared with all rows. No rows: an empty result.
    """
    spark = vectors.sparkSession
    rows = finite(vectors).where(F.exists("embedding", lambda x: x != 0))
    dim = dimension(rows)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, parts int, probes int, recall double")
    rows = rows.where(F.size("embedding") == dim)
    n = rows.count()
    share = min(1.0, min(sample_rows, max(SAMPLE_LEAST, SAMPLE_PER_ROOT * math.isqrt(n))) / n)
    # Copies have one hash: they are drawn together, and count once.
    chosen = rows.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").distinct().toArrow()
    router = fitted(np.unique(matrix(chosen.column(0).combine_chunks(), dim)[0], axis=0) if len(chosen) else np.ones((1, dim)), k, recall)
    parts, held = router.b2.size, spark.sparkContext.broadcast(router)
    array = rows.schema["embedding"].dataType.simpleString()

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column(1), dim)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(held.value.scores(unit(x)).argmax(1).astype(np.int32))], names=["vec_id", "embedding", "part"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column(1), dim)
            to = np.argsort(-held.value.scores(unit(x)), 1, kind="stable")[:, : held.value.probes]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(to.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "embedding", "parts"])

    filed = staged(rows.mapInArrow(file_rows, f"vec_id long, embedding {array}, part int"), "filed_vectors")
    size = {r.part: r["count"] for r in filed.groupBy("part").count().collect()}
    piece_rows = max(PIECE_LEAST, min(PIECE_ROWS, n // parts))
    row_pieces = [-(-size.get(p, 0) // piece_rows) or 1 for p in range(parts)]
    path = scratch(spark, "vector_index")
    index = filed.withColumn("piece", _piece("vec_id", row_pieces))
    index.repartition("part", "piece").write.partitionBy("part").parquet(path)
    index = spark.read.schema(index.schema).parquet(path)

    queries = rows.where(F.col("vec_id") % divisor == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    sent = queries.mapInArrow(send, f"query_id long, embedding {array}, parts array<int>")
    sent = staged(sent.select("query_id", "embedding", F.explode("parts").alias("part")), "sent_queries")
    near = staged(_ranked(_met(index, sent, row_pieces, dim, k), k), "neighbours")
    full = near.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
    short = staged(queries.join(full, "query_id", "left_anti"), "short_queries")
    if not short.isEmpty():
        everywhere = short.select("query_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        rest = _ranked(_met(index, everywhere, row_pieces, dim, k), k)
        near = near.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest).select(*near.columns)
    return near.withColumn("parts", F.lit(parts)).withColumn("probes", F.lit(router.probes)).withColumn("recall", F.lit(router.recall))
