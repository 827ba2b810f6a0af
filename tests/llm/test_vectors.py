"""The vector operators against brute force."""

import collections
import re
from fractions import Fraction

import numpy as np
import pytest

from billstream.llm import histogram_topk as h
from billstream.llm import learned_partitions as lp
from billstream.llm.learned_partitions import balanced_parts, cosines, fitted, nearest, neighbours, unit

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, part int, score string"


def vectors(n=1500, dim=8, copies=400, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    x = (centres[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, dim))).astype(np.float32)
    x[n - copies :] = x[0]
    return x


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v.tolist(), 0, 1, 2, "s") for i, v in enumerate(vectors())]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [nan] * 8, [inf] + [0.0] * 7, [None] + [1.0] * 7, [1.0] * 3]
    rows += [(10_000 + 100 * k, v, 0, 1, 2, "s") for k, v in enumerate(odd)] + [(None, [1.0] * 8, 0, 1, 2, "s"), (20_000, [0.0] * 8, 0, 1, 2, "s"), (150, rows[150][1], 0, 1, 2, "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_exact_topk(spark, table):
    x = np.floor(1024 * np.concatenate([vectors().astype(float), np.zeros((1, 8)), vectors()[150:151].astype(float)]))
    ids = np.array([*range(1500), 20_000, 150])
    want = collections.Counter()
    for q in [i for i in range(len(ids)) if ids[i] % 100 == 0]:
        s = (x @ x[q]).astype(int)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:10]
        want.update((int(ids[q]), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order))
    for block in (4096, 4):
        assert collections.Counter(map(tuple, h.histogram_topk(table, block=block).collect())) == want
    assert h.histogram_topk(table.limit(0)).count() == 0
    few = table.where("vec_id in (0, 1, 2, 100)")
    assert len(h.histogram_topk(few).collect()) == 6
    assert h.histogram_topk(table.where("vec_id = 100")).count() == 0


def exact(q, x):
    s = sum(int(Fraction(a) * 1024 // 1) * int(Fraction(b) * 1024 // 1) for a, b in zip(q, x, strict=True))
    return min(max(s, -(1 << 63)), (1 << 63) - 1)


def test_products_beyond_doubles():
    x = np.array([[2.0**30, 3.0], [2.0**10, 1.0], [0.1, -0.1], [1e306, -1e-300], [-1.7e308, 1.0], [5e-324, -5e-324]])
    assert h.products(x, x).tolist() == [[exact(a, b) for b in x.tolist()] for a in x.tolist()]
    assert h.scores_of(h.ordered(np.array([-(1 << 63), -1, 0, (1 << 63) - 1]))).tolist() == [-(1 << 63), -1, 0, (1 << 63) - 1]


def test_topk_of_very_large_and_small_components(spark):
    r = np.random.default_rng(5)
    big = [(k, (r.normal(size=3) * s).tolist()) for k, s in enumerate([1e306, 2.0**21, 2.0**20, 2.0**19, 1e12, 1.0, 1e-3, 1e-320] * 12)]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(3)
    want = collections.Counter()
    for q, v in big[::8]:
        best = sorted(((-exact(v, x), i) for i, x in big if i != q))[:4]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert collections.Counter(map(tuple, h.histogram_topk(table, k=4, divisor=8).collect())) == want


def brute(x, ids, k, divisor):
    out = {}
    for q in [i for i in range(len(ids)) if ids[i] % divisor == 0]:
        s = cosines(x[q : q + 1], x)[0]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return out


def test_nearest(spark, table):
    got = collections.defaultdict(list)
    for r in sorted(nearest(table).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    x = np.concatenate([vectors().astype(float), vectors()[150:151].astype(float)])
    want = brute(x, np.array([*range(1500), 150]), 5, 50)
    assert set(got) == set(want)
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert right >= 0.9 * 5 * len(want)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len(rows) == 5 and q not in {i for i, _ in rows}
    assert got[1100] == want[1100]  # one of very many copies: ties go to the smallest ids
    assert nearest(table.limit(0)).count() == 0
    assert len(nearest(table.where("vec_id in (0, 1, 2)")).collect()) == 2


def test_nearest_prunes_clustered_vectors(spark):
    """At least nine tenths of the neighbours from under half the parts; parts without queries aren't read; pieces of any size give the same."""
    r = np.random.default_rng(11)
    x = (r.normal(size=(64, 16))[r.integers(0, 64, 6000)] + 0.15 * r.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    rows = nearest(df).collect()
    want = brute(x.astype(float), np.arange(len(x)), 5, 50)
    found = {(row.query_id, row.vec_id) for row in rows}
    right = sum((q, i) in found for q, w in want.items() for i, _ in w)
    assert right >= 0.9 * 5 * len(want) and len(rows) == 5 * len(want)
    assert rows[0].probes < rows[0].parts / 2 and rows[0].recall >= 0.9


def test_pieces_of_parts_make_no_difference(spark, table, monkeypatch):
    want = sorted(map(tuple, nearest(table).collect()))
    monkeypatch.setattr(lp, "PIECE_LEAST", 37)
    monkeypatch.setattr(lp, "PIECE_ROWS", 37)
    monkeypatch.setattr(lp, "PIECE_QUERIES", 5)
    assert sorted(map(tuple, nearest(table).collect())) == want


def test_parts_without_queries_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 8, 0) for i in range(64)], "vec_id long, embedding array<double>, part int, piece int")
    rows.write.partitionBy("part").parquet(str(tmp_path / "index"))
    index = spark.read.schema(rows.schema).parquet(str(tmp_path / "index"))
    sent = spark.createDataFrame([(0, [1.0, 1.0], 3), (50, [1.0, 0.0], 5)], "query_id long, embedding array<double>, part int")
    found = lp._met(index, sent, [1] * 8, 2, 3)
    assert {r.vec_id % 8 for r in found.where("query_id = 0").collect()} == {3} and found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ (IN|INSET) \(?3,5", plan)


def test_nearest_of_very_large_and_small_components(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 4))
    size = np.array([1e-170, 1.0, 1e160, 1e-310, 1e300] * 12)
    x = base * size[:, None]
    x[0] = [1e-170, 2e-170, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for row in sorted(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), divisor=5).collect(), key=lambda y: y["rank"]):
        got[row.query_id].append((row.vec_id, row.score))
    true = x / size[:, None]
    cos = (true @ true.T) / np.sqrt((true * true).sum(1)[:, None] * (true * true).sum(1)[None])
    for q, found in got.items():
        assert len(found) == 5 and all(abs(s - cos[q, i]) < (1e-9 if size[q] > 1e-300 and size[i] > 1e-300 else 1e-2) for i, s in found)
    assert len(got) == 12


def test_parts_are_balanced_and_routed():
    x = unit(vectors(3000, 8, 0).astype(float))
    part = balanced_parts(x, neighbours(x, np.arange(len(x)), 10), 16)
    assert np.bincount(part, minlength=16).max() <= np.ceil(1.1 * len(x) / 16)
    router = fitted(x)
    assert 1 <= router.probes < router.b2.size
