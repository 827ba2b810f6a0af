"""Registered queries against their SQL on the smallest tables, and known counts."""

import duckdb
import pytest

from billstream.plans.fixtures import TABLES
from billstream.plans.oracle import ORACLE
from billstream.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_have_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_decision_counts(spark):
    got = {r.status: (r.n, r.risk) for r in QUERIES["invoice_decisions"](spark, SF).groupBy("status").agg({"risk_score": "sum", "*": "count"}).toDF("status", "n", "risk").collect()}
    got = {k: tuple(sorted(v)) for k, v in got.items()}
    assert got == {"VALIDATED": (0, 1150), "REVIEW_REQUIRED": (323, 9830), "DUPLICATE": (89, 5050)}


def test_arriving_invoices_keep_their_partitions(spark, monkeypatch):
    from billstream.plans import registry

    rows = spark.range(60).selectExpr("id", "if(id % 2 = 0, id, id + 100000000) as arrival", "id as k").repartition(3)
    monkeypatch.setattr(registry, "records", lambda *_: rows)
    seen = [(path, len(spark.read.json(path).inputFiles()), spark.read.json(path).count()) for path in registry._arriving(spark, SF)]
    assert [s[1:] for s in seen] == [(3, 30), (6, 60)] and seen[0][0] == seen[1][0]
