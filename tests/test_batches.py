"""What a batch of the streams reads, deals out and keeps."""

import hashlib
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from billstream.operators import history, learning, workflow
from billstream.operators.decide import duplicates_marked, fingerprinted
from billstream.plans import registry
from billstream.plans.fixtures import LATER, decisions_on, fixture
from billstream.plans.registry import records
from billstream.session import kept
from billstream.streaming import approvals
from billstream.streaming.intake import intake

SF = "/root/testdata/sf0.001"


def fake(spark, names):
    return spark.createDataFrame([(hashlib.sha256(n.encode()).hexdigest(),) for n in names], "fingerprint string")


def test_intake_caches_narrow_rows_only(spark, tmp_path, monkeypatch):
    """Decided rows are written to a folder for the batch, which goes with it; a cache of them builds columns of ten thousand rows in memory."""
    frame, seen = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: seen.append(set(self.columns)) or persist(self, *a))
    records(spark, SF).drop("k").write.json(f"{tmp_path}/in")
    intake(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", mappings=f"{tmp_path}/none").awaitTermination()
    assert seen and not any(c & {"lines", "supplier", "findings", "proposal"} for c in seen)
    assert not list((tmp_path / "out" / "_decided").iterdir())


def test_kept_rows_go_with_their_block(spark, tmp_path):
    for broken in (False, True):
        try:
            with kept(spark.range(5).selectExpr("id", "array(struct(id as a)) as x"), f"{tmp_path}/k") as rows:
                assert rows.count() == 5 and rows.schema["x"].dataType.elementType.names == ["a"]
                if broken:
                    raise ValueError
        except ValueError:
            assert broken
        assert not (tmp_path / "k").exists()


@pytest.mark.parametrize("sent", [0, 10**6])
def test_duplicates_of_repeated_hashes_equal_marked(spark, monkeypatch, sent):
    from billstream.streaming import intake as module

    monkeypatch.setattr(module, "SENT_DUPLICATES", sent)
    r = random.Random(3)
    rows = spark.createDataFrame([(i if i % 50 else None, f"n{r.randrange(600)}" if i % 3 else "hot") for i in range(900)], "arrival long, invoice_number string")
    rows = rows.selectExpr("arrival", "invoice_number", "struct('s' as name, '' as siren) as supplier", "'' as issue_date", "cast(1 as decimal(18,2)) as gross_amount", "'EUR' as currency")
    known = fingerprinted(rows).where("invoice_number like 'n1%'").select("fingerprint").distinct()
    of = lambda df: sorted(str((x.fingerprint, x.arrival)) for x in df.collect())
    with module.duplicates_sent(fingerprinted(rows), lambda names: names.select("fingerprint").distinct().join(known, "fingerprint", "left_semi")) as found:
        assert of(found) == of(duplicates_marked(rows, known).where("duplicate").select("fingerprint", "arrival").distinct())


def test_stored_fingerprints_are_filtered_before_they_are_dealt_out(spark, tmp_path):
    history.remember(fake(spark, [f"{i}" for i in range(5000)]), str(tmp_path), 0)
    asked = fake(spark, ["7", "8", *(f"new{i}" for i in range(200))])
    known = history.known(asked, str(tmp_path), 1)
    assert {r.fingerprint for r in known.collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in ("7", "8")}
    steps = known._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in steps
    bits = history._filter(history._bucketed(asked))
    assert history.let_through(history.in_buckets(spark, str(tmp_path), 1, [f"{i:02x}" for i in range(256)]), bits).count() < 10
    assert "LocalRelation <empty>" in history.known(asked, str(tmp_path), 0)._jdf.queryExecution().optimizedPlan().toString()


def below(plan, marker):
    """The steps below the first one with the marker."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if marker in x)
    deep = lines[at].index("Exchange")
    return [x for i, x in enumerate(lines) if i > at and all(len(y) - len(y.lstrip(" :+-")) > deep for y in lines[at + 1 : i + 1])]


def test_wide_rows_are_not_dealt_out_by_customer(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = records(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "collect_list" in plan and not any("collect_list" in x for x in below(plan, "Exchange hashpartitioning(o_custkey"))


def test_later_arrivals_are_made_of_few_lines(spark):
    of = lambda df: sorted(map(str, df.where(F.col("arrival") >= LATER).collect()))
    later = records(spark, SF, "fx_invoice_later")
    assert of(later) == of(records(spark, SF)) != []
    assert "% 17" in [x for x in later._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "l_orderkey" in x][0]


def test_decisions_meet_the_invoices_once(spark, tmp_path, monkeypatch):
    """One job of a batch reads the stored invoices; what becomes of the decisions is made from its rows, and the folder of these goes."""
    invoices = spark.createDataFrame([(i, f"S{i % 2}", "60") for i in range(6)], "id long, supplier_name string, proposed_account string")
    frame, joins = type(invoices), []
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **k: joins.append(a[-1]) or join(self, *a, **k))
    monkeypatch.setattr(approvals, "stored_invoices", lambda *_: invoices)
    given = [(1, 1, "approve", "61", "u", None), (1, 2, "reject", None, "v", "r"), (2, 3, "approve", "", "u", None), (77, 4, "approve", None, "u", None), (None, 5, "reject", None, "u", None)]
    decisions = spark.createDataFrame(given, "invoice_id long, seq long, action string, account string, username string, reason string")
    decisions.coalesce(1).write.json(f"{tmp_path}/in")
    approvals.decide(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert len(joins) == 1 and not list((tmp_path / "out" / "_met").iterdir())
    of = lambda df: sorted(map(str, df.drop("batch").collect()))
    read = lambda t: spark.read.parquet(f"{tmp_path}/out/{t}")
    taught = workflow.approvals(invoices, decisions)
    assert of(read("decision_states")) == of(workflow.folded(decisions.where("invoice_id < 6")))
    assert of(read("approval_events")) == of(workflow.approval_events(taught))
    assert of(read("mappings")) == of(learning.learned(taught))
    assert of(read("decisions_unknown")) == of(workflow.unknown_decisions(invoices, decisions).select(*decisions.columns)) and read("decisions_unknown").count() == 2


def test_decisions_are_made_of_even_invoices(spark):
    plan = fixture(spark, SF, "fx_decision")._jdf.queryExecution().optimizedPlan().toString()
    assert any("l_orderkey" in x and "% 2) = 0" in x for x in plan.splitlines() if "Filter" in x)


def test_invoices_are_made_once_for_learned_intake(spark, monkeypatch):
    """The tables are read for one view of the invoices; decisions on what is stored are those of the fixture."""
    views = []
    make = registry.fixture
    monkeypatch.setattr(registry, "fixture", lambda s, d, view, **k: views.append(view) or make(s, d, view, **k))
    monkeypatch.setattr(registry.intake, "intake", lambda *a, **k: views.append("intake") or type("Done", (), {"awaitTermination": lambda self: None})())
    monkeypatch.setattr(registry, "plain", lambda df: df)
    with pytest.raises(AnalysisException):  # as nothing is taken in
        registry.stream_intake_learned(spark, SF)
    assert views == ["fx_invoice", "intake", "intake"]
    of = lambda df: sorted(map(str, df.collect()))
    assert of(decisions_on(records(spark, SF, "fx_invoice0"))) == of(fixture(spark, SF, "fx_decision"))
