"""Golden cases of the invoice operators."""

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billstream.functions.expressions import invoice_number_in, normalized_amount, parsed_date
from billstream.operators import decide, learning, ledger, matching, outbound, parties, reminders, reports, workflow
from billstream.schemas import INVOICE

ARRIVING = T.StructType([T.StructField("arrival", T.LongType()), *INVOICE.fields])
MONEY = "decimal(18,2)"


def invoice(arrival=1, **given):
    base = {f.name: None for f in INVOICE.fields} | {
        "invoice_number": "SELFTEST-001", "issue_date": "2026-08-15", "currency": "EUR", "direction": "purchase", "lines": [{"description": "abonnement internet"}],
        "supplier": {"name": "Test Telecom", "siren": None, "vat_number": None, "email": None, "iban": None}, "net_amount": Decimal("100.00"), "vat_amount": Decimal("20.00"), "gross_amount": Decimal("120.00"),
    }
    return {"arrival": arrival} | base | given


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in ARRIVING.fields) for r in rows], ARRIVING)


def party(name, **given):
    return {"name": name, "siren": None, "vat_number": None, "email": None, "iban": None} | given


def test_first_is_validated_and_second_a_duplicate(spark):
    d = decide.decided(frame(spark, invoice(1), invoice(2)))
    first, second = d.orderBy("arrival").collect()
    assert (first.status, first.risk_score, first.proposal.account, first.proposal.confidence, first.proposal.source) == ("VALIDATED", 0, "626", Decimal("0.94"), "rules")
    assert (second.status, second.risk_score) == ("DUPLICATE", 50)
    assert not first.payment_authorized and second.human_review_required
    assert [r.id for r in decide.accepted(d).collect()] == [1]
    assert {r.invoice_id for r in decide.audit_events(d).collect()} == {1} and decide.reviews(d).count() == 0
    again = decide.decided(frame(spark, invoice(9)), history=decide.accepted(d)).first()
    assert again.status == "DUPLICATE"


@pytest.mark.parametrize(
    ("given", "codes", "risk"),
    [
        ({"supplier": None}, {"supplier"}, 20),
        ({"invoice_number": ""}, {"invoice_number"}, 20),
        ({"gross_amount": Decimal("120.02")}, set(), 0),
        ({"gross_amount": Decimal("120.03")}, {"totals"}, 30),
        ({"needs_manual_extraction": True}, {"manual"}, 25),
        ({"supplier_bank_details_changed": True, "vat_treatment": "uncertain"}, {"bank_change", "vat"}, 90),
        ({"lines": None, "raw_text": "Machine"}, {"account"}, 10),
        ({"lines": None, "supplier": None, "invoice_number": None, "needs_manual_extraction": True, "supplier_bank_details_changed": True, "net_amount": None, "vat_amount": Decimal("1.00")}, {"supplier", "invoice_number", "manual", "totals", "bank_change", "account"}, 100),
    ],
)
def test_findings(spark, given, codes, risk):
    r = decide.decided(frame(spark, invoice(**given))).first()
    assert {f.code for f in r.findings if not f.ok} == codes and r.risk_score == risk
    assert r.status == ("REVIEW_REQUIRED" if codes else "VALIDATED")


def test_messages(spark):
    r = decide.decided(frame(spark, invoice(lines=[{"description": None}, {"description": "rien"}]))).first()
    told = {f.code: f.message for f in r.findings}
    assert told["totals"] == "HT+TVA=120.00; TTC=120.00" and told["account"] == "Compte None — confiance 25%"


def test_rule_order_and_accents(spark):
    text = lambda t: decide.proposed(frame(spark, invoice(lines=[], raw_text=t))).first().proposal.account
    assert text("CONSEILLER internet") == "626" and text("conseiller") == "6226" and text("matériel") is None and text("MATERIEL") == "IMMOBILISATION_A_VERIFIER"


def test_learning_lowers_then_raises(spark):
    approved = lambda n: spark.createDataFrame([("Test Telecom", "626")] * n + [("", "626"), ("X", None), ("Other", "1"), ("Other", "0")], "supplier_name string, account string")
    for n, confidence, status in ((1, "0.83", "REVIEW_REQUIRED"), (2, "0.86", "VALIDATED"), (9, "0.99", "VALIDATED")):
        mappings = learning.learned(approved(n))
        top = {r.supplier_name: (r.account, r.validations) for r in learning.top_accounts(mappings).collect()}
        assert top == {"Test Telecom": ("626", n), "Other": ("0", 1)}
        r = decide.decided(frame(spark, invoice()), learned_top=learning.top_accounts(mappings)).first()
        assert (str(r.proposal.confidence), r.status, r.proposal.source) == (confidence, status, "learning")
    stored = learning.learned(approved(1))
    assert {r.validations for r in learning.learned(approved(2), stored).where("supplier_name = 'Test Telecom'").collect()} == {3}


def test_asof_sees_earlier_approvals_only(spark):
    approvals = spark.createDataFrame([("s", "b", 10), ("s", "a", 20), ("s", "b", 30)], "supplier_name string, account string, seq long")
    arrivals = spark.createDataFrame([("s", 1, 10), ("s", 2, 15), ("s", 3, 25), ("s", 4, 35), ("t", 5, 35)], "supplier_name string, arrival long, seq long")
    assert {r.arrival: (r.account, r.validations) for r in learning.top_accounts_asof(approvals, arrivals).collect()} == {2: ("b", 1), 3: ("a", 1), 4: ("b", 2)}


def test_asof_is_the_same_over_ranges(spark):
    import random

    r = random.Random(1)
    approvals = [("hot" if r.random() < 0.8 else "s", r.choice("abc"), r.randrange(1, 400)) for _ in range(150)]
    arrivals = [("hot" if r.random() < 0.8 else "t", k, r.randrange(1, 400)) for k in range(100)]
    want = {}
    for supplier, k, seq in arrivals:
        seen = [a for s, a, at in approvals if s == supplier and at < seq]
        if seen:
            want[k] = min((-seen.count(a), a) for a in seen)
    learned, asks = spark.createDataFrame(approvals, "supplier_name string, account string, seq long"), spark.createDataFrame(arrivals, "supplier_name string, arrival long, seq long")
    for size in (1, 30, 1000):
        got = learning.top_accounts_asof(learned, asks, range_seq=size).collect()
        assert len(got) == len(want) and {r.arrival: (-r.validations, r.account) for r in got} == want


def test_approve_then_reject(spark):
    d = decide.decided(frame(spark, invoice(1, lines=[])))
    decisions = spark.createDataFrame([(1, 1, "approve", "6064", "ann", None), (1, 2, "reject", None, "bob", "montant"), (9, 3, "approve", None, "ann", None)], "invoice_id long, seq long, action string, account string, username string, reason string")
    r = workflow.invoices_after(decide.accepted(d), decisions).first()
    assert (r.status, r.approved_account, r.approved_by, r.rejected_by, r.rejection_reason) == ("REJECTED", "6064", "ann", "bob", "montant")
    (review,) = workflow.reviews_after(decide.reviews(d), decisions).collect()
    assert (review.resolved, review.resolution, review.resolved_by) == (True, "APPROVED", "ann")
    approved = workflow.approvals(decide.accepted(d), decisions)
    (event,) = workflow.approval_events(approved).collect()
    assert (event.event, event.details) == ("approved", '{"account":"6064"}')
    assert [r.invoice_id for r in workflow.unknown_decisions(decide.accepted(d), decisions).collect()] == [9]


def test_parties_fold(spark):
    rows = [
        invoice(1, supplier=party("A", siren="1")), invoice(2, supplier=party("A", iban="FR1", email="")), invoice(3, supplier=party("A", siren=None, email=None)), invoice(4, supplier=party("")), invoice(5, supplier=None),
        invoice(6, supplier=party("B", iban="X")), invoice(7, supplier=party("B", iban="Y")), invoice(8, supplier=party("B")), invoice(9, supplier=party("B", iban="Y")),
    ]
    whole = {r.name: (r.siren, r.email, r.iban) for r in parties.suppliers(frame(spark, *rows)).collect()}
    assert whole == {"A": ("1", "", None), "B": (None, None, "X")}
    half = parties.suppliers(frame(spark, *rows[:3]))
    assert {r.name: (r.siren, r.email, r.iban) for r in parties.suppliers(frame(spark, *rows[3:]), half).collect()} == whole
    assert [(r.arrival, r.previous_iban) for r in parties.bank_detail_changes(frame(spark, *rows)).collect()] == [(7, "X")]


def test_bank_detail_changes_are_the_same_over_ranges(spark):
    import random

    r = random.Random(2)
    rows = [invoice(k, supplier=party("hot" if r.random() < 0.8 else "B", iban=r.choice([None, "X", "Y", "Z"]))) for k in range(1, 121)]
    last, want = {}, set()
    for x in rows:
        name, iban = x["supplier"]["name"], x["supplier"]["iban"]
        if iban:
            if last.get(name, iban) != iban:
                want.add((x["arrival"], name, iban, last[name]))
            last[name] = iban
    for size in (1, 10, 1000):
        got = parties.bank_detail_changes(frame(spark, *rows), range_arrivals=size).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_bank_match_by_bucket_equals_the_plain_join(spark):
    t = spark.range(400).select("id", (F.pmod(F.xxhash64("id"), F.lit(4000)) / 100 - 20).cast(MONEY).alias("amount"), F.concat(F.lit("VIR N"), F.col("id").cast("string")).alias("reference"))
    i = spark.range(300).select("id", F.concat(F.lit("N"), F.col("id").cast("string")).alias("invoice_number"), F.when(F.col("id") % 50 != 0, (F.pmod(F.xxhash64(F.col("id") + 7), F.lit(2000)) / 100).cast(MONEY)).alias("gross_amount"), F.lit("VALIDATED").alias("status"))
    got = matching.bank_matches(t, i)
    want = t.withColumnRenamed("id", "transaction_id").crossJoin(i.withColumnRenamed("id", "invoice_id")).where("abs(abs(amount) - coalesce(gross_amount, 0)) <= 0.02")
    key = lambda df: sorted((r.transaction_id, r.invoice_id) for r in df.collect())
    assert key(got) == key(want) and got.count() > 50
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    one = spark.createDataFrame([(1, Decimal("-120.00"), "UBL-2026-001", None), (2, Decimal("120.00"), "x", 5)], f"id long, amount {MONEY}, reference string, matched_invoice_id long")
    for number, confidence in (("SELFTEST-001", "0.82"), ("UBL-2026-001", "0.97"), ("", "0.82"), (None, "0.82")):
        stored = spark.createDataFrame([(7, number, Decimal("120.00"), "APPROVED"), (8, number, Decimal("120.00"), "REVIEW_REQUIRED"), (9, number, Decimal("-120.00"), "APPROVED")], f"id long, invoice_number string, gross_amount {MONEY}, status string")
        (r,) = matching.bank_matches(one, stored).collect()
        assert (r.transaction_id, r.invoice_id, str(r.confidence)) == (1, 7, confidence)


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame(
        [(2, "2026-01-02", "N2", "S", Decimal("10.00"), Decimal("2.00"), Decimal("12.00"), "", "", "APPROVED"), (1, "2026-01-01", "N1", None, Decimal("1.00"), Decimal("0.20"), Decimal("1.25"), "6064", "626", "APPROVED"), (3, "2026-01-01", "N3", "S", Decimal("1.00"), Decimal("0.20"), Decimal("1.20"), None, "626", "VALIDATED")],
        f"id long, issue_date string, invoice_number string, supplier_name string, net_amount {MONEY}, vat_amount {MONEY}, gross_amount {MONEY}, approved_account string, proposed_account string, status string",
    )
    entries = ledger.ledger_entries(rows)
    assert entries.count() == 6 and {r.Compte for r in entries.where("pos = 0").collect()} == {"6064", "A_VERIFIER"}
    assert [r.id for r in ledger.unbalanced(entries).collect()] == [1]
    ledger.write_ledger(entries, f"{tmp_path}/ledger")
    (file,) = (tmp_path / "ledger").glob("*.csv")
    lines = file.read_bytes().split(b"\r\n")
    assert lines[0] == "﻿Date;Journal;Compte;Libelle;Debit;Credit;Piece".encode() and lines[1].startswith(b"2026-01-01;ACH;6064;;1.00;0.00;N1") and len(lines) == 8


def test_large_ledgers_stay_in_parts(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "0 as pos", "date_add(date'2026-01-01', cast(id as int)) as Date", "'ACH' as Journal", "'401' as Compte", "'' as Libelle", "0 as Debit", "0 as Credit", "'' as Piece")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ledger.write_ledger(rows, f"{tmp_path}/ledger")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p.read_text(newline="").split("\r\n")[1:-1] for p in sorted((tmp_path / "ledger").glob("*.csv"))]
    dates = [line[:10] for p in parts for line in p]
    assert len(parts) > 1 and len(dates) == 40 and dates == sorted(dates)


def test_numbers_have_no_gaps(spark):
    requests = spark.range(250).select("id", (2025 + F.col("id") % 2).cast("int").alias("year"))
    sequences = spark.createDataFrame([("SALES-2025", 40)], "name string, current_value long")
    out = outbound.numbered(requests, sequences, range_rows=20)
    got = {y: sorted(r.n for r in out.where(F.col("year") == y).collect()) for y in (2025, 2026)}
    assert got == {2025: list(range(41, 166)), 2026: list(range(1, 126))}
    assert out.where("id = 0").first().invoice_number == "F2025-00041"
    assert {r.name: r.current_value for r in outbound.sequences_after(out).collect()} == {"SALES-2025": 165, "SALES-2026": 125}


def test_sales_and_reminders(spark):
    customers = spark.createDataFrame([(1, "C & Co", "c@x"), (2, "D", None)], "id long, name string, email string")
    requests = spark.createDataFrame([(1, 1, Decimal("2.675")), (2, 2, Decimal("10.00")), (3, 9, Decimal("1.00"))], "id long, customer_id long, net_amount decimal(18,3)").withColumn("description", F.lit("x"))
    made, unknown = outbound.sales_invoices(requests.withColumn("net_amount", F.col("net_amount").cast(MONEY)), customers, date(2026, 1, 1))
    assert [r.id for r in unknown.collect()] == [3]
    r = made.orderBy("id").first()
    assert (str(r.net_amount), str(r.vat_amount), str(r.gross_amount), r.due_date, r.invoice_number) == ("2.68", "0.54", "3.22", date(2026, 1, 31), "F2026-00001")
    xml = outbound.invoice_xml(made).orderBy("id").first().xml
    assert "<BuyerName>C &amp; Co</BuyerName>" in xml and "<PayableAmount>3.22</PayableAmount>" in xml
    late = reminders.overdue(made.drop("customer_name"), customers, date(2026, 2, 10))
    drafts, rejected = reminders.reminder_drafts(late)
    (d,) = drafts.collect()
    assert d.subject == "Rappel — facture F2026-00001 arrivée à échéance" and "d'un montant de 3.22 EUR,\néchue le 2026-01-31" in d.body and rejected.count() == 1
    assert {r.reminder_level for r in reminders.reminder_levels(late, date(2026, 2, 10)).collect()} == {2}
    assert reminders.overdue(made.drop("customer_name"), customers, date(2026, 1, 31)).count() == 0


def test_reports(spark):
    none = spark.createDataFrame([], "status string, payment_status string")
    assert tuple(reports.dashboard_kpis(none).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize(("text", "value"), [("1 234,56", 1234.56), ("1.234,56", 1234.56), ("1,234.56", 1.23456), ("1,234,567", 0), ("1.234.567", 0), ("120.00.", 0), ("120,00.", 120), ("1’234,50", 1234.5), (None, 0), ("", 0)])
def test_amounts(spark, text, value):
    assert spark.createDataFrame([(text,)], "x string").select(normalized_amount(F.col("x"))).first()[0] == value


@pytest.mark.parametrize(("text", "number"), [("FACTURE n° F2026-00001", "F2026-00001"), ("facture du 12/03", "du"), ("Invoice #: AB-9", "AB-9"), ("rien", None), ("FACTURE n° X1", "X1"), ("FACTURE\nNuméro : X", "um")])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "x string").select(invoice_number_in(F.col("x"))).first()[0] == number


def test_dates(spark):
    df = spark.createDataFrame([("2026-08-15",), ("20260815",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(parsed_date(F.col("x"))).collect()] == [date(2026, 8, 15), date(2026, 8, 15), None, None]


def test_written_xml_is_made_and_read_once(spark):
    """Four fields of a document take one reading of it, not one each."""
    from billstream.plans.registry import QUERIES

    rows = QUERIES["write_outbound_xml"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and plan.count("from_xml") + plan.count("xmltostructs") == 1 and plan.count("to_xml") + plan.count("structstoxml") == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_decided_makes_searched_text_and_findings_once(spark):
    """The text is one expression for all keywords, lines aren't dealt out where nobody asks for them, and no filter has the findings in it."""
    from billstream.operators import decide
    from billstream.plans.registry import records

    decisions = decide.decided(records(spark, "/root/testdata/sf0.001"))
    for rows in (decide.audit_events(decisions), decide.reviews(decisions), decide.accepted(decisions)):
        plan = _plan(rows)
        assert "transform(" not in plan and not [x for x in plan.split("\n") if re.search(r"\bFilter\b.*FOURNISSEURS", x)]
    top = _plan(decide.audit_events(decisions)).split("Window")[0]
    assert "lines#" not in top


def test_searched_text(spark):
    from billstream.operators.decide import searched_text

    rows = spark.createDataFrame([(0, [("Ab",), (None,), None, ("É",)], "X"), (1, None, None), (2, [], "y")], "k int, lines array<struct<description:string>>, raw_text string")
    assert [r.t for r in rows.orderBy("k").select(searched_text().alias("t")).collect()] == ["ab   é x", " ", " y"]


def test_ledger_months_reads_stored_entries(spark, monkeypatch):
    from billstream.operators import ledger
    from billstream.plans.registry import QUERIES

    seen, write = [], ledger.write_ledger_months
    monkeypatch.setattr(ledger, "write_ledger_months", lambda entries, path: (seen.append(entries.inputFiles()), write(entries, path))[1])
    QUERIES["ledger_months"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("/entries-" in f for files in seen for f in files)
