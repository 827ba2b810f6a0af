"""Readers, writers and the stream."""

import json
import re

import pytest
from pyspark.sql import functions as F

from billstream.config import POLICY, RULES, load_policy, load_rules
from billstream.operators import parties
from billstream.operators.decide import decided
from billstream.plans.registry import records
from billstream.session import append, scratch, stored
from billstream.sources.bank import read_bank_csv
from billstream.sources.invoices import invoice_text, invoice_xml, read_json, read_xml, routed
from billstream.streaming.intake import intake, parties_of

SF = "/root/testdata/sf0.001"
UBL = '<Invoice xmlns="u" xmlns:b="v"><b:ID> N1 </b:ID><b:IssueDate>2026-01-02</b:IssueDate><b:AccountingSupplierParty><b:RegistrationName>S</b:RegistrationName></b:AccountingSupplierParty><b:TaxExclusiveAmount>10.5</b:TaxExclusiveAmount><b:PayableAmount>bad</b:PayableAmount></Invoice>'
CII = '<r:CrossIndustryInvoice xmlns:r="r"><r:G><r:ID>urn:guide</r:ID></r:G><r:ExchangedDocument><r:ID>C1</r:ID></r:ExchangedDocument></r:CrossIndustryInvoice>'


def documents(spark, *xml):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "k int, xml string")


def test_xml(spark):
    good, bad = invoice_xml(documents(spark, UBL, CII, "﻿" + UBL, '<?xml version="1.0"?>\n<!-- c -->' + UBL))
    rows = {r.k: r for r in good.collect()}
    assert bad.count() == 0 and set(rows) == {0, 1, 2, 3}
    assert (rows[0].format, rows[0].invoice_number, rows[0].issue_date, rows[0].supplier.name, str(rows[0].net_amount), str(rows[0].gross_amount), rows[0].currency) == ("UBL", "N1", "2026-01-02", "S", "10.50", "0.00", "EUR")
    assert (rows[1].format, rows[1].invoice_number) == ("CII", "C1")
    assert invoice_xml(documents(spark, CII), legacy_id_order=True)[0].first().invoice_number == "urn:guide"


@pytest.mark.parametrize("xml", ["<a><b>", UBL + "x", UBL + UBL, "<a>&nope;</a>", "<!DOCTYPE a><a/>", "plain", "", None])
def test_broken_xml_is_put_aside(spark, xml):
    good, bad = invoice_xml(documents(spark, xml, UBL))
    assert [r.k for r in good.collect()] == [1] and [r.k for r in bad.collect()] == [0]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text(UBL)
    r = read_xml(spark, f"{tmp_path}/x").first()
    assert r.source_file == "a.xml" and r.source_path.endswith("/x/a.xml") and r.xml == UBL
    (tmp_path / "j.json").write_text(json.dumps({"invoice_number": "1", "net_amount": 1.5, "supplier": {"name": "S"}}) + "\n{broken\n")
    rows = read_json(spark, f"{tmp_path}/j.json").cache()
    assert {(r.invoice_number, r._corrupt_record) for r in rows.collect()} == {("1", None), (None, "{broken")}
    names = spark.createDataFrame([(n,) for n in ("a.PDF", "b.xml", "c.Ubl", "d.cii", "e.txt", "f", None)], "source_file string")
    assert [r.route for r in routed(names).collect()] == ["pdf", "xml", "xml", "xml", "rejected", "rejected", "rejected"]


def test_bank_csv(spark, tmp_path):
    (tmp_path / "bank.csv").write_bytes("﻿date,libelle,montant\n2026-08-20,VIR,\"-120,00\"\n2026-08-21,bad,1 234\n2026-08-22,none,\n".encode())
    good, bad = read_bank_csv(spark, f"{tmp_path}/bank.csv")
    assert [tuple(map(str, r)) for r in good.collect()] == [("2026-08-20", "VIR", "-120.00", "EUR", ""), ("2026-08-22", "none", "0.00", "EUR", "")]
    assert [r.amount for r in bad.collect()] == ["1 234"]


def test_text(spark):
    rows = spark.createDataFrame([("FACTURE n° A1 Total TTC : 1 234,56",), ("  \n",), (None,)], "text string")
    got = [(r.invoice_number, r.gross_amount, r.format, r.needs_manual_extraction) for r in invoice_text(rows).collect()]
    assert got == [("A1", 1234.56, "PDF_TEXT", False), (None, 0.0, "PDF_IMAGE", True), (None, 0.0, "PDF_IMAGE", True)]


def test_stream_equals_batch(spark, tmp_path):
    rows = records(spark, SF).drop("k")
    for later in (False, True):
        rows.where((F.col("arrival") >= 100_000_000) == later).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        intake(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out/decisions").select("arrival", "fingerprint")
    assert streamed.count() == rows.count() and streamed.exceptAll(decided(rows).select("arrival", "fingerprint")).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/invoices").count() == 1473


def test_restarted_intake_with_learned_accounts_and_parties(spark, tmp_path):
    """The second batch runs again, as if the stream had broken off before it was noted: nothing is lost or there twice."""
    rows = records(spark, SF).drop("k")
    suppliers = [r.name for r in rows.select("supplier.name").where("name is not null").distinct().orderBy("name").limit(3).collect()]
    spark.createDataFrame([(s, "6064", 9) for s in suppliers] + [(suppliers[0], "606", 8)], "supplier_name string, account string, validations long").write.parquet(f"{tmp_path}/learned")
    for later in (False, True):
        rows.where((F.col("arrival") >= 100_000_000) == later).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run = lambda: intake(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", mappings=f"{tmp_path}/learned").awaitTermination()
    run()
    tables = ("decisions", "invoices", "audit_events", "reviews", "fingerprints", "suppliers", "customers")
    count = lambda: {t: spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in tables}
    before = count()
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    for folder in (tmp_path / "out" / "reviews").glob(f"batch={last.name}/_SUCCESS"):
        folder.unlink()  # and this table's try was not whole
    run()
    assert count() == before and before["decisions"] == rows.count()
    got = spark.read.parquet(f"{tmp_path}/out/decisions").join(rows.select("arrival", "supplier.name"), "arrival")
    learned = got.where("proposal.source = 'learning'").collect()
    assert {r.name for r in learned} == set(suppliers) and {r.proposal.account for r in learned} == {"6064"} and {str(r.proposal.confidence) for r in learned} == {"0.99"}
    assert got.where(F.col("name").isin(suppliers) & (F.col("proposal.source") != "learning")).count() == 0
    for party, whole in (("supplier", parties.suppliers(rows)), ("customer", parties.customers(rows))):
        folded = parties_of(spark, f"{tmp_path}/out", party)
        assert folded.columns == whole.columns and sorted(map(str, folded.collect())) == sorted(map(str, whole.collect()))


def test_append_and_stored(spark, tmp_path):
    table, rows = f"{tmp_path}/table", spark.createDataFrame([(1,), (2,)], "id long")
    assert stored(spark, table, "id long, batch int").count() == 0
    with pytest.raises(Exception, match="broken"):
        append(rows.withColumn("id", F.when(F.col("id") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long")), table, 1)
    assert append(rows, table, 1) and not append(rows.limit(0), table, 1) and append(rows, table, 2)
    assert sorted(map(tuple, stored(spark, table, "id long, batch int").collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_policy_and_rules_from_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "thresholds": {"accounting_confidence": 0.9, "reminder_days": [30, 2], "bank_match_amount_tolerance": 0.1, "high_amount_eur": 10, "other": 1}, "retention_years": 6}))
    policy = load_policy(spark, f"{tmp_path}/p.json")
    assert (str(policy.accounting_confidence), policy.reminder_days, str(policy.match_tolerance), policy.high_amount, policy.retention_years) == ("0.9", (2, 30), "0.1", 10, 6)
    assert (policy.rounding_tolerance, policy.critical_amount) == (POLICY.rounding_tolerance, POLICY.critical_amount)
    (tmp_path / "r.json").write_text(json.dumps([{"keywords": r.keywords, "account": r.account, "confidence": float(r.confidence)} for r in RULES], ensure_ascii=False))
    assert load_rules(spark, f"{tmp_path}/r.json") == RULES
    (tmp_path / "e.json").write_text("{}")
    assert load_policy(spark, f"{tmp_path}/e.json") == POLICY


def test_no_scratch_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(), "x")


def test_each_document_is_parsed_once(spark):
    """Both the filter and the fields take one parse; there is no XPath, which parses for each expression."""
    good, bad = invoice_xml(documents(spark, UBL, CII, "x"))
    for rows in (good, bad, good.groupBy("format").count()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "xpath" not in plan and len(set(re.findall(r"run\(xml#\d+\)#\d+", plan))) == 1 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("xml", "number"), [
    ("<I><ID> <![CDATA[N<1]]> </ID></I>", "N<1"), ("<I><ID/><ID>A<!-- c -->B</ID></I>", "A"), ("<I><ID> </ID><ID>B</ID></I>", ""), ("<x:I><y:ID>A &amp; &#233;</y:ID></x:I>", "A & é"),
    ("<I><a><ID><b>no</b>X</ID></a></I>", "X"), ("  <?xml version='1.0'?><I><c/></I>", None),
    ("<CrossIndustryInvoice><ID>g</ID><ExchangedDocument><a><ID>deep</ID></a><ID>own</ID></ExchangedDocument></CrossIndustryInvoice>", "own"),
])
def test_first_texts(spark, xml, number):
    good, bad = invoice_xml(documents(spark, xml))
    assert [r.invoice_number for r in good.collect()] == [number] and bad.count() == 0


@pytest.mark.parametrize("xml", ["<a/></w><w>", "<a/>&#1;", "<a b='1' b='2'/>", "<a/><!-- <!DOCTYPE -->", "<a/><?xml version='1.0'?>", "<a>]]></a>"])
def test_more_broken_xml(spark, xml):
    good, bad = invoice_xml(documents(spark, xml))
    assert good.count() == 0 and bad.count() == 1
