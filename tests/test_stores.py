"""Encodings, quoted CSV, mixed folders, large rule sets, histories, snapshots and the stream of decisions."""

import csv
import hashlib
import io
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billstream.config import RULES, Rule
from billstream.operators import history, learning, ledger, parties, workflow
from billstream.operators.decide import CHAIN_KEYWORDS, decided, duplicates_marked, fingerprinted, first_rule, rule_proposal
from billstream.plans import registry
from billstream.plans.fixtures import fixture
from billstream.plans.registry import records
from billstream.session import append, committed, compact, drop_folded, stored
from billstream.sources.bank import read_bank_csv, read_bank_folder
from billstream.sources.invoices import BROKEN, UNKNOWN_FORMAT, UNREADABLE, ingest, ingested, read_json, read_xml
from billstream.streaming import approvals
from billstream.streaming.intake import DELTAS, arrivals, compact_intake, intake, intake_files, parties_of, stored_mappings

SF = "/root/testdata/sf0.001"
UBL = '<Invoice xmlns="u"><ID>N1</ID><AccountingSupplierParty><RegistrationName>{}</RegistrationName></AccountingSupplierParty><PayableAmount>10</PayableAmount></Invoice>'


def strings(df):
    return sorted(map(str, df.collect()))


# Files


def read_by_csv_module(path):
    """What a reader by the csv module makes of a file: rows with a number, and others' amounts."""
    good, bad = [], []
    for r in csv.DictReader(io.StringIO(path.read_bytes().decode("utf-8-sig"), newline="")):
        amount = (r.get("amount") or r.get("montant") or "0").replace(",", ".")
        row = (r.get("booking_date") or r.get("date"), r.get("label") or r.get("libelle"))
        try:
            good.append((*row, Decimal(amount).quantize(Decimal("0.01")), r.get("currency") or r.get("devise") or "EUR", r.get("reference") or ""))
        except ArithmeticError:
            bad.append(row)
    return good, bad


@pytest.mark.parametrize("mark", ["", "﻿"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_bank_csv(spark, tmp_path, mark, end):
    lines = ["date,libelle,montant,reference", '2026-08-20,"a\nb","12,50",r1', '2026-08-21,"x ""y"", z","7,00",', '"2026-08-22",plain,-3.5,"VIR, ""F1"""', "2026-08-23,no number,n/a,r", '2026-08-24,"",,', "2026-08-25,short", "2026-08-26,long,1,r,more,fields", '2026-08-27,back\\slash,"2",r', "", '"2026-08-28","  kept  ",4,r']
    (tmp_path / "bank.csv").write_bytes((mark + end.join(lines) + end).encode())
    good, bad = read_bank_csv(spark, f"{tmp_path}/bank.csv")
    want_good, want_bad = read_by_csv_module(tmp_path / "bank.csv")
    none = lambda rows: [tuple(x if x != "" or i == 4 else None for i, x in enumerate(r)) for r in rows]
    assert [tuple(r) for r in good.collect()] == none(want_good) and len(want_good) == 8
    assert [(r.booking_date, r.label) for r in bad.collect()] == want_bad == [("2026-08-23", "no number")]


def test_malformed_bank_rows_carry_their_text(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("date,amount,label\n2026-01-01,1\n2026-01-02,x,y,z\n2026-01-03,q,w\n")
    good, bad = read_bank_csv(spark, f"{tmp_path}/bank.csv")
    assert [str(r.amount) for r in good.collect()] == ["1.00"]
    assert [(r.amount, r.record) for r in bad.collect()] == [("x", "2026-01-02,x,y,z"), ("q", None)]


def test_bank_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("date,amount,label\n2026-01-01,1,x\n")
    (tmp_path / "in" / "b.csv").write_text("label,date,amount\nx,2026-01-01,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_bank_csv(spark, f"{tmp_path}/in")[0].collect()
    (tmp_path / "in" / "c 1.csv").write_text("\ufeffdate,amount,label\r\n2026-01-02,\"2,5\",\"y\nz\"\r\n2026-01-02,?,z\r\n")
    (tmp_path / "in" / "d[1]+%20.csv").write_text("montant\n3\n")
    good, bad = read_bank_folder(spark, f"{tmp_path}/in")
    assert sorted((str(r.booking_date), str(r.label), str(r.amount)) for r in good.collect()) == [("2026-01-01", "x", "1.00"), ("2026-01-01", "x", "1.00"), ("2026-01-02", "y\nz", "2.50"), ("None", "None", "3.00")]
    assert [(r.label, r.amount) for r in bad.collect()] == [("z", "?")]
    (tmp_path / "none").mkdir()
    nothing = read_bank_folder(spark, f"{tmp_path}/none")
    assert [x.columns for x in nothing] == [good.columns, bad.columns] and nothing[0].count() == nothing[1].count() == 0


NAME = "Société Générale"
ENCODED = {
    "utf8.xml": UBL.format(NAME).encode(),
    "marked.xml": ("﻿<?xml version='1.0' encoding='ISO-8859-1'?>" + UBL.format(NAME)).encode(),
    "latin.XML": ("<?xml version='1.0' encoding='ISO-8859-1'?>" + UBL.format(NAME)).encode("latin-1"),
    "latin9.ubl": ('<?xml version="1.0" encoding="iso-8859-15" standalone="yes"?>' + UBL.format(NAME)).encode("iso-8859-15"),
    "windows.cii": ('<?xml version="1.0"  encoding = "Windows-1252"?>\n' + UBL.format(NAME)).encode("cp1252"),
    "wide.xml": ("<?xml version='1.0' encoding='UTF-16'?>" + UBL.format(NAME)).encode("utf-16"),
    "wide_le.xml": ("<?xml version='1.0' encoding='UTF-16'?>" + UBL.format(NAME)).encode("utf-16-le"),
    "wide_be.xml": ("<?xml version='1.0' encoding='UTF-16'?>" + UBL.format(NAME)).encode("utf-16-be"),
    "wider.xml": ("<?xml version='1.0' encoding='UTF-32'?>" + UBL.format(NAME)).encode("utf-32"),
    "named_wide.xml": ("<?xml version='1.0' encoding='utf-16'?>" + UBL.format(NAME)).encode(),
}
BAD = {
    "bytes.xml": (UNREADABLE, UBL.format(NAME).encode("latin-1")),
    "odd.xml": (UNREADABLE, UBL.format(NAME).encode("utf-16") + b"<"),
    "lone.xml": (UNREADABLE, ("<?xml version='1.0' encoding='UTF-16'?>" + UBL.format("\ud800")).encode("utf-16", "surrogatepass")),
    "unknown.xml": (UNREADABLE, b"<?xml version='1.0' encoding='no-such'?>" + UBL.format("x").encode()),
    "cut.xml": (BROKEN, UBL.format(NAME).encode()[:-5]),
    "blank.ubl": (BROKEN, b" "),
    "note.txt": (UNKNOWN_FORMAT, b"x"),
    "none": (UNKNOWN_FORMAT, UBL.format("x").encode()),
}


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for i, (name, content) in enumerate([*ENCODED.items(), *((n, c) for n, (_, c) in BAD.items()), ("scan.PDF", b"%PDF-1.4")]):
        (tmp_path / ("deep/er" if i % 3 == 0 else "deep" if i % 3 == 1 else "") / name).write_bytes(content)
    got = ingest(spark, str(tmp_path))
    records_ = {r.source_file: r for r in got.records.collect()}
    assert set(records_) == set(ENCODED) and {r.supplier.name for r in records_.values()} == {NAME}
    assert all(r.source_path.startswith("file:") and r.source_path.endswith(f"/{n}") for n, r in records_.items())
    assert {r.source_file: r.reason for r in got.rejects.collect()} == {n: reason for n, (reason, _) in BAD.items()}
    assert [r.source_file for r in got.waiting.collect()] == ["scan.PDF"]
    empty = spark.createDataFrame([(bytearray(b""), "a.xml", 1), (None, "b.cii", 2), (None, None, 3), (bytearray(ENCODED["utf8.xml"]), "c.xml", 4)], "content binary, source_file string, route int")
    rest = ingested(empty)
    assert {(r.source_file, r.route, r.reason) for r in rest.rejects.collect()} == {("a.xml", 1, BROKEN), ("b.cii", 2, UNREADABLE), (None, 3, UNKNOWN_FORMAT)} and [r.route for r in rest.records.collect()] == [4]
    assert decided(got.records.withColumn("arrival", F.monotonically_increasing_id())).where("status <> 'DUPLICATE'").count() == 1
    plan = got.waiting._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan  # no bytes are read to put PDF files aside
    assert {r.source_file for r in read_xml(spark, str(tmp_path)).where("xml is null").collect()} == {n for n, (reason, _) in BAD.items() if reason == UNREADABLE}


def test_json_lineage_is_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"invoice_number": "1", "source_file": "elsewhere"}) + "\n{broken\n")
    rows = read_json(spark, f"{tmp_path}/a.json").select("invoice_number", "source_file", "source_path").collect()
    assert {(r.source_file, r.source_path.rsplit("/", 1)[1]) for r in rows} == {("a.json", "a.json")} and len(rows) == 2


# Rules


def first_of(text, rules):
    return next((i for i, r in enumerate(rules) if any(k.lower() in text for k in r.keywords)), None)


def test_many_rules_equal_the_chain(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 4)))
    rules = tuple(Rule(tuple(word().upper() if r.random() < 0.3 else word() for _ in range(r.randint(0, 3))), f"6 {i}", Decimal("0.90") if i % 2 else Decimal("0.60")) for i in range(60))
    texts = ["".join(r.choice("abcdeé ") for _ in range(r.choice([0, 1, 3, 12]))) for _ in range(300)] + [""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    assert {x.k: x.r for x in rows.select("k", first_rule(F.col("text"), rules).alias("r")).collect()} == {i: first_of(t, rules) for i, t in enumerate(texts)}
    few = rules[: CHAIN_KEYWORDS // 4]
    more = few + tuple(Rule((f"zz{i}",), "7", Decimal("0.90")) for i in range(CHAIN_KEYWORDS))
    both = rows.select("k", rule_proposal(F.col("text"), few).alias("chain"), rule_proposal(F.col("text"), more).alias("automaton")).collect()
    assert all(x.chain == x.automaton for x in both) and {x.chain.source for x in both} == {"rules", "none"}
    always = (*more, Rule(("",), "8", Decimal("0.70")), Rule(("a",), "9", Decimal("0.70")))
    assert {x.p.account for x in rows.select(rule_proposal(F.col("text"), always).alias("p")).collect()} >= {"8"} and rows.where(rule_proposal(F.col("text"), always).getField("source") == "none").count() == 0
    assert {x.p.source for x in rows.select(rule_proposal(F.col("text"), ()).alias("p")).collect()} == {"none"}


def test_default_rules_stay_a_chain(spark):
    plan = spark.range(1).select(rule_proposal(F.col("id").cast("string"), RULES).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# Duplicates


def test_one_pass_for_duplicates(spark):
    plan = registry.QUERIES["invoice_decisions"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_hot_fingerprints_are_dealt_out(spark):
    r = random.Random(6)
    rows = [(r.randrange(1000), "hot" if r.random() < 0.5 else f"n{r.randrange(40)}") for _ in range(600)] + [(None, "hot"), (None, "n1"), (None, "lost"), (None, "lost")]
    make = ("struct(n as name, cast(null as string) as siren) as supplier", "n as invoice_number", "'' as issue_date", "cast(1 as decimal(18,2)) as gross_amount", "'EUR' as currency")
    df = spark.createDataFrame(rows, "arrival long, n string").selectExpr("arrival", "n", *make)
    first = {}
    for a, n in rows:
        if a is not None:
            first[n] = min(first.get(n, a), a)
    want = sorted(str((a, n, n in first if a is None else a > first[n])) for a, n in rows)
    for parts in (1, 7, 200):
        assert sorted(str((x.arrival, x.n, x.duplicate)) for x in duplicates_marked(df, parts=parts).collect()) == want


# History


def fake(spark, names):
    return spark.createDataFrame([(hashlib.sha256(n.encode()).hexdigest(),) for n in names], "fingerprint string")


def test_history_reads_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path)
    for b in range(3):
        history.remember(fake(spark, [f"{b}-{i}" for i in range(500)]), folder, b)
        history.remember(fake(spark, ["again"]), folder, b)  # committed, so not written again
    asked = fake(spark, ["0-7", "1-400", "2-1", *(f"new{i}" for i in range(300))])
    hexed = lambda *n: {hashlib.sha256(x.encode()).hexdigest() for x in n}
    assert {r.fingerprint for r in history.known(asked, folder, 2).collect()} == hexed("0-7", "1-400")
    maybe = history.maybe_known(asked, folder, 2)
    assert maybe.count() < 10 and hexed("0-7", "1-400") <= {r.fingerprint for r in maybe.collect()}
    plan = history.in_buckets(spark, folder, 2, ["0a", "1e"])
    assert "PartitionFilters: [bucket" in plan._jdf.queryExecution().executedPlan().toString()
    files = {f.split("/bucket=")[1].split("/")[0] for f in plan.inputFiles()}
    assert len(files) > 2  # all that there are; the scan takes two of them:
    assert {r.b for r in plan.select(F.substring("fingerprint", 1, 2).alias("b")).distinct().collect()} <= {"0a", "1e"}
    before = history.known(asked, folder, 3).orderBy("fingerprint").collect()
    history.compact_history(spark, folder, 2)
    drop_folded(spark, f"{folder}/fingerprints")
    drop_folded(spark, f"{folder}/fingerprint_filter")
    assert history.known(asked, folder, 3).orderBy("fingerprint").collect() == before
    scans = [line for line in history.in_buckets(spark, folder, 3, ["0a", "1e"])._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [bucket" in line for line in scans)  # the snapshot's and the batches'
    assert history.known(fake(spark, []), folder, 3).count() == 0 and history.known(asked, f"{folder}/none", 3).count() == 0


# Snapshots


def test_snapshot_switch_and_crash(spark, tmp_path, monkeypatch):
    from billstream import session

    table, schema = f"{tmp_path}/t", "k long, n long, batch long"
    fold = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    total = lambda before=None: {r.k: r.n for r in fold(stored(spark, table, schema, before)).collect()}
    put = lambda b: append(spark.createDataFrame([(k, 1) for k in range(3)], "k long, n long"), table, b)
    assert not compact(spark, table, schema, fold)
    for b in range(4):
        assert put(b)
    # The write is done, the switch isn't: readers see the batches still.
    with monkeypatch.context() as m:
        m.setattr(session, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            compact(spark, table, schema, fold)
    assert total() == dict.fromkeys(range(3), 4) and session._snapshot(spark, table) is None
    with pytest.raises(Exception, match="broken"):
        compact(spark, table, schema, lambda rows: rows.select("k", F.raise_error(F.lit("broken")).cast("long").alias("n")))
    assert compact(spark, table, schema, fold) and not compact(spark, table, schema, fold)
    files = len(stored(spark, table, schema).inputFiles())
    assert total() == dict.fromkeys(range(3), 4) and total(before=2) == dict.fromkeys(range(3), 2)
    for b in range(4, 9):
        put(b)
    assert compact(spark, table, schema, fold) and len(stored(spark, table, schema).inputFiles()) <= files  # whatever the number of batches
    assert len(drop_folded(spark, table)) == 10 and drop_folded(spark, table) == []
    assert total() == dict.fromkeys(range(3), 9) and not put(3) and total() == dict.fromkeys(range(3), 9)
    assert put(9) and total() == dict.fromkeys(range(3), 10) and committed(spark, table) == [str(b) for b in range(10)]


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    table = f"{tmp_path}/t"
    assert append(spark.range(3), table, 1)
    spark.range(5).write.parquet(f"{table}/batch=2")  # whole, but its marker was never made
    assert stored(spark, table, "id long, batch int").count() == 3
    assert append(spark.range(4), table, 2) and stored(spark, table, "id long, batch int").count() == 7
    (tmp_path / "t" / "batch=1" / "_SUCCESS").unlink()  # stores without success files
    assert not append(spark.range(9), table, 1) and stored(spark, table, "id long, batch int").count() == 7


def lose_last_batch(checkpoint, target, *tables):
    """As if the stream had broken off in its last batch, before it was noted and before some tables were committed."""
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.parent / f".{last.name}.crc", *(target / t / "_committed" / last.name for t in tables)):
        p.unlink(missing_ok=True)


def test_compacted_intake_equals_batch_after_a_restart(spark, tmp_path):
    rows = records(spark, SF).drop("k").cache()
    parts = 5
    cuts = rows.approxQuantile("arrival", [i / parts for i in range(1, parts)], 0.0)
    for p, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 1e18], strict=True)):
        rows.where((F.col("arrival") > low) & (F.col("arrival") <= high)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        intake(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", compact_every=2).awaitTermination()
        if p in (2, 4):
            lose_last_batch(tmp_path / "ck", tmp_path / "out", "fingerprints", "suppliers")
            intake(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", compact_every=2).awaitTermination()
    compact_intake(spark, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out/decisions").select("arrival", "fingerprint", "status", "risk_score")
    assert strings(got) == strings(decided(rows).select("arrival", "fingerprint", "status", "risk_score"))
    for party, whole in (("supplier", parties.suppliers(rows)), ("customer", parties.customers(rows))):
        assert strings(parties_of(spark, f"{tmp_path}/out", party)) == strings(whole)
    assert len(stored(spark, f"{tmp_path}/out/suppliers", DELTAS["supplier"]).inputFiles()) < parts * 2


def test_files_that_arrive(spark, tmp_path):
    """Two waves of files; the second runs again, as if it had broken off. A copy of an invoice is a duplicate in whatever batch and encoding it comes."""
    document = lambda number, name: f"<Invoice><ID>{number}</ID><IssueDate>2026-01-02</IssueDate><AccountingSupplierParty><RegistrationName>{name}</RegistrationName></AccountingSupplierParty><PayableAmount>10</PayableAmount></Invoice>"
    (tmp_path / "in" / "a").mkdir(parents=True)
    run = lambda: intake_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    for i in range(6):
        (tmp_path / "in" / ("a" if i % 2 else "") / f"n {i}.xml").write_bytes((f"<?xml version='1.0' encoding='{('utf-8', 'iso-8859-1')[i % 2]}'?>" + document(f"F{i // 2}", NAME)).encode(("utf-8", "latin-1")[i % 2]))
    (tmp_path / "in" / "note.txt").write_text("x")
    (tmp_path / "in" / "scan.pdf").write_bytes(b"%PDF")
    run()
    for name, content in (("again.ubl", document("F1", NAME)), ("new.cii", document("F9", NAME)), ("broken.xml", "<a>"), ("other.pdf", "%PDF")):
        (tmp_path / "in" / "a" / name).write_text(content)
    run()
    lose_last_batch(tmp_path / "ck", tmp_path / "out", "reviews", "fingerprints", "waiting")
    run()
    read = lambda t: spark.read.parquet(f"{tmp_path}/out/{t}").collect()
    assert sorted((r.invoice_number, r.supplier_name) for r in read("invoices")) == [(f"F{i}", NAME) for i in (0, 1, 2, 9)]
    decisions = read("decisions")
    assert len(decisions) == len({r.arrival for r in decisions}) == 8 and sum(r.status == "DUPLICATE" for r in decisions) == 4
    assert max(r.arrival for r in decisions if r.batch == 0) < min(r.arrival for r in decisions if r.batch == 1)
    assert {(r.source_file, r.reason) for r in read("rejected")} == {("note.txt", UNKNOWN_FORMAT), ("broken.xml", BROKEN)}
    assert {r.source_file for r in read("waiting")} == {"scan.pdf", "other.pdf"}
    assert {r.source_file for r in read("invoices")} <= {*(f"n {i}.xml" for i in range(6)), "new.cii"}
    assert {r.invoice_id for r in read("reviews")} <= {r.arrival for r in decisions}


def test_arrivals_are_the_same_again(spark):
    files = spark.createDataFrame([(f"file:/in/{i % 90}", i) for i in range(100)], "source_path string, k int")
    one, two = (sorted((r.source_path, r.arrival) for r in arrivals(files.repartition(n), 3).collect()) for n in (1, 7))
    assert one == two and {a for _, a in one} == {(3 << 40) + i for i in range(1, 101)}
    assert arrivals(files.limit(0), 3).count() == 0


# The stream of decisions


def test_decision_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = records(spark, SF, "fx_invoice0").drop("k")
    rows.coalesce(2).write.json(f"{tmp_path}/in")
    target = f"{tmp_path}/out"
    intake(spark, f"{tmp_path}/in", target, f"{tmp_path}/ck", files_per_batch=None).awaitTermination()
    given = fixture(spark, SF, "fx_decision").select("invoice_id", "seq", "action", "account", "username", "reason")
    given = given.unionByName(spark.createDataFrame([(-5, 1, "approve", "6", "u", None), (10**12, 2, "reject", None, "u", "r")], given.schema)).cache()
    for third in (2, 0, 1):  # not in the order of seq
        given.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == third).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        approvals.decide(spark, f"{tmp_path}/log", target, f"{tmp_path}/ck2", compact_every=2).awaitTermination()
        if third != 2:
            lose_last_batch(tmp_path / "ck2", tmp_path / "out", "mappings", "decisions_unknown")
            approvals.decide(spark, f"{tmp_path}/log", target, f"{tmp_path}/ck2", compact_every=2).awaitTermination()
    invoices = approvals.stored_invoices(spark, target)
    assert strings(approvals.invoices_of(spark, target)) == strings(workflow.invoices_after(invoices, given).select(*approvals.invoices_of(spark, target).columns))
    taught = workflow.approvals(invoices, given)
    assert strings(stored_mappings(spark, f"{target}/mappings").select("supplier_name", "account", "validations")) == strings(learning.learned(taught))
    events = spark.read.parquet(f"{target}/approval_events")
    assert strings(events.drop("batch")) == strings(workflow.approval_events(taught))
    assert {r.invoice_id for r in spark.read.parquet(f"{target}/decisions_unknown").collect()} == {-5, 10**12}
    assert approvals.reviews_of(spark, target).where("resolved").count() == workflow.reviews_after(spark.read.parquet(f"{target}/reviews"), given).where("resolved").count() > 0


# The ledger by months


def test_months_are_exported_again_alone(spark, tmp_path):
    invoices = spark.createDataFrame([(i, f"2026-0{1 + i % 3}-15" if i != 7 else None, f"N{i}", "S;\"x\"", Decimal(i), Decimal(1), Decimal(i + 1), "APPROVED", "6", None) for i in range(12)], "id long, issue_date string, invoice_number string, supplier_name string, net_amount decimal(18,2), vat_amount decimal(18,2), gross_amount decimal(18,2), status string, approved_account string, proposed_account string")
    entries = ledger.ledger_entries(invoices)
    path = tmp_path / "ledger"
    ledger.write_ledger_months(entries, str(path))
    bytes_of = lambda month: sorted((p.name, p.read_bytes()) for p in (path / f"month={month}").glob("part-*"))
    before = {m: bytes_of(m) for m in ("2026-01", "2026-02", "2026-03", "__HIVE_DEFAULT_PARTITION__")}
    assert all(before.values())
    ledger.write_ledger_months(entries.where("Date like '2026-02%'").withColumn("Journal", F.lit("AC2")), str(path))
    after = {m: bytes_of(m) for m in before}
    assert {m for m in before if after[m] != before[m]} == {"2026-02"}
    rows = ledger.read_ledger_months(spark, str(path)).collect()
    assert len(rows) == 36 and {r.Journal for r in rows if r.month == "2026-02"} == {"AC2"} and {r.Libelle for r in rows} == {"S;\"x\"", "TVA déductible"}
    assert b"".join(c for _, c in after["2026-01"]).startswith(b"Date;Journal;Compte;Libelle;Debit;Credit;Piece\r\n")


def test_duplicates_found_and_joined_as_marked(spark):
    """A batch's duplicates by narrow rows, whether sent to the tasks or joined by a shuffle; an arrival may be null or there twice."""
    from billstream.operators.decide import _joined, duplicates_found

    given = [(1, "a"), (5, "a"), (None, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d"), (4, "e"), (None, "e"), (9, "f")]
    rows = spark.createDataFrame([(a, n, {"name": n}) for a, n in given], "arrival long, invoice_number string, supplier struct<name:string,siren:string>")
    rows = rows.withColumn("issue_date", F.lit("2026-01-01")).withColumn("gross_amount", F.lit(1).cast("decimal(18,2)")).withColumn("currency", F.lit("EUR"))
    known = fingerprinted(rows).where("invoice_number = 'f'").select("fingerprint")
    listed = lambda df: sorted(str((r.arrival, r.invoice_number, r.fingerprint, r.duplicate)) for r in df.collect())
    want = listed(duplicates_marked(rows, known))
    found = duplicates_found(fingerprinted(rows), known)
    assert listed(_joined(fingerprinted(rows), found)) == want == listed(_joined(fingerprinted(rows), F.broadcast(found))) and sum("True" in x for x in want) == 4


def test_arriving_files_are_compressed_and_stored_tables_too(spark, tmp_path, monkeypatch):
    from billstream.plans import registry

    monkeypatch.setattr(registry, "records", lambda *_: spark.range(4).selectExpr("id as arrival", "id as k"))
    assert all(f.endswith(".json.gz") for f in spark.read.json(next(registry._arriving(spark, ""))).inputFiles())
    append(spark.range(3).toDF("id"), f"{tmp_path}/t", 1)
    assert all(".zstd." in f for f in spark.read.parquet(f"{tmp_path}/t/batch=1").inputFiles())
