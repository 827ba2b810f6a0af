"""The registered queries: name -> callable (spark, sf_dir). Money leaves as doubles."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billstream.config import POLICY, RULES, load_policy, load_rules
from billstream.functions.expressions import gross_amount_in, invoice_number_in, normalized_amount
from billstream.operators import decide, history, learning, ledger, matching, outbound, parties, reminders, reports, workflow
from billstream.plans.fixtures import AGAIN, AS_OF, LATER, decisions_on, fixture, many_rules
from billstream.session import append, committed, compact, drop_folded, kept, scratch
from billstream.session import stored as stored_rows
from billstream.sources import bank, invoices as documents
from billstream.streaming import approvals as approving
from billstream.streaming import intake

QUERIES = {}
TODAY = date.fromisoformat(AS_OF)


def query(f):
    QUERIES[f.__name__] = f
    return f


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes))


def records(spark: SparkSession, sf_dir: str, view: str = "fx_invoice") -> DataFrame:
    """The view as invoice records."""
    null = lambda name: F.lit(None).cast("string").alias(name)
    return fixture(spark, sf_dir, view, lines=True).select(
        "arrival", "k", F.lit("UBL").alias("format"), F.lit("purchase").alias("direction"), "invoice_number", F.col("issue_date").cast("string").alias("issue_date"), null("due_date"), F.lit("EUR").alias("currency"),
        F.struct(F.col("supplier_name").alias("name"), F.col("supplier_siren").alias("siren"), null("vat_number"), null("email"), F.col("supplier_iban").alias("iban")).alias("supplier"),
        F.struct(F.col("customer_name").alias("name"), null("siren"), null("vat_number"), null("email"), null("address")).alias("customer"),
        "lines", null("raw_text"), "net_amount", "vat_amount", "gross_amount", F.lit(False).alias("needs_manual_extraction"), F.col("bank_changed").alias("supplier_bank_details_changed"),
        F.when(F.col("vat_uncertain"), "uncertain").alias("vat_treatment"), null("source_file"), null("source_path"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decided(records(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the invoices table: the decided first arrivals."""
    return decide.accepted(decide.decided(records(spark, sf_dir, "fx_invoice0")))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.approvals(stored(spark, sf_dir), fixture(spark, sf_dir, "fx_decision"))


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.invoices_after(stored(spark, sf_dir), fixture(spark, sf_dir, "fx_decision"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name and, for nine of ten, an e-mail address."""
    email = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales invoices as stored, numbered by year."""
    rows = fixture(spark, sf_dir, "fx_outbound").drop("customer_name", "customer_email").withColumn("gross_amount", F.round(F.col("net_amount") * F.lit(1.2).cast("decimal(3,2)"), 2).cast("decimal(18,2)"))
    return outbound.numbered(rows.withColumn("year", F.year("issue_date")))


# Decisions


@query
def fingerprints(spark, sf_dir):
    return decide.fingerprinted(records(spark, sf_dir)).select("arrival", "fingerprint")


@query
def duplicates(spark, sf_dir):
    return decide.duplicates_marked(records(spark, sf_dir)).where("duplicate").select("arrival", "fingerprint")


@query
def account_rules(spark, sf_dir):
    return plain(decide.proposed(records(spark, sf_dir)).select("arrival", "proposal.*"))


@query
def findings(spark, sf_dir):
    return decisions(spark, sf_dir).select("arrival", F.explode("findings").alias("f")).select("arrival", "f.*")


@query
def risk_scores(spark, sf_dir):
    return decisions(spark, sf_dir).select("arrival", "risk_score")


@query
def invoice_decisions(spark, sf_dir):
    return plain(decisions(spark, sf_dir).select("arrival", "fingerprint", "status", "risk_score", F.col("proposal.account").alias("account"), F.col("proposal.confidence").alias("confidence"), "payment_authorized", "human_review_required"))


@query
def invoices_accepted(spark, sf_dir):
    rows = decide.accepted(decisions(spark, sf_dir))
    again = documents.from_raw_json(F.col("raw_json"))
    return plain(rows.withColumn("raw_number", again.getField("invoice_number")).withColumn("raw_lines", F.size(again.getField("lines"))).drop("raw_json", "source_file", "source_path", "due_date"))


@query
def audit_events(spark, sf_dir):
    return decide.audit_events(decisions(spark, sf_dir)).unionByName(workflow.approval_events(approvals(spark, sf_dir)))


@query
def reviews_open(spark, sf_dir):
    return decide.reviews(decisions(spark, sf_dir))


@query
def dashboard_kpis(spark, sf_dir):
    return reports.dashboard_kpis(after(spark, sf_dir))


@query
def latest_invoices(spark, sf_dir):
    return reports.latest_invoices(after(spark, sf_dir))


def _file(spark, name: str, content) -> str:
    """A JSON file with that content."""
    path = scratch(spark, name)
    spark.createDataFrame([(json.dumps(content, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


@query
def account_rules_from_file(spark, sf_dir):
    """The rules in the opposite order, from a file."""
    path = _file(spark, "rules", [{"keywords": r.keywords, "account": r.account, "confidence": float(r.confidence)} for r in RULES[::-1]])
    return plain(decide.proposed(records(spark, sf_dir), rules=load_rules(spark, path)).select("arrival", "proposal.*"))


@query
def decisions_by_policy_file(spark, sf_dir):
    """Stricter thresholds, from a file."""
    path = _file(spark, "policy", {"version": "1", "thresholds": {"rounding_tolerance": 0.01, "accounting_confidence": 0.92, "reminder_days": list(POLICY.reminder_days)}})
    return decide.decided(records(spark, sf_dir), policy=load_policy(spark, path)).select("arrival", "status", "risk_score")


@query
def account_rules_many(spark, sf_dir):
    return plain(decide.proposed(records(spark, sf_dir), rules=many_rules()).select("arrival", "proposal.*"))


@query
def fingerprints_known(spark, sf_dir):
    """What the first two of three batches have, by buckets and filter; the first is folded into a snapshot."""
    folder, path = scratch(spark, "history"), scratch(spark, "fingerprints")
    decide.fingerprinted(records(spark, sf_dir)).select("k", "fingerprint").write.parquet(path)
    rows = spark.read.parquet(path)
    for batch in range(3):
        if batch == 2:
            history.compact_history(spark, folder, 1)
        history.remember(rows.where(F.col("k") % 3 == batch), folder, batch)
    return history.known(rows, folder, 2).distinct()


# Learning and workflow


@query
def learned_mappings(spark, sf_dir):
    return learning.learned(approvals(spark, sf_dir))


@query
def learned_top_account(spark, sf_dir):
    top = learning.top_accounts(learning.learned(approvals(spark, sf_dir)))
    return plain(top.withColumn("confidence", decide.learned_confidence(F.col("validations"))))


@query
def account_proposals(spark, sf_dir):
    top = learning.top_accounts(learning.learned(approvals(spark, sf_dir)))
    return plain(decide.proposed(records(spark, sf_dir), top).select("arrival", "proposal.*"))


@query
def account_proposals_asof(spark, sf_dir):
    asks = fixture(spark, sf_dir, "fx_invoice0").where("supplier_name is not null").select("supplier_name", "arrival", (F.col("arrival") * 10 - 5).alias("seq"))
    return learning.top_accounts_asof(approvals(spark, sf_dir), asks)


@query
def invoices_after_decisions(spark, sf_dir):
    return after(spark, sf_dir).select("id", "status", "approved_account", "approved_by", "rejected_by", "rejection_reason")


@query
def reviews_resolved(spark, sf_dir):
    open_ = decide.reviews(decide.decided(records(spark, sf_dir, "fx_invoice0")))
    return workflow.reviews_after(open_, fixture(spark, sf_dir, "fx_decision"))


@query
def decisions_unknown(spark, sf_dir):
    """Decisions put aside, as there is no such invoice: every other id names one of twice its value."""
    given = fixture(spark, sf_dir, "fx_decision").withColumn("invoice_id", F.when(F.col("invoice_id") % 4 == 0, F.col("invoice_id") * 2).otherwise(F.col("invoice_id")))
    return workflow.unknown_decisions(stored(spark, sf_dir), given).select("invoice_id", "seq", "action", "username")


@query
def ledger_entries(spark, sf_dir):
    return plain(ledger.ledger_entries(after(spark, sf_dir)))


@query
def ledger_balance(spark, sf_dir):
    return plain(ledger.unbalanced(ledger.ledger_entries(after(spark, sf_dir))))


@query
def ledger_months(spark, sf_dir):
    """The entries exported by month, of which one is exported again, with another journal. They are stored, so that neither export makes them anew, nor the sample for its ranges."""
    path, kept, entries = scratch(spark, "ledger"), scratch(spark, "entries"), ledger.ledger_entries(after(spark, sf_dir))
    entries.write.parquet(kept, compression="zstd")
    entries = spark.read.schema(entries.schema).parquet(kept)
    ledger.write_ledger_months(entries, path)
    ledger.write_ledger_months(entries.where(F.substring("Date", 1, 7) == AGAIN).withColumn("Journal", F.lit("AC2")), path)
    number = lambda c: F.col(c).cast("double").alias(c)
    return ledger.read_ledger_months(spark, path).select("Date", "Journal", "Compte", "Libelle", number("Debit"), number("Credit"), "Piece", "month")


# Parties


@query
def suppliers_snapshot(spark, sf_dir):
    """Suppliers stored as deltas of four batches, in order of arrival; the first three are folded into snapshots, and removed."""
    rows, table = records(spark, sf_dir), scratch(spark, "suppliers")
    most = rows.agg(F.max(F.when(F.col("arrival") < LATER, F.col("arrival")))).first()[0] or 0
    rows = rows.withColumn("batch", F.when(F.col("arrival") >= LATER, 3).otherwise(F.floor(F.col("arrival") * 3 / (most + 1))))
    fold = lambda x: parties.of_deltas(x, "supplier").drop("risk_level")
    for batch in range(4):
        append(parties.delta(rows.where(F.col("batch") == batch), "supplier"), table, batch)
        if batch in (1, 2):
            compact(spark, table, intake.DELTAS["supplier"], fold)
            drop_folded(spark, table)
    return parties.of_deltas(stored_rows(spark, table, intake.DELTAS["supplier"]), "supplier")


@query
def suppliers_merged(spark, sf_dir):
    return parties.suppliers(records(spark, sf_dir))


@query
def customers_merged(spark, sf_dir):
    return parties.customers(records(spark, sf_dir))


@query
def bank_detail_changes(spark, sf_dir):
    return parties.bank_detail_changes(records(spark, sf_dir))


@query
def customers_sorted(spark, sf_dir):
    return customers(spark, sf_dir).select("id", "name").orderBy("name", "id")


# Bank


@query
def bank_matches(spark, sf_dir):
    return plain(matching.bank_matches(fixture(spark, sf_dir, "fx_bank").withColumnRenamed("tx_id", "id"), stored(spark, sf_dir)))


def _bank_file(spark, sf_dir) -> str:
    """The bank lines as CSV files; every seventh has no number for an amount."""
    path = scratch(spark, "bank_csv")
    amount = F.when(F.col("tx_id") % 7 == 0, "n/a").otherwise(F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")))
    fixture(spark, sf_dir, "fx_bank").select(F.lit("2026-08-20").alias("date"), F.col("tx_id").cast("string").alias("libelle"), amount.alias("montant"), "reference").write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query
def bank_rows_rejected(spark, sf_dir):
    return bank.read_bank_csv(spark, _bank_file(spark, sf_dir))[1].drop("record")


@query
def bank_csv_quoted(spark, sf_dir):
    """Labels with commas, quotes and line breaks, amounts with a decimal comma, all in quotes."""
    path, k = scratch(spark, "bank_csv"), F.col("tx_id").cast("string")
    label = F.when(F.col("tx_id") % 4 == 0, F.concat(F.lit('VIR "client", n '), k)).when(F.col("tx_id") % 4 == 1, F.concat(F.lit("ligne 1\nligne 2, "), k)).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    rows = fixture(spark, sf_dir, "fx_bank").select(F.lit("2026-08-20").alias("date"), label.alias("libelle"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")).alias("montant"), "reference")
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return plain(bank.read_bank_csv(spark, path)[0])


@query
def bank_csv_mixed(spark, sf_dir):
    """A folder of statements of two banks, with other names and in another order of columns; one gives no currency."""
    path, rows = scratch(spark, "bank_csv"), fixture(spark, sf_dir, "fx_bank")
    put = lambda df: df.write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    label, amount = F.col("tx_id").cast("string"), F.col("amount").cast("string")
    put(rows.where("tx_id % 2 = 0").select(F.lit("2026-08-20").alias("date"), label.alias("libelle"), F.replace(amount, F.lit("."), F.lit(",")).alias("montant"), "reference"))
    put(rows.where("tx_id % 2 = 1").select(F.lit("CHF").alias("currency"), amount.alias("amount"), "reference", label.alias("label"), F.lit("2026-08-21").alias("booking_date")))
    return plain(bank.read_bank_folder(spark, path)[0])


@query
def bank_transactions_stored(spark, sf_dir):
    """Two imports of one file, the first of them retried: lines of two imports are two, those of a retry aren't."""
    good, _ = bank.read_bank_csv(spark, _bank_file(spark, sf_dir))
    table = scratch(spark, "bank_transactions")
    for batch in (1, 1, 2):
        append(good, table, batch)
    return plain(stored_rows(spark, table, f"{', '.join(f'{c} {t}' for c, t in good.dtypes)}, batch int"))


@query
def stream_bank_match(spark, sf_dir):
    lines = scratch(spark, "bank_lines")
    rows = fixture(spark, sf_dir, "fx_bank").withColumnRenamed("tx_id", "id")
    rows.write.parquet(lines)
    out = scratch(spark, "bank_matched")
    intake.match_stream(spark.readStream.schema(rows.schema).parquet(lines), stored(spark, sf_dir), out, scratch(spark, "stream")).awaitTermination()
    return plain(spark.read.parquet(out))


# Sales


@query
def outbound_invoices(spark, sf_dir):
    requests = fixture(spark, sf_dir, "fx_outbound").select("id", "customer_id", "issue_date", "net_amount")
    made, _ = outbound.sales_invoices(requests, customers(spark, sf_dir))
    return plain(made.select("id", "customer_id", "invoice_number", "issue_date", "due_date", "net_amount", "vat_amount", "gross_amount", "currency", "status"))


@query
def outbound_invoices_stored(spark, sf_dir):
    """Sales invoices stored in two batches, even ids first; the second's numbers go on from the first's."""
    requests = fixture(spark, sf_dir, "fx_outbound").select("id", "customer_id", "issue_date", "net_amount")
    table, sequences, schema = scratch(spark, "outbound_invoices"), None, "id long, customer_id long, invoice_number string, n long, gross_amount decimal(18,2), issue_date date, batch int"
    for batch in (0, 1):
        made, _ = outbound.sales_invoices(requests.where(F.col("id") % 2 == batch), customers(spark, sf_dir), sequences=sequences)
        append(made.select("id", "customer_id", "invoice_number", "n", F.col("gross_amount").cast("decimal(18,2)").alias("gross_amount"), "issue_date"), table, batch)
        sequences = outbound.sequences_after(stored_rows(spark, table, schema).withColumn("year", F.year("issue_date")))
    return plain(stored_rows(spark, table, schema).drop("n"))


@query
def outbound_numbers(spark, sf_dir):
    return sales(spark, sf_dir).select("id", "n", "invoice_number")


@query
def sequences_next(spark, sf_dir):
    return outbound.sequences_after(sales(spark, sf_dir))


@query
def overdue_outbound(spark, sf_dir):
    return reminders.overdue(sales(spark, sf_dir), customers(spark, sf_dir), TODAY).select("id", "invoice_number", "due_date", "customer_name", "customer_email").orderBy("due_date", "id")


@query
def reminder_drafts(spark, sf_dir):
    return reminders.reminder_drafts(reminders.overdue(sales(spark, sf_dir), customers(spark, sf_dir), TODAY))[0]


@query
def reminders_stored(spark, sf_dir):
    """The drafts, stored; the batch is tried twice."""
    drafts, table = reminder_drafts(spark, sf_dir), scratch(spark, "reminders")
    for _ in range(2):
        append(drafts, table, "run")
    return stored_rows(spark, table, drafts.schema).drop("batch")


@query
def reminders_without_address(spark, sf_dir):
    return reminders.reminder_drafts(reminders.overdue(sales(spark, sf_dir), customers(spark, sf_dir), TODAY))[1].select("id", "invoice_number", "due_date")


@query
def reminder_levels(spark, sf_dir):
    return reminders.reminder_levels(reminders.overdue(sales(spark, sf_dir), customers(spark, sf_dir), TODAY), TODAY).select("id", "days_late", "reminder_level")


@query
def due_schedule(spark, sf_dir):
    return plain(reports.due_schedule(fixture(spark, sf_dir, "fx_outbound"), TODAY))


@query
def amount_bands(spark, sf_dir):
    return plain(reports.amount_bands(fixture(spark, sf_dir, "fx_invoice")))


@query
def retention_filter(spark, sf_dir):
    return reports.retained(fixture(spark, sf_dir, "fx_invoice"), date(2004, 1, 1)).select("arrival", "issue_date")


# Text


@query
def text_invoice_number(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_text").select("k", invoice_number_in(F.col("text")).alias("invoice_number"))


@query
def text_gross_amount(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_text").select("k", gross_amount_in(F.col("text")).alias("gross_amount"))


@query
def normalize_amount(spark, sf_dir):
    text = F.regexp_extract("text", ": ([0-9,.]+) EUR$", 1)
    return fixture(spark, sf_dir, "fx_text").select("k", normalized_amount(text).alias("amount"))


@query
def src_invoice_text(spark, sf_dir):
    return documents.invoice_text(fixture(spark, sf_dir, "fx_text"))


# Files


@query
def src_invoice_json(spark, sf_dir):
    path = scratch(spark, "invoice_json")
    records(spark, sf_dir).drop("arrival", "k").write.json(path)
    return plain(documents.read_json(spark, path).select("invoice_number", "issue_date", "currency", F.col("supplier.name").alias("supplier_name"), "net_amount", "vat_amount", "gross_amount", F.size("lines").alias("n_lines")))


def _xml(spark, sf_dir) -> DataFrame:
    """Documents: UBL for two of three invoices, CII for the third."""
    rows = fixture(spark, sf_dir, "fx_invoice0")
    tag = lambda name, value, prefix="cbc:": F.concat(F.lit(f"<{prefix}{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{prefix}{name}>"))
    c = F.col
    number = F.when(c("invoice_number").isNotNull(), tag("ID", c("invoice_number"))).otherwise("")
    ubl = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Invoice xmlns="urn:test:ubl" xmlns:cbc="urn:test:cbc" xmlns:cac="urn:test:cac">'), number, tag("IssueDate", c("issue_date")), tag("DocumentCurrencyCode", F.lit("EUR")),
        F.lit("<cac:AccountingSupplierParty>"), tag("RegistrationName", c("supplier_name")), F.lit("</cac:AccountingSupplierParty><cac:AccountingCustomerParty>"), tag("RegistrationName", c("customer_name")), F.lit("</cac:AccountingCustomerParty>"),
        tag("TaxAmount", c("vat_amount")), tag("TaxExclusiveAmount", c("net_amount")), tag("PayableAmount", c("gross_amount")), F.lit("</Invoice>"),
    )
    ram = lambda name, value: tag(name, value, "ram:")
    cii = F.concat(
        F.lit('<rsm:CrossIndustryInvoice xmlns:rsm="urn:test:rsm" xmlns:ram="urn:test:ram"><ram:Guideline><ram:ID>urn:guideline</ram:ID></ram:Guideline><rsm:ExchangedDocument>'), ram("ID", c("invoice_number")),
        F.lit("<ram:IssueDateTime>"), ram("DateTimeString", F.date_format("issue_date", "yyyyMMdd")), F.lit("</ram:IssueDateTime></rsm:ExchangedDocument><ram:SellerTradeParty>"), ram("Name", c("supplier_name")),
        F.lit("</ram:SellerTradeParty><ram:BuyerTradeParty>"), ram("Name", c("customer_name")), F.lit("</ram:BuyerTradeParty>"), ram("InvoiceCurrencyCode", F.lit("EUR")), ram("TaxBasisTotalAmount", c("net_amount")),
        ram("TaxTotalAmount", c("vat_amount")), ram("GrandTotalAmount", c("gross_amount")), F.lit("</rsm:CrossIndustryInvoice>"),
    )
    return rows.select("k", F.when((c("k") % 3 == 0) & c("invoice_number").isNotNull(), cii).otherwise(ubl).alias("xml"))


@query
def src_invoice_xml(spark, sf_dir):
    read, _ = documents.invoice_xml(_xml(spark, sf_dir))
    return plain(read.select("k", "format", "invoice_number", "issue_date", "currency", F.col("supplier.name").alias("supplier_name"), F.col("customer.name").alias("customer_name"), "net_amount", "vat_amount", "gross_amount"))


@query
def xml_rejected(spark, sf_dir):
    """Documents put aside: every fifth is cut off, every seventh has a second root."""
    k, xml = F.col("k"), F.col("xml")
    rows = _xml(spark, sf_dir).withColumn("xml", F.when(k % 5 == 0, F.substring(xml, F.lit(1), F.length(xml) - 5)).when(k % 7 == 0, F.concat(xml, F.lit("<more/>"))).otherwise(xml))
    return documents.invoice_xml(rows)[1].select("k")


@query
def invoice_format_tag(spark, sf_dir):
    read, _ = documents.invoice_xml(_xml(spark, sf_dir))
    return read.groupBy("format").agg(F.count("*").alias("n"))


def _files(spark, sf_dir) -> DataFrame:
    """The documents as files of several kinds and encodings: k, content, source_file, source_path. Every seventh can't be decoded, every eleventh is cut off. They are stored, so that no reader makes them anew."""
    k = F.col("k")
    name = F.regexp_replace("xml", "</(cbc:RegistrationName|ram:Name)>", " é</$1>")
    encoding = F.when(k % 7 == 0, "UTF-8").otherwise(F.element_at(F.array(*map(F.lit, ("UTF-8", "ISO-8859-1", "UTF-16", "windows-1252"))), (k % 4 + 1).cast("int")))
    text = F.concat(F.lit('<?xml version="1.0" encoding="'), F.col("encoding"), F.lit('"?>'), F.regexp_replace("named", r"^<\?xml[^>]*\?>", ""))
    latin = F.encode("text", "ISO-8859-1")
    euro = F.unhex(F.replace(F.hex(latin), F.lit("20E9"), F.lit("20E980")))
    content = F.when((k % 7 == 0) | (F.col("encoding") == "ISO-8859-1"), latin).when(F.col("encoding") == "UTF-16", F.encode("text", "UTF-16")).when(F.col("encoding") == "windows-1252", euro).otherwise(F.encode("text", "UTF-8"))
    rows = _xml(spark, sf_dir).withColumn("named", name).withColumn("encoding", encoding).withColumn("text", text).withColumn("content", content)
    rows = rows.withColumn("content", F.when(k % 11 == 0, F.substring("content", F.lit(1), F.length("content") - 6)).otherwise(F.col("content")))
    extension = F.element_at(F.array(*map(F.lit, (".pdf", ".XML", ".ubl", ".Cii", ".txt", ""))), (F.floor(k / 4) % 6 + 1).cast("int"))
    source = F.concat(F.lit("doc"), k.cast("string"), extension)
    rows, path = rows.select("k", "content", source.alias("source_file"), F.concat(F.lit("file:/in/"), source).alias("source_path")), scratch(spark, "files")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query
def src_xml_encodings(spark, sf_dir):
    read, _ = documents.invoice_xml(documents.decoded_xml(_files(spark, sf_dir)))
    return plain(read.select("k", F.col("supplier.name").alias("supplier_name"), "gross_amount"))


@query
def ingest_records(spark, sf_dir):
    return plain(documents.ingested(_files(spark, sf_dir)).records.select("k", "source_file", "source_path", "format", "invoice_number", F.col("supplier.name").alias("supplier_name"), "gross_amount"))


@query
def ingest_rejects(spark, sf_dir):
    return documents.ingested(_files(spark, sf_dir)).rejects


@query
def ingest_waiting(spark, sf_dir):
    return documents.ingested(_files(spark, sf_dir)).waiting


@query
def src_bank_csv(spark, sf_dir):
    path = scratch(spark, "bank_csv")
    rows = fixture(spark, sf_dir, "fx_bank")
    rows.select(F.lit("2026-08-20").alias("date"), F.col("tx_id").cast("string").alias("libelle"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")).alias("montant"), "reference").write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    good, _ = bank.read_bank_csv(spark, path)
    return plain(good)


@query
def route_by_extension(spark, sf_dir):
    extension = F.element_at(F.array(*map(F.lit, (".pdf", ".XML", ".ubl", ".Cii", ".txt", ""))), (F.col("k") % 6 + 1).cast("int"))
    return documents.routed(fixture(spark, sf_dir, "fx_invoice0").select("k", F.concat(F.lit("doc"), F.col("k").cast("string"), extension).alias("source_file")))


@query
def write_outbound_xml(spark, sf_dir):
    requests = fixture(spark, sf_dir, "fx_outbound").select("id", "customer_id", "issue_date", "net_amount").withColumn("description", F.lit("Prestation"))
    made, _ = outbound.sales_invoices(requests, customers(spark, sf_dir))
    names = {"number": "ID", "due": "DueDate", "buyer": "BuyerName", "payable": "PayableAmount"}
    back = F.from_xml("xml", ", ".join(f"{n} string" for n in names.values()), {"ignoreSurroundingSpaces": "false"})
    return outbound.invoice_xml(made).select("id", back.alias("x")).select("id", *(F.coalesce(F.col("x")[n], F.lit("")).alias(c) for c, n in names.items()))


def _arriving(spark, sf_dir, rows=None):
    """A folder of the invoices as compressed JSON files, as many as there are partitions: once with the first half by arrival, then with the other added, which is made from the invoices that come again only. rows: records() that are stored already."""
    path = scratch(spark, "arriving")
    for later, view in ((False, "fx_invoice"), (True, "fx_invoice_later")):
        (records(spark, sf_dir, view) if rows is None else rows).drop("k").where((F.col("arrival") >= LATER) == later).write.mode("append").json(path, compression="gzip")
        yield path


@query
def stream_intake(spark, sf_dir):
    target, checkpoint = scratch(spark, "intake"), scratch(spark, "stream")
    for path in _arriving(spark, sf_dir):
        intake.intake(spark, path, target, checkpoint, files_per_batch=None).awaitTermination()
    return spark.read.parquet(f"{target}/decisions").select("arrival", "fingerprint", "status", "risk_score")


@query
def stream_intake_learned(spark, sf_dir):
    """Intake with the mappings that approvals taught, which come before the rules. The invoices are made once and stored, for the approvals and for both waves."""
    target, checkpoint, mappings = scratch(spark, "intake"), scratch(spark, "stream"), scratch(spark, "mappings")
    with kept(records(spark, sf_dir), scratch(spark, "invoices")) as rows:
        first = decide.fingerprinted(rows.where("arrival = k"))
        with intake.duplicates_sent(first) as found:
            taught = workflow.approvals(decide.accepted(decide.decided(first, found=found)), decisions_on(first))
            learning.learned(taught).write.parquet(mappings)
        for path in _arriving(spark, sf_dir, rows):
            intake.intake(spark, path, target, checkpoint, files_per_batch=None, mappings=mappings).awaitTermination()
    return plain(spark.read.parquet(f"{target}/decisions").select("arrival", "proposal.*"))


@query
def stream_intake_suppliers(spark, sf_dir):
    """The suppliers that intake stored, folded over its batches."""
    target, checkpoint = scratch(spark, "intake"), scratch(spark, "stream")
    for path in _arriving(spark, sf_dir):
        intake.intake(spark, path, target, checkpoint, files_per_batch=None).awaitTermination()
    return intake.parties_of(spark, target, "supplier")


def _first_taken_in(spark, sf_dir) -> str:
    """A folder with what intake stored of the first arrivals."""
    target = scratch(spark, "intake")
    intake.intake(spark, next(_arriving(spark, sf_dir)), target, scratch(spark, "stream"), files_per_batch=None).awaitTermination()
    return target


def _decided_on(spark, sf_dir, target: str) -> None:
    """Decisions on the stored invoices in two waves, rejections first; made once and stored."""
    path, checkpoint, made = scratch(spark, "decisions"), scratch(spark, "stream"), scratch(spark, "made")
    with kept(fixture(spark, sf_dir, "fx_decision"), made) as given:
        for action in ("reject", "approve"):
            given.where(F.col("action") == action).write.mode("append").json(path, compression="gzip")
            approving.decide(spark, path, target, checkpoint, files_per_batch=None).awaitTermination()


@query
def stream_decisions_invoices(spark, sf_dir):
    """The invoices that intake stored, as a stream of decisions left them."""
    target = _first_taken_in(spark, sf_dir)
    _decided_on(spark, sf_dir, target)
    return approving.invoices_of(spark, target).select("id", "status", "approved_account", "approved_by", "rejected_by", "rejection_reason")


@query
def stream_decisions_reviews(spark, sf_dir):
    target = _first_taken_in(spark, sf_dir)
    _decided_on(spark, sf_dir, target)
    return approving.reviews_of(spark, target)


@query
def stream_decisions_learned(spark, sf_dir):
    """Accounts for repeats that come after approvals, which taught them; first arrivals had the rules."""
    target, checkpoint = scratch(spark, "intake"), scratch(spark, "stream")
    for path in _arriving(spark, sf_dir):
        intake.intake(spark, path, target, checkpoint, files_per_batch=None, mappings=f"{target}/mappings").awaitTermination()
        if not committed(spark, f"{target}/mappings"):
            _decided_on(spark, sf_dir, target)
    return plain(spark.read.parquet(f"{target}/decisions").select("arrival", "proposal.*"))


DAYS = {"first": 0, "later": 5, "near": 0.5, "far": 10, "late": 1}


def _waves(spark, sf_dir):
    """Folders of invoices (k, wave and the fields) with event times: first arrivals, two thirds on the first day and one on the fifth; their repeats half a day after, ten days after, and late."""
    rows = fixture(spark, sf_dir, "fx_invoice", lines=True).select("arrival", "k", F.struct(F.col("supplier_name").alias("name"), F.col("supplier_siren").alias("siren")).alias("supplier"), "invoice_number", F.col("issue_date").cast("string").alias("issue_date"), "gross_amount", F.lit("EUR").alias("currency"))
    repeat, k = F.col("arrival") != F.col("k"), F.col("k")
    wave = F.when(~repeat & (k % 3 != 0), "first").when(~repeat, "later").when(k % 3 == 0, None).when(k % 2 == 0, "near").when(k % 5 != 0, "far").otherwise("late")
    day = F.create_map(*(F.lit(x) for w, d in DAYS.items() for x in (w, int(d * 86400))))
    rows = rows.withColumn("wave", wave).where("wave is not null").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + day[F.col("wave")]))
    path = scratch(spark, "waves")
    for w in ("first", "near", "later", "far", "late"):
        rows.where(F.col("wave") == w).write.mode("append").parquet(path)
        yield path, rows.schema


@query
def stream_dedup(spark, sf_dir):
    """Repeats within the watermark go, so do late rows; a repeat long after is forgotten and comes again."""
    out, checkpoint = scratch(spark, "deduplicated"), scratch(spark, "stream")
    for path, schema in _waves(spark, sf_dir):
        stream = spark.readStream.schema(schema).parquet(path)
        intake.recent_only(stream, "at").select("k", "wave", "fingerprint").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k long, wave string, fingerprint string").parquet(out)
