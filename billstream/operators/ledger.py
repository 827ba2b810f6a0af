"""Accounting entries of approved invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billstream.functions.expressions import if_filled

#: Journal, VAT and supplier accounts, labels.
JOURNAL, VAT_ACCOUNT, SUPPLIER_ACCOUNT, VAT_LABEL, NO_ACCOUNT = "ACH", "44566", "401", "TVA déductible", "A_VERIFIER"
HEADER = ["Date", "Journal", "Compte", "Libelle", "Debit", "Credit", "Piece"]

CSV = {"sep": ";", "header": True, "lineSep": "\r\n", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def ledger_entries(invoices: DataFrame) -> DataFrame:
    """id, pos and the columns of HEADER: three entries for each approved invoice."""
    zero = F.lit(0).cast("decimal(18,2)")
    account = F.coalesce(if_filled(F.col("approved_account")), if_filled(F.col("proposed_account")), F.lit(NO_ACCOUNT))

    def entry(account, label, debit, credit):
        return F.struct(account.alias("Compte"), label.alias("Libelle"), debit.alias("Debit"), credit.alias("Credit"))

    entries = F.array(
        entry(account, F.col("supplier_name"), F.col("net_amount"), zero),
        entry(F.lit(VAT_ACCOUNT), F.lit(VAT_LABEL), F.col("vat_amount"), zero),
        entry(F.lit(SUPPLIER_ACCOUNT), F.col("supplier_name"), zero, F.col("gross_amount")),
    )
    rows = invoices.where("status = 'APPROVED'").select("id", "issue_date", "invoice_number", F.posexplode(entries).alias("pos", "e"))
    return rows.select("id", "pos", F.col("issue_date").alias("Date"), F.lit(JOURNAL).alias("Journal"), "e.*", F.col("invoice_number").alias("Piece"))


def write_ledger(entries: DataFrame, path: str, bom: bool = True, one_file: bool = False) -> None:
    """The entries as CSV in the order of date, invoice and position: semicolons, CRLF, a header, whose first name carries the byte order mark if asked for. one_file merges the sorted parts for small exports; large ones stay in ordered parts."""
    rows = entries.orderBy("Date", "id", "pos").select(*HEADER)
    rows = rows.coalesce(1) if one_file else rows
    if bom:
        rows = rows.withColumnRenamed("Date", "﻿Date")
    rows.write.options(**CSV).csv(path)


def write_ledger_months(entries: DataFrame, path: str) -> None:
    """The entries as CSV like write_ledger's, in a folder for each month of their date (``month=YYYY-MM``; no date: Spark's default folder), in their order inside each.

    Only the months that entries have are written: their folders are replaced
    whole, those of other months are left as they are. So one month is exported
    again without the rest. A month with very many entries is split into files.
    """
    rows = entries.withColumn("month", F.substring(F.col("Date").cast("string"), 1, 7)).repartitionByRange("month", "Date", "id", "pos").sortWithinPartitions("month", "Date", "id", "pos")
    rows.select(*HEADER, "month").write.partitionBy("month").mode("overwrite").options(partitionOverwriteMode="dynamic", **CSV).csv(path)


def read_ledger_months(spark: SparkSession, path: str) -> DataFrame:
    """The columns of HEADER, as text, and month of what write_ledger_months() wrote."""
    return spark.read.schema(", ".join(f"{c} string" for c in [*HEADER, "month"])).options(**CSV).csv(path)


def unbalanced(entries: DataFrame) -> DataFrame:
    """Invoices whose debits differ from their credits."""
    sums = entries.groupBy("id").agg(F.sum("Debit").alias("debit"), F.sum("Credit").alias("credit"))
    return sums.where("debit <> credit")
