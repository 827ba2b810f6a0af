"""Key figures and lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billstream.config import POLICY, Policy
from billstream.functions.expressions import if_filled, two_decimals


def dashboard_kpis(invoices: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    return invoices.agg(F.count("*").alias("total"), count(F.col("status") == "APPROVED").alias("approved"), count(F.col("status") == "REVIEW_REQUIRED").alias("review"), count(F.col("payment_status") == "UNPAID").alias("unpaid"))


def latest_invoices(invoices: DataFrame, n: int = 15) -> DataFrame:
    """The last n by id, as the dashboard shows them."""
    account = F.coalesce(if_filled(F.col("approved_account")), if_filled(F.col("proposed_account")), F.lit("—"))
    gross = two_decimals(F.coalesce("gross_amount", F.lit(0).cast("decimal(18,2)")))
    return invoices.orderBy(F.desc("id")).limit(n).select("id", "invoice_number", "supplier_name", gross.alias("gross"), "status", account.alias("account"))


def due_schedule(invoices: DataFrame, as_of: date) -> DataFrame:
    """Open sales invoices by age: not due, 1-30, 31-60, 61-90 and more days late."""
    late = F.datediff(F.lit(as_of), "due_date")
    bucket = F.when(late <= 0, "not due").when(late <= 30, "1-30").when(late <= 60, "31-60").when(late <= 90, "61-90").otherwise("over 90")
    return invoices.where(~F.col("status").isin("PAID", "CANCELLED")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("net_amount").alias("amount"))


def amount_bands(invoices: DataFrame, policy: Policy = POLICY) -> DataFrame:
    g = F.col("gross_amount")
    band = F.when(g >= policy.critical_amount, "critical").when(g >= policy.high_amount, "high").otherwise("normal")
    return invoices.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("gross_amount").alias("amount"))


def retained(invoices: DataFrame, as_of: date, policy: Policy = POLICY) -> DataFrame:
    """Invoices (issue_date: a date) not older than the years they must be kept."""
    return invoices.where(F.col("issue_date") >= F.add_months(F.lit(as_of), -12 * policy.retention_years))
