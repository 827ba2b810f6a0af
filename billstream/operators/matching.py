"""Bank lines matched to invoices by amount, within a tolerance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billstream.config import MATCH_CONFIDENCE, POLICY, REFERENCE_CONFIDENCE


def bank_matches(transactions: DataFrame, invoices: DataFrame, tolerance: Decimal = POLICY.match_tolerance) -> DataFrame:
    """transaction_id, invoice_id, invoice_number, amount, confidence of every pair within the tolerance.

    transactions: id, amount, reference and, if there, matched_invoice_id (only
    unmatched ones count); invoices: id, invoice_number, gross_amount, status.
    Amounts fall into buckets as wide as the tolerance; a transaction looks in
    its own bucket and the two beside it, an invoice stands in one, so a pair
    meets once and the join is an equality join with a rest.
    """
    wide = F.lit(max(1, int(tolerance * 100)))
    cents = lambda x: (x * 100).cast("long")
    bucket = lambda x: F.floor(cents(x) / wide).cast("long")
    t = transactions.where("matched_invoice_id is null") if "matched_invoice_id" in transactions.columns else transactions
    t = t.select(F.col("id").alias("transaction_id"), "amount", "reference", bucket(F.abs("amount")).alias("b")).where("amount is not null")
    t = t.select("transaction_id", "amount", "reference", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"))
    gross = F.coalesce("gross_amount", F.lit(0).cast("decimal(18,2)"))
    i = invoices.where(F.col("status").isin("APPROVED", "VALIDATED")).select(F.col("id").alias("invoice_id"), "invoice_number", gross.alias("gross"))
    i = i.withColumn("bucket", bucket(F.col("gross")))
    near = t.join(i, (t.bucket == i.bucket) & (F.abs(F.abs("amount") - F.col("gross")) <= F.lit(tolerance)))
    named = (F.coalesce("invoice_number", F.lit("")) != "") & F.contains(F.coalesce("reference", F.lit("")), F.col("invoice_number"))
    return near.select("transaction_id", "invoice_id", "invoice_number", "amount", F.when(named, F.lit(REFERENCE_CONFIDENCE)).otherwise(F.lit(MATCH_CONFIDENCE)).alias("confidence"))
