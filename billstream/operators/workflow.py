"""Approve and reject decisions folded into invoices, reviews and events.

decisions: invoice_id, seq, action (approve or reject), account, username,
reason. The last decision sets the status; what approvals and what rejections
say persists side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(decisions: DataFrame) -> DataFrame:
    """One row an invoice: the last action, approval and rejection, and the first decision."""
    last = lambda when, *cols: F.max(F.when(F.col("action") == when, F.struct("seq", *cols)))
    return decisions.groupBy("invoice_id").agg(
        F.max(F.struct("seq", "action")).alias("last"),
        F.min(F.struct("seq", "action", "username")).alias("first"),
        last("approve", "account", "username").alias("approval"),
        last("reject", "username", "reason").alias("rejection"),
    )


def refolded(states: DataFrame) -> DataFrame:
    """States of folded() over several batches of decisions as one row an invoice. The order of batches doesn't count, as each part carries its seq."""
    return states.groupBy("invoice_id").agg(F.max("last").alias("last"), F.min("first").alias("first"), F.max("approval").alias("approval"), F.max("rejection").alias("rejection"))


def invoices_after(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """invoices (id, status, proposed_account, ...) with status, approved_account, approved_by, rejected_by and rejection_reason as decided."""
    return invoices_in_state(invoices, folded(decisions))


def invoices_in_state(invoices: DataFrame, states: DataFrame) -> DataFrame:
    """invoices_after(), from states of folded() or refolded()."""
    f = states.withColumnRenamed("invoice_id", "id")
    out = invoices.join(f, "id", "left")
    out = out.withColumn("status", F.when(F.col("last.action") == "approve", "APPROVED").when(F.col("last.action") == "reject", "REJECTED").otherwise(F.col("status")))
    account = F.coalesce(F.when(F.col("approval.account") != "", F.col("approval.account")), F.col("proposed_account"))
    out = out.withColumn("approved_account", F.when(F.col("approval").isNotNull(), account)).withColumn("approved_by", F.col("approval.username"))
    return out.withColumn("rejected_by", F.col("rejection.username")).withColumn("rejection_reason", F.col("rejection.reason")).drop("last", "first", "approval", "rejection")


def unknown_decisions(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on invoices that there are not."""
    return decisions.join(invoices.select(F.col("id").alias("invoice_id")), "invoice_id", "left_anti")


def reviews_after(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """reviews closed by the first decision on their invoice."""
    return reviews_in_state(reviews, folded(decisions))


def reviews_in_state(reviews: DataFrame, states: DataFrame) -> DataFrame:
    """reviews_after(), from states of folded() or refolded()."""
    first = states.select("invoice_id", "first")
    out = reviews.drop("resolved").join(first, "invoice_id", "left")
    resolution = F.when(F.col("first.action") == "approve", "APPROVED").when(F.col("first.action") == "reject", "REJECTED")
    return out.withColumn("resolved", F.col("first").isNotNull()).withColumn("resolution", resolution).withColumn("resolved_by", F.col("first.username")).drop("first")


def met(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions with known, supplier_name and proposed_account of their invoice; known is null where there is none. One join for unknown decisions, approvals and states."""
    return decisions.join(invoices.select(F.col("id").alias("invoice_id"), "supplier_name", "proposed_account", F.lit(True).alias("known")), "invoice_id", "left")


def approvals(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every approval of a known invoice: invoice_id, seq, username, supplier_name, account (the decision's, else the proposed one)."""
    known = invoices.select(F.col("id").alias("invoice_id"), "supplier_name", "proposed_account")
    return _approved(decisions.where("action = 'approve'").join(known, "invoice_id"))


def approvals_met(rows: DataFrame) -> DataFrame:
    """approvals(), from rows of met()."""
    return _approved(rows.where("known and action = 'approve'"))


def _approved(rows: DataFrame) -> DataFrame:
    account = F.coalesce(F.when(F.col("account") != "", F.col("account")), F.col("proposed_account"))
    return rows.select("invoice_id", "seq", "username", "supplier_name", account.alias("account"))


def approval_events(approved: DataFrame) -> DataFrame:
    """An audit event for each approval; rejections leave none."""
    details = F.to_json(F.struct("account"), {"ignoreNullFields": "false"})
    return approved.select("invoice_id", "username", F.lit("WORKFLOW").alias("agent"), F.lit("approved").alias("event"), details.alias("details"))
