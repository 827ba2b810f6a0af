"""Overdue sales invoices, reminder drafts and levels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billstream.config import POLICY
from billstream.functions.expressions import filled, two_decimals

#: The texts of a reminder.
SUBJECT = "Rappel — facture %s arrivée à échéance"
BODY = """Bonjour,

Sauf erreur de notre part, la facture %s d'un montant de %s EUR,
échue le %s, reste à ce jour en attente de règlement.

Merci de nous indiquer si le règlement a déjà été effectué ou, dans le cas contraire, sa date prévue.

Cordialement"""


def overdue(invoices: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    """Unpaid sales invoices due before as_of, with customer_name and customer_email. Spark sends the customers to all tasks if they are few, and shuffles else."""
    late = invoices.where(~F.col("status").isin("PAID", "CANCELLED") & (F.col("due_date") < F.lit(as_of)))
    return late.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), F.col("email").alias("customer_email")), "customer_id")


def reminder_drafts(late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts for overdue rows, and the rows without an e-mail address."""
    has = filled(F.col("customer_email"))
    drafts = late.where(has).select(
        F.col("id").alias("outbound_invoice_id"), "customer_email", F.lit(1).alias("reminder_level"), F.format_string(SUBJECT, "invoice_number").alias("subject"),
        F.format_string(BODY, "invoice_number", two_decimals(F.col("gross_amount")), F.col("due_date").cast("string")).alias("body"), F.lit("DRAFT").alias("status"),
    )
    return drafts, late.where(~has)


def reminder_levels(late: DataFrame, as_of: date, days: tuple[int, ...] = POLICY.reminder_days) -> DataFrame:
    """Adds days_late and reminder_level: how many of the steps have passed."""
    out = late.withColumn("days_late", F.datediff(F.lit(as_of), "due_date"))
    level = F.lit(0)
    for d in days:
        level = level + (F.col("days_late") >= d).cast("int")
    return out.withColumn("reminder_level", level)
