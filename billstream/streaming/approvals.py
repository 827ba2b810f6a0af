"""Approve and reject decisions on Structured Streaming: they set the state of stored invoices and teach accounts, which intake then proposes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from billstream.operators import workflow
from billstream.operators.learning import learned
from billstream.schemas import DECISIONS, INVOICES, REVIEWS
from billstream.session import append, compact, kept, stored
from billstream.streaming.intake import COMPACT_EVERY, MAPPINGS

BATCH = T.StructField("batch", T.LongType())
STATES = "invoice_id long, last struct<seq: long, action: string>, first struct<seq: long, action: string, username: string>, approval struct<seq: long, account: string, username: string>, rejection struct<seq: long, username: string, reason: string>, batch long"


def decide(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = 1, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """Take decisions (JSON lines of schemas.DECISIONS) on the invoices that intake() stored in target.

    Each micro-batch appends, as one batch that a restart doesn't write again:
    the state of each invoice by its decisions (decision_states), the accounts
    that approvals teach (mappings), an audit event for each approval
    (approval_events) and what names no stored invoice (decisions_unknown).
    States and counts of all batches are folded when read, by states_of() and
    intake.stored_mappings(). Decisions meet the stored invoices in one join; of
    these, files are skipped whose ids are all below or above the batch's.
    """
    reader = spark.readStream.schema(DECISIONS)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)

    def process(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_decisions(spark, target, batch_id)
        low, high = batch.agg(F.min("invoice_id"), F.max("invoice_id")).first()
        invoices = stored_invoices(spark, target).where(F.col("id").between(F.lit(low), F.lit(high)))
        with kept(workflow.met(invoices, batch), f"{target}/_met/{batch_id}") as given:
            approved = workflow.approvals_met(given)
            put = lambda df, name: append(df, f"{target}/{name}", batch_id)
            put(workflow.folded(given.where("known")), "decision_states")
            put(learned(approved), "mappings")
            put(workflow.approval_events(approved), "approval_events")
            put(given.where("known is null").select(*DECISIONS.names), "decisions_unknown")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_invoices(spark: SparkSession, target: str) -> DataFrame:
    """The invoices that intake() stored, as they were then."""
    return stored(spark, f"{target}/invoices", T.StructType([*INVOICES.fields, BATCH])).drop("batch")


def states_of(spark: SparkSession, target: str) -> DataFrame:
    """The state of each decided invoice."""
    return workflow.refolded(stored(spark, f"{target}/decision_states", STATES))


def invoices_of(spark: SparkSession, target: str) -> DataFrame:
    """The stored invoices as decided so far."""
    return workflow.invoices_in_state(stored_invoices(spark, target), states_of(spark, target))


def reviews_of(spark: SparkSession, target: str) -> DataFrame:
    """The stored reviews, closed by the first decision on their invoice."""
    fields = [f for f in REVIEWS.fields if f.name in ("invoice_id", "reason", "severity", "resolved")]
    return workflow.reviews_in_state(stored(spark, f"{target}/reviews", T.StructType([*fields, BATCH])).drop("batch"), states_of(spark, target))


def compact_decisions(spark: SparkSession, target: str, before: int) -> None:
    """Fold the states and mappings of the batches before a number into snapshots."""
    compact(spark, f"{target}/decision_states", STATES, workflow.refolded, before)
    compact(spark, f"{target}/mappings", MAPPINGS, lambda rows: rows.groupBy("supplier_name", "account").agg(F.sum("validations").alias("validations")), before)
