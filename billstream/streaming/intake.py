"""Micro-batch intake: files that arrive in a folder go through the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from billstream.config import POLICY, RULES, Policy, Rule
from billstream.operators import history
from billstream.operators.decide import accepted, audit_events, decided, duplicates_found, fingerprinted, first_arrivals, repeated, reviews
from billstream.operators.learning import top_accounts
from billstream.operators.matching import bank_matches
from billstream.operators.parties import delta, of_deltas
from billstream.schemas import CUSTOMER_PARTY, INVOICE, LEARNED_MAPPINGS, SUPPLIER_PARTY
from billstream.session import append, committed, compact, exists, kept, stored
from billstream.sources.invoices import ingested

ARRIVING = T.StructType([T.StructField("arrival", T.LongType()), *INVOICE.fields])
MAPPINGS = T.StructType([*LEARNED_MAPPINGS.fields, T.StructField("batch", T.LongType())])
#: Stored deltas are folded into a snapshot before every so many batches.
COMPACT_EVERY = 50
#: So many duplicates of a batch are sent to all tasks (about 10 MB); more are joined by a shuffle.
SENT_DUPLICATES = 100_000
#: So many suppliers with a learned account are sent to all tasks (about 50 MB); more are joined by a shuffle.
SENT_ACCOUNTS = 500_000
#: The files of a batch are numbered in so many parts, below 2^BATCH_BITS.
PARTS, BATCH_BITS = 4096, 40

DELTAS = {party: T.StructType([*fields, T.StructField("batch", T.LongType())]) for party, fields in (("supplier", SUPPLIER_PARTY.fields), ("customer", CUSTOMER_PARTY.fields))}


def intake(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = 1, mappings: str | None = None, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """Decide invoices (JSON lines of ARRIVING) as they come, against all earlier ones.

    Each micro-batch is the batch job: its results are appended to
    target/<table> as one batch, which a restart doesn't write again. An
    invoice is a duplicate if its fingerprint was stored by an earlier batch;
    these are kept for all time, in buckets of which a batch reads those it may
    be in, not in stream state. Accounts are proposed from the stored mappings
    (a folder of learned() rows, or the batches of approvals.decide(), read anew
    for each batch) before the rules. Suppliers and customers of all invoices,
    duplicates too, are stored as deltas, which parties_of() folds. With
    files_per_batch None, a batch has all files that are there. Before every
    compact_every batches, what they stored is folded into snapshots.
    """
    reader = spark.readStream.schema(ARRIVING)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)

    def process(batch: DataFrame, batch_id: int) -> None:
        take_in(batch, batch_id, target, mappings, policy, rules, compact_every)

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_in(batch: DataFrame, batch_id: int, target: str, mappings: str | None = None, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES, compact_every: int | None = COMPACT_EVERY) -> None:
    """Decide one batch of invoices (the columns of ARRIVING) and store what comes of it. The batch is read twice, for its duplicates and to be decided; decided rows are written once, and all tables made from there."""
    spark = batch.sparkSession
    if compact_every and batch_id and batch_id % compact_every == 0:
        compact_intake(spark, target, batch_id)
    arrived = fingerprinted(batch)
    known = lambda names: history.known(names, target, batch_id)
    with duplicates_sent(arrived, known) as found, accounts_sent(spark, mappings) as learned, kept(decided(arrived, None, learned, policy, rules, found), f"{target}/_decided/{batch_id}") as decisions:
        put = lambda df, name: append(df, f"{target}/{name}", batch_id)
        put(decisions.select("arrival", "fingerprint", "status", "risk_score", "proposal"), "decisions")
        put(accepted(decisions), "invoices")
        put(audit_events(decisions), "audit_events")
        put(reviews(decisions), "reviews")
        history.remember(first_arrivals(decisions), target, batch_id)
        for party in DELTAS:
            put(delta(decisions, party), f"{party}s")


def _sent(rows: DataFrame, most: int) -> DataFrame:
    """Cached rows, to be sent to all tasks if they are so many at most."""
    return F.broadcast(rows) if rows.count() <= most else rows


@contextmanager
def duplicates_sent(arrived: DataFrame, known: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
    """duplicates_found() among invoices with fingerprint, for decided(). known: gives the stored fingerprints among such rows. Only fingerprints and arrivals are cached."""
    cached = []

    def cache(rows: DataFrame) -> DataFrame:
        cached.append(rows.persist())
        return rows

    try:
        names = cache(arrived.select("fingerprint", "arrival"))
        before = _sent(cache(known(names)), SENT_DUPLICATES) if known else None
        found = cache(duplicates_found(names, before, _sent(cache(repeated(names)), SENT_DUPLICATES)))
        yield _sent(found, SENT_DUPLICATES)
    finally:
        for rows in reversed(cached):
            rows.unpersist()


@contextmanager
def accounts_sent(spark: SparkSession, mappings: str | None) -> Iterator[DataFrame | None]:
    """The learned account of each supplier, for decided(); None without a folder of mappings."""
    if not mappings:
        yield None
        return
    top = top_accounts(stored_mappings(spark, mappings)).persist()
    try:
        yield _sent(top, SENT_ACCOUNTS)
    finally:
        top.unpersist()


def arrivals(files: DataFrame, batch_id: int) -> DataFrame:
    """files (source_path, and others) with arrival: after those of earlier batches, and inside the batch the same whenever it is tried again.

    Files are dealt out to parts by a hash of their path; a file's place is the
    number of files in earlier parts and its place by path in its own, so no
    task numbers them all. A path that is there twice has two numbers.
    """
    rows = files.withColumn("__part", F.pmod(F.xxhash64("source_path"), F.lit(PARTS)))
    sums = rows.groupBy("__part").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # PARTS rows at most
    rows = rows.join(sums.select("__part", before.alias("__before")), "__part")
    place = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy("source_path"))
    return rows.select(*files.columns, (F.lit(batch_id << BATCH_BITS) + place).alias("arrival"))


def intake_files(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int | None = None, mappings: str | None = None, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """Take in the files that arrive in a folder, and below it: XML invoices are read and decided as by intake(); files that are rejected (table rejected, with the reason) and PDF files (waiting) are noted beside them.

    Invoices arrive in the order of batches; a file that is replaced under its
    own name is not read again. A target belongs to one stream.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)

    def process(batch: DataFrame, batch_id: int) -> None:
        files = batch.select("content", F.regexp_extract("path", "([^/]*)$", 1).alias("source_file"), F.col("path").alias("source_path"))
        found = ingested(files)
        with kept(found.records, f"{target}/_records/{batch_id}") as records:
            take_in(arrivals(records, batch_id).select(*ARRIVING.names), batch_id, target, mappings, policy, rules, compact_every)
        append(found.rejects, f"{target}/rejected", batch_id)
        append(found.waiting, f"{target}/waiting", batch_id)

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """The learned mappings in a folder: batches that add up, or plain files; none if there is no such folder."""
    if committed(spark, folder):
        return stored(spark, folder, MAPPINGS).groupBy("supplier_name", "account").agg(F.sum("validations").alias("validations"))
    return spark.read.schema(LEARNED_MAPPINGS).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], LEARNED_MAPPINGS)


def compact_intake(spark: SparkSession, target: str, before: int) -> None:
    """Fold what the batches before a number stored of parties and fingerprints: reading it no longer depends on how many batches there were."""
    history.compact_history(spark, target, before)
    for party, schema in DELTAS.items():
        compact(spark, f"{target}/{party}s", schema, lambda rows, party=party: of_deltas(rows, party).select(*(f.name for f in DELTAS[party].fields if f.name != "batch")), before)


def parties_of(spark: SparkSession, target: str, party: str) -> DataFrame:
    """The suppliers, or customers, of all that intake() has taken in."""
    return of_deltas(stored(spark, f"{target}/{party}s", DELTAS[party]), party)


def recent_only(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """A stream of invoices without repeats inside the watermark. It forgets what is older, so it is a weaker promise than intake(), for bounded state."""
    return fingerprinted(stream).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def match_stream(transactions: DataFrame, invoices: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Match a stream of bank lines with stored invoices, by the batch operator."""
    return bank_matches(transactions, invoices).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
