"""Fingerprints of all invoices taken in so far.

They are kept in buckets by their first digits, a folder each, so that a batch
reads those buckets only in which some of its invoices may be. Which these are
is told by a filter: one bit for each fingerprint in a bitmap of fixed size,
stored in pieces beside the fingerprints. New invoices are let through by it,
but for a share as large as that of the bits set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billstream.session import append, committed, compact, stored

#: Hexadecimal digits: 256 buckets.
BUCKET_DIGITS = 2
#: Bits of the filter: 16 MB at most. With 10^7 fingerprints, one new invoice of 14 is looked up in vain; with many more, most are.
FILTER_BITS = 1 << 27
FINGERPRINTS = "fingerprint string, bucket string, batch long"
FILTERS = "piece long, bits binary, batch long"


def _bucketed(rows: DataFrame) -> DataFrame:
    place = F.conv(F.substring("fingerprint", BUCKET_DIGITS + 1, 12), 16, 10).cast("long") % FILTER_BITS
    return rows.select("fingerprint", F.substring("fingerprint", 1, BUCKET_DIGITS).alias("bucket"), place.alias("place"))


def remember(rows: DataFrame, folder: str, batch: int) -> None:
    """Store the fingerprints of a batch, and their bits."""
    found = _bucketed(rows)
    dealt = found.select(F.unhex("fingerprint").alias("bytes"), "bucket").repartition("bucket")  # half as long as the digits
    append(dealt.select(F.lower(F.hex("bytes")).alias("fingerprint"), "bucket"), f"{folder}/fingerprints", batch, ("bucket",))
    append(_filter(found), f"{folder}/fingerprint_filter", batch)


def _filter(bucketed: DataFrame) -> DataFrame:
    """piece, bits: a bitmap with the bits of these rows."""
    return bucketed.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    """Whether the place's bit is set in its piece."""
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False))


def let_through(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """fingerprint, bucket, place of those rows whose bits are set in a filter (piece, bits). The filter has a bounded size and goes to all tasks."""
    asked = _bucketed(rows).withColumn("piece", F.bitmap_bucket_number("place"))
    return asked.join(F.broadcast(bits), "piece").where(_bit(F.col("bits"), F.col("place"))).select("fingerprint", "bucket", "place")


def _maybe(rows: DataFrame, folder: str, before: int) -> DataFrame:
    return let_through(rows, stored(rows.sparkSession, f"{folder}/fingerprint_filter", FILTERS, before).groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits")))


def maybe_known(rows: DataFrame, folder: str, before: int) -> DataFrame:
    """fingerprint, bucket of those rows that an earlier batch may have: all that one has, and few others."""
    return _maybe(rows, folder, before).select("fingerprint", "bucket").distinct()


def in_buckets(spark: SparkSession, folder: str, before: int, buckets: list[str]) -> DataFrame:
    """The fingerprints of earlier batches in these buckets; others' files aren't read."""
    return stored(spark, f"{folder}/fingerprints", FINGERPRINTS, before).where(F.col("bucket").isin(buckets)).select("fingerprint")


def known(rows: DataFrame, folder: str, before: int) -> DataFrame:
    """fingerprint of those rows that an earlier batch has. Before the stored ones meet them in a join, they pass a filter of the rows that may be known, so that they are not dealt out whole."""
    if not any(int(b) < before for b in committed(rows.sparkSession, f"{folder}/fingerprint_filter")):
        return rows.select("fingerprint").where(F.lit(False))  # which Spark knows to be empty
    maybe = _maybe(rows, folder, before)
    buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # 256 at most
    passed = let_through(in_buckets(rows.sparkSession, folder, before, buckets), _filter(maybe)).select("fingerprint")
    return passed.join(maybe.select("fingerprint").distinct(), "fingerprint")  # no semi-join: Spark would do it before the filter


def compact_history(spark: SparkSession, folder: str, before: int) -> None:
    """Fold the batches before a number: one file a bucket and task, one filter."""
    compact(spark, f"{folder}/fingerprints", FINGERPRINTS, lambda rows: rows.select("fingerprint", "bucket").repartition("bucket"), before, ("bucket",))
    compact(spark, f"{folder}/fingerprint_filter", FILTERS, lambda rows: rows.groupBy("piece").agg(F.bitmap_or_agg("bits").alias("bits")), before)
