"""Supplier and customer master data folded from invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_ARRIVALS = 200_000


def merged(parties: DataFrame, attributes: list[str], first_only: list[str] = ()) -> DataFrame:
    """name and attributes, one row a name: the last value of each that isn't null; of those in first_only the first record's, null or not.

    parties: arrival, name, attributes. Names are compared as they are; rows
    without a name are left out. The fold is an aggregate over (arrival, value)
    pairs, reduced within tasks.
    """
    last = [F.max(F.when(F.col(a).isNotNull(), F.struct("arrival", a))).getField(a).alias(a) for a in attributes]
    first = [F.min(F.struct(F.col("arrival"), F.col(a))).getField(a).alias(a) for a in first_only]
    return parties.where("coalesce(name, '') <> ''").groupBy("name").agg(*last, *first)


def suppliers(invoices: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """name, siren, vat_number, email, iban, risk_level. stored: an earlier result, which counts as arriving before all invoices."""
    rows = invoices.select("arrival", "supplier.*")
    if stored is not None:
        rows = rows.unionByName(stored.select(F.lit(-(1 << 62)).alias("arrival"), "name", "siren", "vat_number", "email", "iban"))
    return merged(rows, ["siren", "vat_number", "email"], ["iban"]).withColumn("risk_level", F.lit("normal"))


def customers(invoices: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """name, siren, vat_number, email, address."""
    rows = invoices.select("arrival", "customer.*")
    if stored is not None:
        rows = rows.unionByName(stored.select(F.lit(-(1 << 62)).alias("arrival"), "name", "siren", "vat_number", "email", "address"))
    return merged(rows, ["siren", "vat_number", "email", "address"])


def bank_detail_changes(invoices: DataFrame, range_arrivals: int = RANGE_ARRIVALS) -> DataFrame:
    """arrival, supplier_name, iban, previous_iban of invoices whose IBAN differs from the supplier's last known one.

    Arrivals without an IBAN change nothing and are left out first. A
    supplier's arrivals are cut into ranges; each looks one row back in its
    own, and its first row at the last of the range before, so a supplier with
    very many arrivals is spread over tasks.
    """
    known = invoices.select("arrival", F.col("supplier.name").alias("supplier_name"), F.col("supplier.iban").alias("iban")).where("coalesce(supplier_name, '') <> '' and iban is not null")
    known = known.withColumn("__range", F.floor(F.col("arrival") / range_arrivals))
    ends = known.groupBy("supplier_name", "__range").agg(F.max(F.struct("arrival", "iban")).getField("iban").alias("__last"))
    ends = ends.select("supplier_name", "__range", F.lag("__last").over(W.partitionBy("supplier_name").orderBy("__range")).alias("__before"))
    inside = F.lag("iban").over(W.partitionBy("supplier_name", "__range").orderBy("arrival"))
    before = known.withColumn("__inside", inside).join(ends, ["supplier_name", "__range"]).withColumn("previous_iban", F.coalesce("__inside", "__before"))
    return before.where("previous_iban <> iban").select("arrival", "supplier_name", "iban", "previous_iban")


def delta(invoices: DataFrame, party: str) -> DataFrame:
    """What a batch of invoices says about its suppliers or customers, a row a name: to be stored beside earlier batches' rows."""
    return (suppliers if party == "supplier" else customers)(invoices).drop("risk_level")


def of_deltas(deltas: DataFrame, party: str) -> DataFrame:
    """The master data from stored deltas (the columns of delta() and batch, by which they are in order)."""
    rows = deltas.withColumnRenamed("batch", "arrival")
    if party == "supplier":
        return merged(rows, ["siren", "vat_number", "email"], ["iban"]).withColumn("risk_level", F.lit("normal"))
    return merged(rows, ["siren", "vat_number", "email", "address"])
