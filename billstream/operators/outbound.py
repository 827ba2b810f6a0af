"""Sales invoices: amounts, dates and gapless numbers by year."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from billstream.functions.expressions import two_decimals

RANGE_ROWS = 100_000


def numbered(requests: DataFrame, sequences: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``n`` and ``invoice_number`` (F, year, five digits or more): the place of each request (id, year) in its year, after the stored value of the year's sequence.

    Ids are cut into ranges; a request's place is the number of requests in
    the year's earlier ranges and its place in its own, so a year with very
    many requests is spread over tasks.
    """
    rows = requests.withColumn("__range", F.floor(F.col("id") / range_rows))
    sums = rows.groupBy("year", "__range").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy("year").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("year", "__range", before.alias("__before")), ["year", "__range"])
    n = F.col("__before") + F.row_number().over(W.partitionBy("year", "__range").orderBy("id"))
    if sequences is not None:
        stored = sequences.select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("year"), F.col("current_value").alias("__stored"))
        rows = rows.join(stored, "year", "left")
        n = n + F.coalesce("__stored", F.lit(0))
    out = rows.withColumn("n", n.cast("long")).withColumn("invoice_number", F.format_string("F%d-%05d", "year", "n"))
    return out.select(*requests.columns, "n", "invoice_number")


def sequences_after(numbered_: DataFrame) -> DataFrame:
    """name, current_value of each year's sequence."""
    return numbered_.groupBy("year").agg(F.max("n").alias("current_value")).select(F.concat(F.lit("SALES-"), F.col("year").cast("string")).alias("name"), "current_value")


def sales_invoices(requests: DataFrame, customers: DataFrame, as_of: Column | date | None = None, vat_rate: Decimal = Decimal("20"), due_days: int = 30, sequences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Invoices for requests (id, customer_id, net_amount, description; issue_date, if as_of isn't given) and the requests of unknown customers."""
    known = requests.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name")), "customer_id")
    unknown = requests.join(customers.select(F.col("id").alias("customer_id")), "customer_id", "left_anti")
    issue = F.col("issue_date") if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    net = F.col("net_amount").cast("decimal(18,2)")
    vat = F.round(net * F.lit((vat_rate / 100).quantize(Decimal("0.0001"))), 2).cast("decimal(18,2)")
    rows = known.withColumn("issue_date", issue).withColumn("due_date", F.date_add(issue, due_days)).withColumn("year", F.year(issue))
    rows = rows.withColumn("vat_amount", vat).withColumn("gross_amount", (net + vat).cast("decimal(18,2)"))
    return numbered(rows, sequences).withColumn("currency", F.lit("EUR")).withColumn("status", F.lit("DRAFT")).drop("year"), unknown


def invoice_xml(invoices: DataFrame) -> DataFrame:
    """Adds ``xml``: the flat document of a sales invoice."""
    amount = lambda c: two_decimals(F.col(c))
    fields = {
        "ID": F.col("invoice_number"), "IssueDate": F.col("issue_date").cast("string"), "DueDate": F.col("due_date").cast("string"), "DocumentCurrencyCode": F.lit("EUR"),
        "BuyerName": F.col("customer_name"), "Description": F.col("description"), "TaxExclusiveAmount": amount("net_amount"), "TaxAmount": amount("vat_amount"), "PayableAmount": amount("gross_amount"),
    }
    return invoices.withColumn("xml", F.to_xml(F.struct(*(c.alias(k) for k, c in fields.items())), {"rowTag": "Invoice"}))
