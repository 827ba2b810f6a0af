"""Bank statements in CSV files."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names a column may have, and what stands in for an empty one.
ALIASES = {"booking_date": ("booking_date", "date"), "label": ("label", "libelle"), "amount": ("amount", "montant"), "currency": ("currency", "devise"), "reference": ("reference",)}
DEFAULTS = {"amount": "0", "currency": "EUR", "reference": ""}
MARK = "﻿"


def read_bank_csv(spark: SparkSession, path: str | list[str], names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Transactions (booking_date, label, amount, currency, reference), and the rows whose amount is no number.

    Comma-separated with a header, a byte order mark is passed over; amounts
    may have a decimal comma. Fields may be quoted: commas and line breaks in
    quotes belong to the field, two quotes are one. Rows with too few fields
    lack the last ones, further fields are passed over; ``record`` is the raw
    text of such rows among the rejected, null for others. All files of path
    must have the same header, else reading fails; read_bank_folder() takes
    others. A file is read by one task, as a line break may be inside a field.
    names: the header's, if they are known.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
    names = names or spark.read.options(**options).csv(path).columns
    record = next(c for c in ("_record", "__record", "___record") if c not in names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, record]])
    raw = spark.read.options(**options, columnNameOfCorruptRecord=record).schema(schema).csv(path)
    there = {c.removeprefix(MARK).strip().lower(): c for c in names}

    def column(name: str):
        found = [F.when(F.col(f"`{there[a]}`") != "", F.col(f"`{there[a]}`")) for a in ALIASES[name] if a in there]
        return F.coalesce(*found, F.lit(DEFAULTS.get(name)).cast("string"))

    rows = raw.select(*(column(n).alias(n) for n in ALIASES), F.col(f"`{record}`").alias("record")).withColumn("text", F.col("amount"))
    rows = rows.withColumn("amount", F.replace("text", F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))
    bad = rows.where("amount is null").drop("amount").withColumnRenamed("text", "amount")
    return rows.where("amount is not null").drop("text", "record"), bad


def read_bank_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """read_bank_csv() of a folder whose files may have different headers: those of one header are read together, so there are as many reads as there are headers. An empty folder has no rows."""
    lines = spark.read.text(folder).select("value", F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # Where a file begins, its lines are in order within one task.
    first = lines.where("start = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    paths: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():  # a row a file, as many as Spark lists here anyway
        paths.setdefault(r.header.removeprefix(MARK).strip(), []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.file)))
    reads = [read_bank_csv(spark, p, next(csv.reader([header]))) for header, p in paths.items()]
    if not reads:
        none = ", ".join(f"{c} string" for c in ALIASES)
        return spark.createDataFrame([], none.replace("amount string", "amount decimal(18,2)")), spark.createDataFrame([], f"{none}, record string").select("booking_date", "label", "currency", "reference", "record", "amount")
    good, bad = reads[0]
    for more, worse in reads[1:]:
        good, bad = good.unionByName(more), bad.unionByName(worse)
    return good, bad
