"""Account mappings learned from approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_SEQ = 200_000


def learned(approvals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """supplier_name, account, validations: approvals (supplier_name, account) counted, on top of stored counts. Rows without a supplier or an account teach nothing."""
    new = approvals.where("coalesce(supplier_name, '') <> '' and coalesce(account, '') <> ''").groupBy("supplier_name", "account").agg(F.count("*").alias("validations"))
    if stored is None:
        return new
    return stored.select("supplier_name", "account", "validations").unionByName(new).groupBy("supplier_name", "account").agg(F.sum("validations").alias("validations"))


def top_accounts(mappings: DataFrame) -> DataFrame:
    """The account with most validations of each supplier, ties to the first by name: an aggregate, so a supplier with many accounts is reduced within tasks."""
    best = F.min(F.struct((-F.col("validations")).alias("minus"), "account")).alias("best")
    return mappings.groupBy("supplier_name").agg(best).select("supplier_name", F.col("best.account").alias("account"), (-F.col("best.minus")).alias("validations"))


def top_accounts_asof(approvals: DataFrame, arrivals: DataFrame, range_seq: int = RANGE_SEQ) -> DataFrame:
    """arrival, account, validations: the top account of each arrival's supplier by the approvals before it.

    approvals: supplier_name, account, seq; arrivals: supplier_name, arrival,
    seq. Approvals and arrivals are one sequence for each supplier; at each
    approval its account's count is known, and the best so far is a running
    minimum, as counts only grow. So no approval meets an arrival in a join.
    Sequences are cut into ranges of seq, which start from the counts and the
    minimum of the earlier ones, so a supplier with very many rows is spread
    over tasks.
    """
    ranged = lambda df: df.withColumn("__range", F.floor(F.col("seq") / range_seq))
    earlier = lambda *by: W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    learns = ranged(approvals.where("coalesce(supplier_name, '') <> '' and coalesce(account, '') <> ''"))
    sums = learns.groupBy("supplier_name", "account", "__range").agg(F.count("*").alias("__k"))
    sums = sums.select("supplier_name", "account", "__range", F.coalesce(F.sum("__k").over(earlier("supplier_name", "account")), F.lit(0)).alias("__before"))
    count = F.col("__before") + F.row_number().over(W.partitionBy("supplier_name", "account", "__range").orderBy("seq"))
    steps = learns.join(sums, ["supplier_name", "account", "__range"]).withColumn("n", count)
    steps = steps.select("supplier_name", "__range", "seq", F.struct((-F.col("n")).alias("minus"), "account").alias("now"), F.lit(None).cast("long").alias("arrival"))
    asks = ranged(arrivals).select("supplier_name", "__range", "seq", F.lit(None).cast(steps.schema["now"].dataType).alias("now"), "arrival")
    rows = steps.unionByName(asks)
    starts = rows.groupBy("supplier_name", "__range").agg(F.min("now").alias("__least")).select("supplier_name", "__range", F.min("__least").over(earlier("supplier_name")).alias("__start"))
    before = W.partitionBy("supplier_name", "__range").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    best = rows.join(starts, ["supplier_name", "__range"]).withColumn("best", F.least("__start", F.min("now").over(before))).where("arrival is not null and best is not null")
    return best.select("arrival", F.col("best.account").alias("account"), (-F.col("best.minus")).cast("long").alias("validations"))
