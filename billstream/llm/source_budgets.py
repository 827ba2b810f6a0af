"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. A token budget goes down the
tree by the weights of siblings. A node that can't use its share, as it has too
few tokens for its epochs, passes the shortage to its siblings, in proportion
to their weights; only what no sibling can use goes on to its parent's
siblings. A leaf then takes whole epochs of its documents and, in the seeded
order of the last epoch, the documents that begin within the rest.

Shares are found by sorting siblings by the level at which each is full, so
that no loop is needed: those up to the water level are full, the others share
the rest. The order within a leaf is found in two steps, sums over 4096 ranges
of the order and positions within the one range in which the budget ends, so a
hot leaf is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, staged

LEAF = ["domain", "lang", "source"]
#: Weights among siblings; 1 where none is given.
DOMAIN_WEIGHTS = {"domain0": 3, "domain1": 2, "domain2": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
SHARE = 0.6
EPOCHS = 2
SEED = 17
SALTS = 64
TOKEN = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: the number that ends its name modulo 3; other for names without one."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.when(number != "", number).cast("long") % 3).cast("string")))


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("double")


def shared(nodes: DataFrame, parents: list[str], node: str, amount: str, capacity: str, weight_: Column, to: str) -> DataFrame:
    """nodes with the column to: each node's part of its parents' amount. A node gets at most its capacity; siblings that aren't full get the same for each unit of weight."""
    among = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    up = among.orderBy("__level", node)
    filled = nodes.withColumn("__w", weight_).withColumn("__level", F.col(capacity) / F.col("__w"))
    left = F.col(amount) - F.coalesce(F.sum(capacity).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("__w").over(up.rowsBetween(0, W.unboundedFollowing))
    filled = filled.withColumn("__water", F.greatest(left, F.lit(0.0)) / weights_left)
    # Full nodes come first; the first that isn't full sets the level for the rest.
    level = F.max(F.when(F.col("__level") > F.col("__water"), F.col("__water"))).over(among)
    got = F.when(F.col("__level") <= F.col("__water"), F.col(capacity)).otherwise(F.least(capacity, F.col("__w") * level))
    return filled.withColumn(to, got).drop("__w", "__level", "__water")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget (whole tokens) for leaves (domain, lang, source, tokens): one row a source."""
    at = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    domains = at.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("t"))
    domains = domains.withColumn("amount", F.sum("t").over(W.partitionBy(F.lit(0))) * share)
    domains = shared(domains, [], "domain", "amount", "cap", weight("domain", DOMAIN_WEIGHTS), "of_domain").select("domain", "of_domain")
    langs = at.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = shared(langs, ["domain"], "lang", "of_domain", "cap", weight("lang", LANGUAGE_WEIGHTS), "of_lang").select("domain", "lang", "of_lang")
    out = shared(at.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", "of_lang", "cap", weight("source", SOURCE_WEIGHTS), "of_source")
    return out.select(*LEAF, "tokens", F.floor(F.col("of_source") + 0.001).cast("long").alias("budget"))


def mixed(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: the chosen documents, once for each epoch that takes them.

    docs: doc_id, text, lang, source; other columns are ignored. The budget is
    share times all tokens (words). Null texts have no tokens, null languages
    and sources are und and unknown. Repeated rows count as often as they are
    there; equal places in the order go by doc_id and length. A document that
    begins within the budget is taken whole, so a leaf exceeds its budget by
    less than a document. No rows: an empty result.
    """
    rows = docs.select(
        "doc_id",
        domain_of(F.coalesce("source", F.lit("unknown"))).alias("domain"),
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = staged(rows, "token_counts").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, share, epochs).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = staged(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "leaf_budgets")
    salted = plan.select(*LEAF, "whole", "rest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    at = rows.join(salted, [*LEAF, "salt"]).drop("salt")
    columns = ["doc_id", *LEAF, "n_tokens", "epoch"]
    taken = at.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*columns)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    part = at.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("place", order).withColumn("range", F.substring("place", 1, 3))
    sums = part.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = part.join(sums.withColumn("before", before), [*LEAF, "range"]).where("before < rest")
    within = W.partitionBy(*LEAF, "range").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    inside = part.where("before + in_range <= rest").select(*columns)
    last = part.where("before + in_range > rest").withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("before < rest").select(*columns)
    return taken.unionByName(inside).unionByName(last)


@apart
def chosen(docs: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of docs whose id one epoch takes; columns as they were."""
    ids = mixed(docs, share, 1, seed).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)
