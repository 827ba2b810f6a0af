"""Token counts as delta-maintained rollups.

Changes come in batches of signed rows: a document inserted, deleted, or
counted anew. A batch is added up to one row for each (source, language,
tokenizer version). Each try at it writes a folder of its own; a marker beside
it, made in one step once the sums are there, is the commit. A batch that has a
marker is never written again, so a retried or repeated batch counts once, and
a try that breaks off leaves what was committed as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import listed, marked, scratch, staged

KEYS = ["source", "lang", "tokenizer"]
#: The tokenizer versions and the pattern whose matches are a text's tokens.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "runs-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
DELTAS = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
MARK = "committed-"


def counted(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, tokenizer, was, tokens: a row for each row of docs and tokenizer version. was: the estimate by n_chars; null texts have no tokens. The texts are read once, and none is moved."""
    versions = F.array(*(F.struct(F.lit(k).alias("tokenizer"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("tokens")) for k, p in tokenizers.items()))
    return docs.select("doc_id", "source", "lang", estimate().alias("was"), F.explode(versions).alias("v")).select("doc_id", "source", "lang", "was", "v.*")


def estimate() -> Column:
    return F.floor(F.coalesce(F.col("n_chars"), F.lit(0)) / 4).cast("long")


def inserts(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame, was: str) -> DataFrame:
    """Counts that replace the ones in the column was."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col(was)).alias("tokens"))


class Rollup:
    """The committed batches below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, batch: str) -> str:
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> str | None:
        """The folder of the try that counts, if the batch is committed. Of tries that were marked at the same time, all whole, it is the first by name."""
        marks = sorted(x for x in listed(self.spark, self._at(batch)) if x.startswith(MARK))
        return f"{self._at(batch)}/{marks[0].removeprefix(MARK)}" if marks else None

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add up and commit a batch of signed rows (source, lang, tokenizer, docs, tokens); False, without any work, if it is committed already.

        A hot source is added up in each task before its sums meet, so no task sees its rows.
        """
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        this = f"try-{uuid.uuid4().hex}"
        sums.select(*(F.col(f.name).cast(f.dataType) for f in DELTAS)).write.parquet(f"{self._at(batch)}/{this}")
        marked(self.spark, f"{self._at(batch)}/{MARK}{this}")
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over those of the named batches that are committed; keys without documents and tokens are left out."""
        there = [at for b in dict.fromkeys(batches) if (at := self.committed(b))]
        rows = self.spark.read.schema(DELTAS).parquet(*there) if there else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def token_totals(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after three batches: all documents inserted with a token count estimated as a quarter of n_chars, the counts revised to exact ones for each tokenizer version, and the documents labelled toxic deleted.

    docs: doc_id, source, lang, text, n_chars; labels: doc_id, toxic; other
    columns are ignored. Null sources and languages are keys of their own, null
    n_chars count as 0. A repeated document counts as often as it is there; a
    document labelled more than once is toxic if any label says so. Rows with a
    null id are never deleted. No rows: an empty result.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, path or scratch(spark, "token_rollup"))
    counts = staged(counted(docs), "token_counts")
    rollup.commit("load", inserts(counts, "was"))
    rollup.commit("recount", revisions(counts, "was"))
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    rollup.commit("withdraw", deletes(counts.join(toxic, "doc_id", "left_semi")))
    return rollup.totals(["load", "recount", "withdraw"])
