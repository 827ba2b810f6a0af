"""A training corpus from the documents table, in five stages.

Every stage takes all rows that its predecessor kept, whatever is null in them;
columns other than doc_id, text, lang, source and n_chars pass through, and an
empty table gives an empty result. Rows are judged one by one where their text
decides, so repeated rows stay together; where documents are compared or chosen,
an id stands for all its rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from billstream.llm.bpe_automaton import bpe_digests
from billstream.llm.common import staged, table
from billstream.llm.jaccard_join import one_of_each
from billstream.llm.language_profiles import identified
from billstream.llm.secret_ledger import redacted
from billstream.llm.source_budgets import chosen

#: Documents whose language is less certain than this, or that have no letters, go.
LEAST_CONFIDENCE = 0.4
#: The part of all tokens that the mix takes.
MIX_SHARE = 0.6
VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language that the profiles can tell: null texts, texts without letters, and all if no row has a language to learn from."""
    return identified(docs, LEAST_CONFIDENCE)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, with all rows of that id. Rows without an id stay, and so do documents without words."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks secrets out; all rows stay, null texts as they are."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the target weights ask for; null languages and sources are leaves of their own, null texts have no tokens."""
    return chosen(docs, MIX_SHARE)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens and digests of every row; null texts have no tokens."""
    return bpe_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language ID", language_id), ("Jaccard join", jaccard_join), ("secret scan", secret_scan), ("source mix", source_mix), ("BPE", bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
