"""Secret scans over an incremental blob ledger.

Every version of every document is a blob, addressed by the SHA-256 of its
text. The ledger, a Parquet table, holds the findings of each (blob, rule
version) pair scanned so far; a scan opens the pairs it lacks only, once each
however many documents share the text, appends them, and joins the findings
back to all documents.

Texts stay where they are, as far as they can. Which rows are to be left out,
as copies or as seen, is found from ids and blobs alone; a bitmap of fixed size
over these rows goes to all tasks. A row that isn't in it is scanned in its
place. One that is, and so may be among them, meets the exact list in a join.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Temporary, apart, exists, limit_batches, scratch, small_batches, staged

#: Kind, pattern, group whose length counts, least length. The first three kinds are the base.
BASE_KINDS = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
MORE_KINDS = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE_KINDS + MORE_KINDS
N_BASE = len(BASE_KINDS)
#: Bits of the bitmap: 16 MB at most, whatever the table. As it fills, more texts move.
BITMAP_BITS = 1 << 27
ARRIVALS = 2
NO_SPANS = hashlib.sha256(b"").hexdigest()
FINDINGS = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def rule_version(rules=RULES) -> str:
    """A name for a rule set that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def finder(rules=RULES):
    """text -> [(start, end, rule number)] by start, then rule. A rule's matches are leftmost and don't overlap; those too short are dropped, and don't free what they cover."""
    compiled = []
    for i, (kind, pattern, group, least) in enumerate(rules):
        # Where all of a match is one run of one class, runs that are too short can't hide a longer one; the engine may skip them.
        quick = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}.get(kind) if (kind, pattern, group, least) in BASE_KINDS else None
        compiled.append((i, re.compile(quick or pattern), group, least))

    def find(text: str) -> list[tuple[int, int, int]]:
        found = []
        for i, r, group, least in compiled:
            found += [(m.start(), m.end(), i) for m in r.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(found, key=lambda x: (x[0], x[2]))

    return find


def told(spans: list[tuple[int, int, int]], rules=RULES) -> str:
    return ",".join(f"{rules[i][0]}:{s}:{e}" for s, e, i in spans)


def _scan(version: str, rules=RULES):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(rules)
        for batch in batches:
            rows = []
            for blob, text in zip(batch["blob"], batch["text"], strict=True):
                spans = find(text)
                base = [x for x in spans if x[2] < N_BASE]
                n = [sum(x[2] == i for x in base) for i in range(N_BASE)]
                rows.append((blob, version, *n, hashlib.sha256(told(base, rules).encode()).hexdigest(), told(spans, rules)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FINDINGS.split(", ")])

    return run


def _blobs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, blob, __place of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("blob"))
    return rows.withColumn("__place", _place("doc_id", "blob"))


def _place(*columns: str) -> Column:
    """The bit for a row's values."""
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))


def _bitmap(rows: DataFrame) -> DataFrame:
    """__bucket, __bits: the places of rows as a bitmap, in pieces of 4 KB."""
    return rows.groupBy(F.bitmap_bucket_number("__place").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))


def _maybe_in(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """rows with the column __maybe instead of __place: whether it is set in the bitmap, which is small by its making and goes to all tasks."""
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number("__place")).join(F.broadcast(bitmap), "__bucket", "left")
    return joined.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__place", "__bucket", "__bits")


def scan_unseen(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> int:
    """Scan the blobs of docs that the ledger lacks for these rules and append them. Returns how many."""
    spark, version = docs.sparkSession, rule_version(rules)
    temporary = Temporary(spark)
    texts = _blobs(docs, doc_id, text)
    versions = temporary.staged(texts.drop("text"), "versions")
    # One row of each blob is opened, none of a blob that the ledger has. Rows that repeat id and text are one.
    first = versions.groupBy("blob").agg(F.min("doc_id").alias("first"))
    if exists(spark, ledger):
        first = first.join(read_ledger(spark, ledger).where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    first = temporary.staged(first.select(F.col("blob").alias("of"), "first"), "to_scan")
    opened = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("of"))
    repeated = versions.groupBy("doc_id", "blob", "__place").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    others = versions.join(first, opened, "left_anti").unionByName(repeated)
    rows = _maybe_in(texts, _bitmap(others))
    clear = rows.where("not __maybe").select("blob", "text")
    # Of these rows, which the bitmap can't clear, those to scan are kept, one each. Copies of one text have different ids, so they are dealt out by both.
    kept = rows.where("__maybe").join(first.hint("shuffle_hash"), opened, "left_semi").dropDuplicates(["doc_id", "blob"]).select("blob", "text")
    run = f"{ledger}/{uuid.uuid4().hex}"
    with small_batches(spark):
        clear.unionByName(kept).mapInPandas(_scan(version, rules), FINDINGS).write.parquet(run)
    temporary.drop()
    return spark.read.schema(FINDINGS).parquet(run).count()


def read_ledger(spark, ledger: str) -> DataFrame:
    return spark.read.schema(FINDINGS).option("recursiveFileLookup", "true").parquet(ledger)


def _known(spark, ledger: str, rules=RULES) -> DataFrame:
    """The ledger's blobs with spans, each once. Blobs without need no row, so joins move few, and Spark splits the rows of a hot blob."""
    found = read_ledger(spark, ledger).where((F.col("rule_version") == rule_version(rules)) & (F.col("spans") != ""))
    return staged(found.dropDuplicates(["blob"]).drop("rule_version"), "known_blobs")


def findings(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs, from the ledger."""
    versions = _blobs(docs, doc_id, text).select("doc_id", "blob")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = versions.join(_known(docs.sparkSession, ledger, rules), "blob", "left")
    return joined.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_sha256", F.lit(NO_SPANS)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def secret_spans(docs: DataFrame, ledger: str | None = None, arrivals: int = ARRIVALS) -> DataFrame:
    """Scan docs (doc_id, text; other columns are ignored) through the ledger and report on every row.

    The documents arrive in so many parts, by a hash of their id, and each is
    scanned for what the ledger lacks by then. Null and empty texts have no
    findings. Repeated rows stay; rows that share a doc_id are versions of one
    document and each has its own findings. Null ids are kept. Texts are
    scanned whole. No rows: an empty result.
    """
    ledger = ledger or scratch(docs.sparkSession, "secret_ledger")
    for k in range(arrivals):
        scan_unseen(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k), ledger)
    return findings(docs, ledger)


@apart
def redacted(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mark, overlapping spans by one, and n_chars, if there, counted anew. All rows and columns stay; texts without findings are unchanged."""
    ledger = ledger or scratch(docs.sparkSession, "secret_ledger")
    scan_unseen(docs, ledger)
    known = _known(docs.sparkSession, ledger).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, mark) for t, s in zip(text, spans, strict=True)])

    # Texts whose blob isn't among those with findings stay where they are, and don't go through Python.
    rows = docs.withColumn("__blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("__place", _place("__blob"))
    rows = _maybe_in(rows, _bitmap(known.select(_place("__blob").alias("__place"))))
    joined = rows.where("__maybe").join(known, "__blob", "left")
    kept = rows.where("not __maybe").select(*docs.columns).unionByName(joined.where("__spans is null").select(*docs.columns))
    clean = joined.where("__spans is not null").withColumn("text", cut("text", "__spans"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return limit_batches(kept.unionByName(clean.select(*docs.columns)))


def without(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    for x in spans.split(","):
        _, s, e = x.split(":")
        s, e = int(s), int(e)
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
