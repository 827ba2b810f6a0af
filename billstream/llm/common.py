"""Shared pieces of the training-data operators."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

#: A word of the word-based operators: a run of other characters than these.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: str.translate table that makes every word break a space.
TO_SPACE = {ord(c): " " for c in WORD_BREAKS}
#: str.translate table that lower-cases A-Z and makes every word break a space.
LOWER_TO_SPACE = TO_SPACE | {c: chr(c + 32) for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder. Where that is unset: an error on a cluster, as executors share no other folder; on one machine, below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that start inside send their Python tasks Arrow batches of about size bytes, or one row, if that is longer: a task's memory doesn't depend on how long texts are on average."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def limit_batches(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """df, for whose Python tasks the session's Arrow batches are limited to about size bytes from now on: for results that the caller runs. A smaller limit stays; the setting may be written in any of Spark's units."""
    spark = df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if now > size:
        spark.conf.set(BATCH_SETTING, str(size))
    return df


def apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, for tables whose columns may have any names: those that begin with two underscores, as the stage's own do, have others while it works."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (f"other{i}" for i in itertools.count() if f"other{i}" not in taken)
        names = [next(free) if c.startswith("__") else c for c in docs.columns]
        if names == docs.columns:
            return stage(docs, *args, **kwargs)
        return stage(docs.toDF(*names), *args, **kwargs).select(*names).toDF(*docs.columns)

    return run


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what follows no longer depends on its lineage."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Temporary:
    """Staged tables that are removed together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            store, at = _store(self.spark, path)
            store.delete(at, True)
        self.paths = []


def fold(df: DataFrame, doc_id: str = "doc_id", divisor: int = 5) -> Column:
    """crc32 of the id as text, modulo divisor; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def words(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased; none for null."""
    return [w for w in text.translate(LOWER_TO_SPACE).split(" ") if w] if text else []


class Recent(dict):
    """A bounded map that computes what it lacks. A key enters when it is asked for again, so that keys met once leave room for others; the entries of the last two generations stay."""

    MARKS = 1 << 21

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}
        self.met, self.marks = bytearray(self.MARKS), 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            mark = hash(key) % self.MARKS
            if not self.met[mark]:
                self.met[mark] = 1
                self.marks += 1
                if self.marks > self.MARKS // 4:
                    self.met, self.marks = bytearray(self.MARKS), 0
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _store(spark: SparkSession, path: str):
    """The file system that Spark uses for path, and path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store Spark reads it from."""
    store, at = _store(spark, path)
    return store.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    store, at = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def marked(spark: SparkSession, path: str) -> None:
    """An empty file of that name, made in one step."""
    store, at = _store(spark, path)
    store.createNewFile(at)
