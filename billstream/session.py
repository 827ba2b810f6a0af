"""Scratch folders shared by driver and executors, and what is stored there.

A stored table is a folder of batches (``batch=<name>``). What has been
committed is told by empty marker files below ``_committed``, made in one step
when a batch is whole; readers take no other batch. A snapshot folds all batches
up to one into a folder of its own; from its marker on, it stands for them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset: an error on a cluster, as executors share no other folder; on one machine, below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="billstream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The file system that Spark uses for path, and path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store Spark reads it from."""
    store, at = _store(spark, path)
    return store.exists(at)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    store, at = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file of that name, made in one step."""
    store, at = _store(spark, path)
    store.createNewFile(at)


def _delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


@contextmanager
def kept(rows: DataFrame, path: str) -> Iterator[DataFrame]:
    """rows, written to a folder once and read from there in this block; then the folder goes. For wide rows that several jobs read: a cache would build their columns in memory, ten thousand rows at a time, and spill them as they are; here a job reads the columns it needs, compressed. What a broken try left is replaced."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path, compression="zstd")
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        _delete(spark, path)


def append(rows: DataFrame, table: str, batch: str | int, partition_by: tuple[str, ...] = ()) -> bool:
    """Append rows to the table in a folder as one batch. A batch that was committed is not written again (False), so a retry adds nothing and loses nothing; what a broken try left is replaced."""
    spark = rows.sparkSession
    if exists(spark, f"{table}/_committed/{batch}"):
        return False
    rows.write.partitionBy(*partition_by).mode("overwrite").parquet(f"{table}/batch={batch}", compression="zstd")
    _mark(spark, f"{table}/_committed/{batch}")
    return True


def committed(spark: SparkSession, table: str) -> list[str]:
    """The names of the batches that are whole."""
    return sorted(_listed(spark, f"{table}/_committed"))


def _snapshot(spark: SparkSession, table: str) -> tuple[int, str] | None:
    """The last batch that the newest snapshot has in it, and the snapshot's folder."""
    found = [(int(n.split("-")[0]), n) for n in _listed(spark, f"{table}/_snapshots/_current")]
    return max(((k, f"{table}/_snapshots/{n}") for k, n in found), default=None)


def _schema(spark: SparkSession, schema: str | T.StructType) -> T.StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def stored(spark: SparkSession, table: str, schema: str | T.StructType, before: int | None = None) -> DataFrame:
    """The rows of a table's committed batches, with the column batch (in schema, too); of those before a number, if it is given. Batches that a snapshot has in it are read from there, as rows of its last batch."""
    schema = _schema(spark, schema)
    snapshot = _snapshot(spark, table)
    if snapshot and before is not None and snapshot[0] >= before:
        snapshot = None
    kept = [b for b in committed(spark, table) if (before is None or int(b) < before) and (snapshot is None or int(b) > snapshot[0])]
    rows = spark.read.schema(schema).option("basePath", table).parquet(*(f"{table}/batch={b}" for b in kept)) if kept else spark.createDataFrame([], schema)
    if snapshot:
        rows = rows.unionByName(spark.read.schema(schema).parquet(snapshot[1]))
    return rows


def compact(spark: SparkSession, table: str, schema: str | T.StructType, fold: Callable[[DataFrame], DataFrame], before: int | None = None, partition_by: tuple[str, ...] = ()) -> bool:
    """Fold the batches of a table (numbered; those before a number, if it is given) and its last snapshot into a new snapshot.

    fold takes rows with the column batch and gives the columns of schema but
    batch; partition_by is as in append(). The snapshot is written into a folder of its own and switched to by
    its marker: until then readers see the batches, and a try that broke off is
    never read. False if there is nothing new. Folded batches stay for readers
    that have begun; drop_folded() removes them.
    """
    last = max((int(b) for b in committed(spark, table) if before is None or int(b) < before), default=None)
    known = _snapshot(spark, table)
    if last is None or (known and known[0] >= last):
        return False
    name = f"{last}-{uuid.uuid4().hex}"
    rows = fold(stored(spark, table, schema, before=last + 1))
    rows.withColumn("batch", F.lit(last).cast(_schema(spark, schema)["batch"].dataType)).write.partitionBy(*partition_by).parquet(f"{table}/_snapshots/{name}", compression="zstd")
    _mark(spark, f"{table}/_snapshots/_current/{name}")
    return True


def drop_folded(spark: SparkSession, table: str) -> list[str]:
    """Remove the batches that the newest snapshot has in it, and older snapshots; once nothing reads them any more. Markers of batches stay, so none is written again."""
    known = _snapshot(spark, table)
    if not known:
        return []
    gone = [f"{table}/batch={b}" for b in committed(spark, table) if int(b) <= known[0]]
    old = [n for n in _listed(spark, f"{table}/_snapshots/_current") if not known[1].endswith(n)]
    for n in old:
        store, at = _store(spark, f"{table}/_snapshots/_current/{n}")
        store.delete(at, False)
    gone = [p for p in [*gone, *(f"{table}/_snapshots/{n}" for n in old)] if exists(spark, p)]
    for path in gone:
        _delete(spark, path)
    return gone
