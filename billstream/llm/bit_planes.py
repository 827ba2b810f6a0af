"""Token ids in bit-plane or byte-plane blocks, compressed plane by plane, with a chunk index.

The written form is two tables below one folder.

``blocks``: a row for each block of at most ``block_ids`` ids: its shard and
number in it, ``n_ids``, ``planes`` (the ids' bytes, or bits, of equal weight
side by side, each plane compressed by zstandard, lowest weight first) and
``parts``, the documents that the block holds a part of: document ordinals in
the shard, document ids, offsets of the part in its document, lengths.

``chunks``: the chunk index: for each block where it starts among all ids, how
many ids it has and the length of each plane, from which a reader can tell
which blocks and planes to fetch.

Shards are ranges of doc_id, cut at quantiles; ids are in ascending doc_id
order, rows of one doc_id in the order of a hash of their text, by which an id
with very many rows is cut too. Nothing is held whole: a task streams one
shard, and holds a block and a batch of documents.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, scratch, small_batches, staged

BLOCK_IDS = 1 << 16
SHARD_ROWS = 8192
MAX_SHARDS = 1 << 16  # beyond that many, shards hold more rows; their bounds go to all tasks
LEAST = -(1 << 63)
#: The pre-split of the word-level vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose composition, or lower case, could depend on their neighbours are among these.
BEYOND_LATIN = re.compile("[^\0-\u024f]")
BLOCKS = "shard int, block int, n_ids long, width int, planes array<binary>, parts binary"


def to_planes(ids: np.ndarray, unit: str = "byte", level: int = 3) -> list[bytes]:
    """The planes of unsigned 32-bit ids: 4 of bytes or 32 of bits, lowest weight first; planes of zeros above the largest id are left out."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    n_bytes = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    if unit == "byte":
        return [squeeze(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(n_bytes)]
    n_bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [squeeze(np.packbits(bits[:, k]).tobytes()) for k in range(n_bits)]


def from_planes(planes: list[bytes], n_ids: int, unit: str = "byte") -> np.ndarray:
    """The ids that to_planes() was given."""
    open_ = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n_ids, 4), "u1")
    if unit == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(open_(plane), "u1")
        return raw.view("<u4").reshape(-1)
    bits = np.zeros((n_ids, 32), "u1")
    for k, plane in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(open_(plane), "u1"), count=n_ids)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct piece between spaces once.

    White space never takes part in a token of this vocabulary, no character
    composes with it, and lower-casing goes by character: so a text's ids are
    those of its pieces, and the pre-split alone decides what the model sees.
    """

    def __init__(self, path: str, cached: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pre_split = regex.compile(PRE_SPLIT)
        self.model, self.symbols = self.library.model, self._symbols()
        self.of_word, self.of_piece = Recent(self._word, cached), Recent(self._piece, cached)

    @staticmethod
    def _symbols() -> dict[int, str]:
        from .bpe_automaton import byte_symbols

        return {b: s for s, b in byte_symbols().items()}

    def _piece(self, piece: str) -> bytes:
        if "<|" in piece:  # a special token, perhaps
            return _packed(self.library.encode(piece, add_special_tokens=False).ids)
        if not BEYOND_LATIN.search(piece):  # all composed; lower case goes by character
            normal = piece.lower()
        elif piece.isalpha():
            normal = self.library.normalizer.normalize_str(piece)
        else:
            return _packed(self.library.encode(piece, add_special_tokens=False).ids)
        return self._word(normal) if normal.isalpha() and normal.isascii() else b"".join(map(self.of_word.__getitem__, self.pre_split.findall(normal)))

    def _word(self, word: str) -> bytes:
        # Printable characters of ASCII are their own symbols.
        symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
        return _packed([t.id for t in self.model.tokenize(symbols)])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(map(self.of_piece.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def shard_cuts(doc_ids: DataFrame, shard_rows: int) -> np.ndarray:
    """Quantiles of the ids (one column; null counts as the least long), at most MAX_SHARDS - 1: where shards end. An id with many rows is there several times."""
    n = doc_ids.count()
    shards = min(MAX_SHARDS, -(-n // shard_rows))
    if shards < 2:
        return np.empty(0, np.int64)
    ids = doc_ids.select(F.coalesce(doc_ids.columns[0], F.lit(LEAST)).alias("id"))
    return np.sort(np.array(ids.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0], np.int64))


def shards_of(ids: np.ndarray, place: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The shard of each id. The rows of an id that is cut several times are spread by their place (unsigned 64 bits), so shards are in the order of (id, place)."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    return low + ((place >> np.uint64(32)) * (high - low).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def encode_ids(docs: DataFrame, vocabulary: str, end_id: int, cuts: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """shard, doc_id, place, n_tokens, ids of every row, end_id appended. ids: the byte planes, one after the other, without those of zeros; place: a hash of the text, by which rows of one id are ordered."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            n, out = [], []
            for t in batch.column(1).to_pylist():
                ids = np.frombuffer(enc.encode(t) + end, "u1").reshape(-1, 4).T
                n.append(ids.shape[1])
                out.append(ids[: _used(ids)].tobytes())
            key = batch.column(0).fill_null(LEAST).to_numpy()
            place = batch.column(2)
            shard = shards_of(key, place.to_numpy().view(np.uint64), held.value)
            yield pa.record_batch([pa.array(shard.astype(np.int32)), batch.column(0), place, pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["shard", "doc_id", "place", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    return rows.mapInArrow(run, "shard int, doc_id long, place long, n_tokens long, ids binary")


def _used(planes: np.ndarray) -> int:
    """How many of the byte planes, lowest first, there must be: at least one."""
    n = len(planes)
    while n > 1 and not planes[n - 1].any():
        n -= 1
    return n


def _into_blocks(block_ids: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, ordinal, held, parts = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, parts
            ids = np.concatenate(held) if held else np.empty(0, "<u4")
            row = pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([1 if unit == "bit" else 8], pa.int32()), pa.array([to_planes(ids, unit)], pa.list_(pa.binary())), pa.array([zstandard.compress(np.array(parts, "<i8").tobytes(), 3)], pa.binary())],
                names=["shard", "block", "n_ids", "width", "planes", "parts"],
            )
            number, held, parts = number + 1, [], []
            return row

        room = block_ids
        for batch in batches:
            for s, d, n, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, d, n = s.as_py(), d.as_py(), n.as_py()
                if s != shard:
                    if parts:
                        yield flush()
                    shard, number, ordinal, room = s, 0, 0, block_ids
                planes = np.frombuffer(packed.as_py(), "u1").reshape(-1, n)
                ids, at = np.zeros((n, 4), "u1"), 0
                ids[:, : len(planes)] = planes.T
                ids = ids.view("<u4").reshape(-1)
                while True:
                    take = min(room, n - at)
                    held.append(ids[at : at + take])
                    parts.append((ordinal, d is not None, d or 0, at, take, at + take == n))
                    at, room = at + take, room - take
                    if not room:
                        yield flush()
                        room = block_ids
                    if at == n:
                        break
                ordinal += 1
        if parts:
            yield flush()

    return run


def write_planes(encoded: DataFrame, path: str, n_shards: int, block_ids: int = BLOCK_IDS, unit: str = "byte") -> None:
    """Write encode_ids() rows below path. They move once, to the task of their shard."""
    spark = encoded.sparkSession
    sorted_ = encoded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", F.expr("shiftrightunsigned(place, 1)"), "place", "n_tokens", "ids")
    with small_batches(spark):
        sorted_.select("shard", "doc_id", "n_tokens", "ids").mapInArrow(_into_blocks(block_ids, unit), BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "n_ids", F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes"))
    inside = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks.join(F.broadcast(shard_starts(blocks)), "shard").select("shard", "block", (F.col("shard_start") + F.coalesce(inside, F.lit(0))).alias("start"), "n_ids", "plane_bytes").write.parquet(f"{path}/chunks")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, shard_start: ids before each shard. One row a shard, of which there are MAX_SHARDS at most."""
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))


# The crc of two joined runs of bytes, from theirs: that of the first, moved on by the second's length, xor that of the second.
def _times(matrix: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v, i = v >> 1, i + 1
    return out


#: What moves a crc on by 1, 2, 4, ... bytes, as far as lengths asked for it.
_MOVES: list[list[int]] = []


def _move(k: int) -> list[int]:
    while len(_MOVES) <= k:
        op = _MOVES[-1] if _MOVES else [0xEDB88320, *(1 << i for i in range(31))]  # fixed value: the polynomial; moves on by one bit
        for _ in range(1 if _MOVES else 3):
            op = [_times(op, v) for v in op]
        _MOVES.append(op)
    return _MOVES[k]


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32 of a + b from crc32(a), crc32(b) and len(b)."""
    for k in range(second_bytes.bit_length()):
        if second_bytes >> k & 1:
            first = _times(_move(k), first)
    return first ^ second


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, ordinal, doc_id, at, n, offset, ends, crc: the parts of documents in each block, from the blocks read back and opened. at: of the part in its document, offset: in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], "bit" if row["width"] == 1 else "byte").tobytes()
                p = np.frombuffer(zstandard.decompress(row["parts"]), "<i8").reshape(-1, 6)
                ends = np.cumsum(p[:, 4])
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), p[:, 4].tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(np.full(len(p), row["shard"]), pa.int32()), pa.array(np.full(len(p), row["block"]), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 2], mask=p[:, 1] == 0), pa.array(p[:, 3]), pa.array(p[:, 4]), pa.array(ends - p[:, 4]), pa.array(p[:, 5] != 0), pa.array(crc, pa.int64())],
                    names=["shard", "block", "ordinal", "doc_id", "at", "n", "offset", "ends", "crc"],
                )

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "shard int, block int, ordinal long, doc_id long, at long, n long, offset long, ends boolean, crc long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """shard, ordinal, doc_id, at, ids: the parts of documents with their ids, as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], "bit" if row["width"] == 1 else "byte")
                p = np.frombuffer(zstandard.decompress(row["parts"]), "<i8").reshape(-1, 6)
                cut = np.split(ids, np.cumsum(p[:, 4])[:-1])
                yield pa.record_batch([pa.array(np.full(len(p), row["shard"]), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 2], mask=p[:, 1] == 0), pa.array(p[:, 3]), pa.array([c.astype("i8") for c in cut], pa.list_(pa.int64()))], names=["shard", "ordinal", "doc_id", "at", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "shard int, ordinal long, doc_id long, at long, ids array<long>")


@F.pandas_udf(T.LongType())
def _joined_crc(parts: pd.Series) -> pd.Series:
    """The crc of each document from those of its parts, in order: [{n, crc}, ...]."""
    out = []
    for of in parts:
        crc = of[0]["crc"]
        for x in of[1:]:
            crc = crc32_joined(crc, x["crc"], 4 * x["n"])
        out.append(crc)
    return pd.Series(out, dtype="int64")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: each block is opened once, the chunk index says where it starts. A document in several blocks is joined from its parts' crcs; no other moves."""
    parts = staged(read_parts(spark, path), "id_parts")
    starts = spark.read.parquet(f"{path}/chunks").select("shard", "block", F.col("start").alias("block_start"))
    parts = parts.join(starts, ["shard", "block"]).withColumn("start", F.col("block_start") + F.col("offset"))
    whole = parts.where("at = 0 and ends").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    of = F.transform(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))), lambda x: F.struct(x.n.alias("n"), x.crc.alias("crc")))
    split = parts.where("not (at = 0 and ends)").groupBy("shard", "ordinal", "doc_id").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), of.alias("of"))
    return whole.unionByName(split.select("doc_id", "start", "n_tokens", _joined_crc("of").alias("ids_crc32")))


def plane_digests(docs: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None, shard_rows: int = SHARD_ROWS, block_ids: int = BLOCK_IDS, unit: str = "byte") -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored), write the file form, read it back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only. Repeated rows stay, null ids
    come first. No rows: no files' rows, and an empty result. Documents of any
    length are cut over as many blocks as they need.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "id_planes")
    cuts = shard_cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id")), shard_rows)
    write_planes(encode_ids(docs, vocabulary, end_id, cuts), path, len(cuts) + 1, block_ids, unit)
    return digest(spark, path)
