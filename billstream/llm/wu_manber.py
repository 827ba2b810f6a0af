"""Benchmark passages in documents, by Wu-Manber search for many test strings at once.

The alphabet is words. A window is ten consecutive words of an item, or all of
them, if it has fewer. For windows of one length, a shift table says for each
block of a few words how far a search may move on, as no window could end
before; where the shift is 0, the block ends some window, and its hash names
the bucket of windows that do. Of these, one with the same hash of all words is
compared with the document, word for word.

Texts are searched many at a time: a cursor for every CHUNK words moves by its
own shifts. Windows are made from pieces of items of bounded length and come to
the tasks in blocks of about BLOCK_BYTES of text; a benchmark that needs several
blocks takes as many passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, small_batches, staged
from .shingles import PIECE, _pieces, _words

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 4096
CHUNK = 128
SPANS = "array<struct<start: long, end: long>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd; fixed value: 2^64 divided by the golden ratio
#: Bytes of words as they are, A-Z as small letters; all others are a space.
_PLAIN = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _PLAIN[_low:_high] = np.arange(_low, _high)
_PLAIN[65:91] = np.arange(97, 123)
_HELD = [("item_id", "string"), ("words", "binary"), ("n", "long")]


@dataclass
class Text:
    """Texts as one sequence of words: their bytes, each word's hash and place, and the word where each text begins, and the last ends."""

    data: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def words(self, a: int, b: int) -> bytes:
        """Words a to b, without b, joined by one space."""
        return b" ".join(self.data[self.begin[a] : self.end[b - 1]].tobytes().split())


def read(texts: pa.Array) -> Iterator[Text]:
    """A column of texts, in order, in runs of about PIECE bytes or one text that has more. Null is a text without words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        own, starts = _PLAIN[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        if len(own) <= PIECE:
            found = [_words(own, starts[:-1])]
        else:
            found = [(h, begin + a, end + a) for a, b in _pieces(own) for h, begin, end in (_words(own[a:b], np.zeros(1, np.int64)),)]
        hashes, begin, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *2 * (np.empty(0, np.int64),))
        yield Text(own, hashes, begin, end, np.searchsorted(begin, starts))
        i = j


def _folded(hashes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words up to each of ends."""
    out = hashes[ends - size + 1].copy()
    for k in range(size - 2, -1, -1):
        out ^= out >> np.uint64(29)
        out *= _STEP
        out += hashes[ends - k]
    return out ^ (out >> np.uint64(32))


@dataclass
class Tables:
    """Windows of one length: shifts by block, the blocks that end windows, and the windows' keys (bucket and hash), in order; where each window's words are, and its items."""

    size: int
    block: int
    shift: np.ndarray
    suffixes: np.ndarray
    keys: np.ndarray
    texts: np.ndarray
    items: np.ndarray
    bounds: np.ndarray


@dataclass
class Patterns:
    """The windows of some pieces of items."""

    names: list[str]
    words: bytes
    tables: list[Tables]

    @staticmethod
    def compiled(pieces: list) -> Patterns:
        """pieces: item_id, words (joined by one space), n (words of the whole item)."""
        names = sorted({p.item_id for p in pieces})
        number = {name: i for i, name in enumerate(names)}
        pieces = sorted(pieces, key=lambda p: (min(p.n, WINDOW), p.item_id, bytes(p.words)))
        whole = b"\n".join(bytes(p.words) for p in pieces)
        out = Patterns(names, whole, [])
        if not pieces:
            return out
        text = _joined(whole)
        lengths = np.array([bytes(p.words).count(b" ") + 1 for p in pieces])
        first = np.cumsum(lengths) - lengths
        size = np.minimum([p.n for p in pieces], WINDOW)
        item = np.array([number[p.item_id] for p in pieces])
        for m in np.unique(size).tolist():
            of = np.flatnonzero(size == m)
            count = lengths[of] - m + 1
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(first[of], count) + inside
            out.tables.append(_tables(m, text, start, np.repeat(item[of], count)))
        return out

    def found(self, text: Text) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Whether each word is hit, and the occurrences: first word, text number, items."""
        hit, out = np.zeros(len(text.hashes) + 1, np.int64), []
        for t in self.tables:
            ends = _candidates(text.hashes, t)
            start = ends - t.size + 1
            of = np.searchsorted(text.bounds, ends, "right") - 1
            inside = text.bounds[of] <= start
            ends, start, of = ends[inside], start[inside], of[inside]
            bucket, there = _bucket(t, _folded(text.hashes, ends, t.block))
            ends, start, of, bucket = ends[there], start[there], of[there], bucket[there]
            keys = _keys(bucket, _folded(text.hashes, ends, t.size))
            low, high = np.searchsorted(t.keys, keys, "left"), np.searchsorted(t.keys, keys, "right")
            for k in np.flatnonzero(high > low).tolist():
                a = int(start[k])
                words = text.words(a, a + t.size)
                for w in range(low[k], high[k]):
                    if self.words[t.texts[w, 0] : t.texts[w, 1]] == words:
                        hit[a] += 1
                        hit[a + t.size] -= 1
                        out.append((a, int(of[k]), t.items[t.bounds[w] : t.bounds[w + 1]]))
        return np.cumsum(hit[:-1]) > 0, out


def _joined(words: bytes) -> Text:
    """A text of words as Text, whatever its length."""
    [text] = read(pa.array([words], pa.large_binary()).view(pa.large_string())) if words else [Text(np.empty(0, np.uint8), np.empty(0, np.uint64), *3 * (np.empty(0, np.int64),))]
    return text


def _keys(bucket: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28))


def _bucket(t: Tables, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash of a last block, and whether there is one."""
    at = np.minimum(np.searchsorted(t.suffixes, hashes), len(t.suffixes) - 1)
    return at, t.suffixes[at] == hashes


def _tables(m: int, text: Text, start: np.ndarray, item: np.ndarray) -> Tables:
    block = 3 if m >= 6 else min(m, 2)
    ends = start + m - 1
    farthest = m - block + 1
    bits = min(24, max(16, int(len(start) * 4).bit_length()))
    shift = np.full(1 << bits, farthest, np.uint8)
    for k in range(farthest - 1, -1, -1):  # blocks that end k words before a window's end, the nearest last
        shift[_folded(text.hashes, ends - k, block) & np.uint64(len(shift) - 1)] = k
    last = _folded(text.hashes, ends, block)
    suffixes = np.unique(last)
    keys = _keys(np.searchsorted(suffixes, last), _folded(text.hashes, ends, m))
    order = np.argsort(keys, kind="stable")
    ordered, place, one, items = keys[order], [], [], []
    # One entry for each window, with all its items; windows of one key are told apart by their words.
    cut = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1)) != 0)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        same: dict[bytes, list[int]] = {}
        for w in order[a:b].tolist():
            same.setdefault(text.words(start[w], start[w] + m) if b - a > 1 else b"", []).append(w)
        for each in same.values():
            place.append(a)
            one.append(each[0])
            items.append(np.unique(item[each]))
    texts = np.stack([text.begin[start[one]], text.end[ends[one]]], 1)
    return Tables(m, block, shift, suffixes, ordered[place], texts, np.concatenate(items), np.cumsum([0, *map(len, items)]))


def _candidates(hashes: np.ndarray, t: Tables) -> np.ndarray:
    """The words at which the search stopped: where the last block ends some window, or shares its place in the shift table with one that does."""
    at = np.arange(t.size - 1, len(hashes), CHUNK)
    limit, found, mask = np.minimum(at + CHUNK, len(hashes)), [np.empty(0, np.int64)], np.uint64(len(t.shift) - 1)
    while len(at):
        move = t.shift[_folded(hashes, at, t.block) & mask]
        found.append(at[move == 0])
        at = at + np.maximum(move, 1)
        on = at < limit
        at, limit = at[on], limit[on]
    return np.concatenate(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of items in pieces that share WINDOW - 1 words with the next."""
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
            words = _joined((text.as_py() or "").encode()) if text.is_valid else None
            n = len(words.hashes) if words else 0
            for a in range(0, max(1, n - WINDOW + 1) if n else 0, PIECE_WORDS):
                rows.append((name, words.words(a, min(n, a + PIECE_WORDS + WINDOW - 1)), n))
        names, data, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary()), pa.array(n, pa.int64())], [c for c, _ in _HELD])


def _search(patterns, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = patterns.value
        names = known.names
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for text in read(batch.column("text")):
                n = np.diff(text.bounds)
                counts += n.tolist()
                own, own_spans = [[] for _ in n], [[] for _ in n]
                hit, found = known.found(text)
                for _, of, its in found:
                    own[of].append(its)
                for of in {of for _, of, _ in found}:
                    edge = np.flatnonzero(np.diff(hit[text.bounds[of] : text.bounds[of + 1]].astype(np.int8), prepend=0, append=0))
                    own_spans[of] = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                spans += own_spans
                items += [[names[k] for k in np.unique(np.concatenate(x)).tolist()] if x else [] for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(id_name), pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], [id_name, "n_words", "spans", "items"])

    return run


def _united(spans: Column) -> Column:
    """Spans without overlaps, in order."""

    @F.pandas_udf(SPANS)
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for each in rows:
            one: list[dict] = []
            for a, b in sorted((x["start"], x["end"]) for x in each):
                if one and a <= one[-1]["end"]:
                    one[-1]["end"] = max(b, one[-1]["end"])
                else:
                    one.append({"start": a, "end": b})
            out.append(one)
        return pd.Series(out)

    return run(spans)


def benchmark_hits(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of hit words, end exclusive, in order, not touching), items (ids, sorted as strings) of every row of docs (doc_id, text), searched for the windows of items (item_id, text); other columns are ignored.

    Null and empty texts have no words and no hits, null or empty items no
    windows; an item without an id counts as that of the empty id. Rows of one
    item_id are one item with the windows of all of them. Repeated rows of docs
    and rows without an id stay. Texts count whole. No rows: an empty result.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = staged(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(_cut, ", ".join(map(" ".join, _HELD))), "windows")
    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = f"n_words long, spans {SPANS}, items array<string>"

    def searched(rows: DataFrame, block: int, of: str, of_kind: str) -> DataFrame:
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).distinct().collect()  # about block_bytes
        known = spark.sparkContext.broadcast(Patterns.compiled(mine))
        return limit_batches(rows.mapInArrow(_search(known, of), f"{of} {of_kind}, {kind}"))

    if blocks == 1:
        return searched(docs.select("doc_id", "text"), 0, "doc_id", id_kind)
    # Hits depend on texts alone, so blocks meet by the text's digest: at most a row for each text and block.
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("of")
    texts = docs.select(digest, "text")
    found = [staged(searched(texts, b, "of", "string").where("size(items) > 0").withColumn("block", F.lit(b)).distinct(), "hits") for b in range(blocks)]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = both.groupBy("of").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = Patterns([], b"", [])
    counted = docs.select(F.struct("doc_id", digest).alias("row"), "text").mapInArrow(_search(spark.sparkContext.broadcast(none), "row"), f"row struct<doc_id: {id_kind}, of: string>, {kind}").select("row.*", "n_words")
    joined = counted.join(both, "of", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return limit_batches(joined.select("doc_id", "n_words", empty("spans", SPANS), empty("items", "array<string>")).withColumn("spans", _united(F.col("spans"))))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)


def hit_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of benchmark_hits()."""
    found = benchmark_hits(docs, items)
    return found.select(
        "doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
