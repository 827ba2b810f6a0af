"""N-gram Jaccard join over a token-group matrix.

Documents are sets of shingle hashes ("tokens"); two of them link at a Jaccard
similarity of 0.8 or more. The join is exact and lists no pairs within groups:

1. Equal sets are one class, named by its smallest doc_id (a *node*).
2. All tokens have one order: those that a count sketch says are common last,
   others by hash. Linked sets share a token within the first fifth of either,
   so only such *prefixes* are compared.
3. Similar nodes are put in groups: for each token, the nodes that have it are
   compared with one of them, the leader, whose tokens are the most common
   ones of all (of near copies, it tends to be the original). A node joins the
   group of a leader that it links with.
4. The matrix has, for each group, the union of its members' prefix tokens. A
   node asks the groups that have its first tokens, and gets a bound of its
   overlap with each: the shared ones up to where the first of these members'
   prefixes ends, and all its tokens behind those. Groups that could not hold a
   linked set as large as the node by that bound, or by size, stay closed.
5. The others are opened: the node is held against the union of the members'
   whole sets, in chunks of bounded bytes, and then against the members.
6. Links of 3 and 5 and classes give the components.

The sketch and the bitmaps that say which sets are needed have fixed sizes; on
larger tables they get less selective, which costs time but no link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Temporary, apart, small_batches, staged
from .components import components
from .shingles import set_key, shingle_sets

PERCENT = 80
SLOTS = 1 << 24  # of the sketch
BITS = 1 << 27  # of a bitmap
SLICE = 1 << 16  # bytes
COMMON = 32  # documents with a token that make it a common one, besides what a slot holds by chance
EXTRA = 4  # per cent of a set, and tokens, by which a group's prefixes are longer than a query's
CHUNK_TOKENS = 1 << 18  # of members, and of queries, that a task holds at once, or one set that has more
SHIFT = np.uint64(40)  # a token's slot: its first 24 bits
TOP = 1 << 63  # tokens are in unsigned order: with the top bit flipped, they have it as longs


def prefix(n: int) -> int:
    """How many first tokens of a set of n are compared: among them is a token of any set that it links with."""
    return n - (-(-PERCENT * n // 100)) + 1


def short_prefix(n: int) -> int:
    """The same for sets that are as large or larger, whose own prefix is compared."""
    return n - (-(-2 * PERCENT * n // (100 + PERCENT))) + 1


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(counts.reshape(-1, SLICE).any(1))
    if len(used):
        packed = [zstandard.compress(counts[i * SLICE : (i + 1) * SLICE].tobytes(), 1) for i in used]
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], names=["slice", "counts"])


def _gathered(slices: DataFrame, merged, size: int) -> np.ndarray:
    """One array of size bytes from the tasks' slices. A slice's pieces, one a task, stream through the task that merges them, which holds one of them at a time; what comes back has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for k, own in itertools.groupby(pieces, key=lambda x: x[0]):
            whole = merged(zstandard.decompress(c.as_py()) for _, c in own)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zstandard.compress(whole.astype(np.uint8).tobytes(), 3)], pa.binary())], names=["slice", "counts"])

    out = np.zeros(size, np.uint8)
    with small_batches(slices.sparkSession):
        for r in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, counts binary").collect():
            out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(zstandard.decompress(r.counts), np.uint8)
    return out


def sketch(slices: DataFrame, steps: tuple[int, ...]) -> np.ndarray:
    """How many of the steps each slot's total reaches."""

    def merged(pieces) -> np.ndarray:
        total = np.zeros(SLICE, np.int64)
        for c in pieces:
            total += np.frombuffer(c, np.uint8)
        return sum((total >= step).astype(np.uint8) for step in steps)

    return _gathered(slices, merged, SLOTS)


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 27)).astype(np.int64)


def among(ids: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which ids may be among those that a bitmap was made of."""
    bit = _bit_of(ids)
    return (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits, those of the ids (one long column) set: an id whose bit isn't set is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.unique(_bit_of(batch.column(0).to_numpy())) for batch in batches]
        bits = np.unique(np.concatenate(bits)) if bits else np.empty(0, np.int64)
        number, first = np.unique(bits // (8 * SLICE), return_index=True)
        for k, own in zip(number.tolist(), np.split(bits, first[1:]), strict=False):
            piece = np.zeros(8 * SLICE, np.uint8)
            piece[own - k * 8 * SLICE] = 1
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zstandard.compress(np.packbits(piece, bitorder="little").tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def merged(pieces) -> np.ndarray:
        whole = np.zeros(SLICE, np.uint8)
        for c in pieces:
            whole |= np.frombuffer(c, np.uint8)
        return whole

    return _gathered(ids.mapInArrow(run, "slice int, counts binary"), merged, BITS // 8)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, key of each document; at the end the task's token counts."""
    counts = np.zeros(SLOTS, np.uint8)
    for batch in batches:
        n, keys = [], []
        for h in shingle_sets(batch.column(1)):
            n.append(len(h))
            keys.append(set_key(h) if len(h) else None)
            slot = (h >> SHIFT).astype(np.int64)
            counts[slot] += counts[slot] < 255  # a task's count stops there: far beyond what makes a token common
        none = pa.nulls(len(n))
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "n", "key", "slice", "counts"])
    for s in _slices(counts):
        none = pa.nulls(s.num_rows)
        yield pa.record_batch([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), s.column(0), s.column(1)], names=["doc_id", "n", "key", "slice", "counts"])


#: The prefix tokens of each node; with the first also n, asks (how many of them it asks groups about), last (the last of these), end (the last of all; both with the top bit flipped) and bare (share of rare tokens).
PREFIXES = "token long, node long, place int, n int, asks int, last long, end long, bare int"


def _marked(batch: pa.RecordBatch, marked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """id and set of the rows whose id is marked."""
    ids = batch.column(0).to_numpy()
    rows = np.flatnonzero(among(ids, marked))
    for i, h in zip(rows.tolist(), shingle_sets(batch.column(1).take(pa.array(rows))), strict=True):
        if len(h):
            yield int(ids[i]), h


def _prefixes(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, marked = held.value
        rows, nodes, size = [], [], 0

        def flush() -> pa.RecordBatch:
            far = np.array([len(r) for r in rows])
            first = np.cumsum(far) - far
            own = np.array(nodes, np.int64).reshape(-1, 6)
            at_first = np.ones(far.sum(), bool)
            at_first[first] = False
            spread = [np.zeros(far.sum(), np.int64) for _ in range(5)]
            for k, x in enumerate(spread):
                x[first] = own[:, k + 1]
            return pa.record_batch(
                [pa.array(np.concatenate(rows)), pa.array(np.repeat(own[:, 0], far)), pa.array((np.arange(far.sum()) - np.repeat(first, far) + 1).astype(np.int32)), *(pa.array(x.astype(t), mask=at_first) for x, t in zip(spread, (np.int32, np.int32, np.int64, np.int64, np.int32), strict=True))],
                names=[c.split(" ")[0] for c in PREFIXES.split(", ")],
            )

        for batch in batches:
            for node, h in _marked(batch, marked):
                n, often = len(h), level[(h >> SHIFT).astype(np.int64)]
                p = prefix(n)
                # Order keys: common tokens have the top bit, others don't; the other bits are the hash's.
                key = (h >> np.uint64(1)) | ((often >= 2).astype(np.uint64) << np.uint64(63))
                far = min(n, p + EXTRA * n // 100 + EXTRA)
                first = np.sort(np.partition(key, far - 1)[:far])
                rank = (first ^ np.uint64(TOP)).view(np.int64)
                first = first.view(np.int64)
                rows.append(first)
                # All rare tokens of the prefix give a good bound; common ones are asked about only as far as they must be.
                asks = max(short_prefix(n), min(p, int(np.count_nonzero(first >= 0))))
                nodes.append((node, n, asks, rank[asks - 1], rank[-1], 1000 * np.count_nonzero(often == 0) // n))
                size += far
                if size > 200_000:
                    yield flush()
                    rows, nodes, size = [], [], 0
        if rows:
            yield flush()

    return run


def _shared(held):
    """The rows whose token is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(batch.column(0).to_numpy(), held.value)))

    return run


def _sets(held):
    """node, set: the packed sets of the marked nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_marked(batch, held.value))
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([h.tobytes() for _, h in found], pa.binary())], names=["node", "set"])

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets_link(a: str, b: str) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return run(a, b)


def _found(key, members: pd.DataFrame, queries: pd.DataFrame, every: bool) -> pd.DataFrame:
    """The links of the queries with a chunk of a group: one a query, or every one. Of two groups' pair the larger set is in the asked group; of two alike, that of the later group asks."""
    out = []
    if len(members) and len(queries):
        sets = [np.frombuffer(s, np.uint64) for s in members["set"]]
        size = np.array(list(map(len, sets)))
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        nodes = members["node"].to_numpy()
        for q, own, packed in zip(queries["q"], queries["own"], queries["set"], strict=True):
            h = np.frombuffer(packed, np.uint64)
            lo, hi = np.searchsorted(tokens, h, "left"), np.searchsorted(tokens, h, "right")
            if 100 * np.count_nonzero(hi > lo) < PERCENT * len(h):
                continue  # the union has too few of its tokens
            long = hi - lo
            at = np.repeat(lo, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            both = np.bincount(of[at], minlength=len(sets))
            hit = np.flatnonzero((100 * both >= PERCENT * (len(h) + size - both)) & (nodes != q))
            if every:
                hit = hit[nodes[hit] > q] if own == key[0] else hit[(size[hit] > len(h)) | ((size[hit] == len(h)) & (own > key[0]))]
                out += [(min(q, x), max(q, x)) for x in nodes[hit].tolist()]
            elif len(hit):
                out.append((q, nodes[hit[0]]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _open(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    return _found(key, members, queries, False)


def _open_all(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    return _found(key, members, queries, True)


def _joined(docs: DataFrame, doc_id: str, text: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, Temporary]:
    """Documents (doc_id, n, key), classes (key, node), links of nodes (a, b) and what to drop when these have been read. The links are enough for the components, or all, each once with a < b: then members of a group are held against each other too."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with_id = texts.where("doc_id is not null and text is not null")
    early, temporary = Temporary(spark), Temporary(spark)
    seen = staged(texts.mapInArrow(_described, "doc_id long, n long, key binary, slice int, counts binary"), "shingle_sets")
    described = seen.where("slice is null").select("doc_id", "n", "key")
    load = (described.agg(F.sum("n")).first()[0] or 0) // SLOTS
    level = sketch(seen.where("slice is not null").select("slice", "counts"), (8 + 2 * load, COMMON + 4 * load))
    # Written out, so that a set with very many copies is split among tasks where rows meet their class.
    classes = staged(described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    marked = bitmap(classes.where("node is not null").select("node"))

    prefixes = early.staged(with_id.mapInArrow(_prefixes(spark.sparkContext.broadcast((level, marked))), PREFIXES), "prefixes")
    # Most tokens are one node's. They go before anything else of a row is moved.
    twice = bitmap(prefixes.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"))
    nodes = prefixes.where("place = 1").select("node", "n", "asks", "last", "end", "bare").dropDuplicates(["node", "n", "last"])
    rows = prefixes.select("token", "node", "place").mapInArrow(_shared(spark.sparkContext.broadcast(twice)), "token long, node long, place int")
    rows = early.staged(rows.join(nodes, "node"), "shared_tokens")
    tokens = rows.groupBy("token").agg(F.min(F.struct("bare", "node", "n")).alias("leader"), F.max("node").alias("most"), F.min("node").alias("least")).where("most > least").select("token", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
    shared = temporary.staged(rows.join(tokens, "token"), "with_leaders")
    early.drop()

    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * PERCENT) & (F.col(y) * 100 >= F.col(x) * PERCENT)
    # Pairs that share too few tokens for a link are left to step 4; a leader that leads some of the shared tokens only is met with four fifths.
    met = shared.where((F.col("node") != F.col("leader")) & fits("n", "leader_n")).groupBy("leader", "node", "n", "leader_n").agg(F.count("*").alias("hits"), F.max("place").alias("place"))
    lacking = (F.col("n") + F.col("leader_n")) * PERCENT / (100 + PERCENT) - (F.col("n") - F.floor(F.col("n") * (100 - PERCENT) / 100))
    stars = temporary.staged(met.where(F.col("hits") >= lacking * 0.8).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    sets = _sets_of(temporary, with_id, stars.select("a").unionByName(stars.select(F.col("b").alias("a"))))
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("set").alias(name))
    pairs = stars.join(of("b", "set_b"), "b").join(of("a", "set_a"), "a")
    star_links = temporary.staged(pairs.where(_sets_link("set_a", "set_b")).select("a", "b").distinct(), "star_links")

    # A group is named by its leader; leaders that joined another leader's group take their members along.
    group = star_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("group"))
    up = group.select(F.col("node").alias("group"), F.col("group").alias("up"))
    group = group.join(up, "group", "left").select("node", F.coalesce(F.least("up", "group"), "group").alias("group"))
    member = shared.drop("bare", "leader", "leader_n").join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    member = temporary.staged(member, "members")

    matrix = member.groupBy("token", "group").agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("end").alias("end"))
    query = member.where("place <= asks").select("token", F.col("node").alias("q"), F.col("group").alias("own"), F.col("n").alias("nq"), "place", "last", "asks")
    # Of a linked pair the smaller one asks; of two alike, the one of the later group.
    alike = (F.col("n_least") == F.col("nq")) & (F.col("n_most") == F.col("nq"))
    could = (F.col("own") != F.col("group")) & (F.col("n_most") >= F.col("nq")) & (F.col("nq") * 100 >= F.col("n_least") * PERCENT) & (~alike | (F.col("own") > F.col("group")))
    hit = F.struct(query.token.bitwiseXOR(F.lit(-TOP)).alias("rank"), "place")
    met = query.join(matrix, (query.token == matrix.token) & could).groupBy("q", "own", "group", "nq", "asks", "last").agg(F.collect_list(hit).alias("hits"), F.min("n_least").alias("n_least"), F.min("end").alias("end"))
    # Up to the least end among the members that were hit, all tokens shared with one of them are hits; any of the node's tokens behind its last hit up to there may be shared.
    met = met.withColumn("hits", F.filter("hits", lambda h: h["rank"] <= F.col("end")))
    behind = F.col("nq") - F.when(F.col("end") >= F.col("last"), F.col("asks")).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["place"])), F.lit(0)))
    # 0.8 of the union is 4/9 of the sum of the sizes, at least.
    need = (F.col("nq") + F.greatest("n_least", "nq")) * PERCENT / (100 + PERCENT)
    opened = met.where(F.size("hits") + behind >= need - 1e-6).select("q", "own", "group", "nq")
    in_groups = member.select("group", "node", "n").distinct()
    if every:
        opened = opened.unionByName(in_groups.join(group.select("group").distinct(), "group", "left_semi").select(F.col("node").alias("q"), F.col("group").alias("own"), "group", F.col("n").alias("nq")))
    opened = temporary.staged(opened.distinct(), "opened_groups")

    sizes = temporary.staged(in_groups.join(opened.select("group").distinct(), "group", "left_semi"), "opened_members")
    parts = lambda n: F.ceil(F.sum(n) / CHUNK_TOKENS).cast("int")
    plan = sizes.groupBy("group").agg(parts("n").alias("chunks")).join(opened.groupBy("group").agg(parts("nq").alias("rounds")), "group")
    plan = temporary.staged(plan, "opening_plan")
    sets = _sets_of(temporary, with_id, sizes.select("node").unionByName(opened.select(F.col("q").alias("node"))))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = sizes.join(plan, "group").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).join(of("node", "set"), "node").withColumn("round", upto("rounds")).select("group", "chunk", "round", "node", "set")
    asking = opened.join(plan, "group").withColumn("round", F.pmod(F.xxhash64("q"), F.col("rounds")).cast("int")).join(of("q", "set"), "q").withColumn("chunk", upto("chunks")).select("group", "chunk", "round", "q", "own", "set")
    by = ["group", "chunk", "round"]
    links = inside.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(_open_all if every else _open, "a long, b long")
    links = temporary.staged(links.distinct() if every else star_links.unionByName(links), "links")
    return described, classes, links, temporary


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; other columns are ignored.

    Null texts and texts without words have no shingles and are their own
    component. Rows with a null id get the component of an equal set, if there
    is one, else null, and link nothing. Repeated rows are equal sets; an id
    with several texts joins all that its texts link with. No rows: an empty
    result. Texts of any length count whole.
    """
    described, classes, links, temporary = _joined(docs, doc_id, text, False)
    found = components(links.unionByName(_of_one_id(described, classes)))
    temporary.drop()
    return _named(described, classes, found)


def _of_one_id(described: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the classes of an id that stands on rows of several sets belong together."""
    several = described.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("most")).where("key < most").select("doc_id")
    return described.join(several, "doc_id", "left_semi").where("key is not null").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def _named(described: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and, if found has it, n_links. Rows without shingles take part in no join."""
    counts = "far" in found.columns
    more = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("far", F.lit(0)) + F.col("k") - 1).cast("long").alias("n_links")] if counts else []
    whole = described.where("key is not null").join(classes, "key").join(found, "node", "left")
    whole = whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"), *more)
    bare = described.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if counts else []))
    return whole.unionByName(bare)


def jaccard_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: all linked pairs of different sets, each once, as the smallest doc_ids that have them, a < b. Rows are read as by jaccard_components; a group of m similar sets may have m * m / 2 pairs."""
    _, _, links, temporary = _joined(docs, doc_id, text, True)
    pairs = staged(links, "pairs")
    temporary.drop()
    return pairs


def jaccard_link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of jaccard_components and n_links: with how many other rows a row links, rows of an equal set among them. Rows with a null id, or without shingles, link with none."""
    described, classes, links, temporary = _joined(docs, doc_id, text, True)
    pairs = staged(links, "pairs")
    temporary.drop()
    held = described.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("k")).select("node", "k")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(held.select(F.col("node").alias("b"), "k"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("far"))
    found = components(pairs.unionByName(_of_one_id(described, classes)))
    return _named(described, classes, held.join(found, "node", "left").join(far, "node", "left"))


def _sets_of(temporary: Temporary, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of the nodes (one column, repeats allowed), from the texts."""
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(nodes))
    return temporary.staged(texts.mapInArrow(_sets(marked), "node long, set binary"), "sets")


@apart
def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id (all its rows, if the id is repeated). Rows without an id stay, and documents without shingles. Columns as they were. No rows: an empty result."""
    of = jaccard_components(docs).where("doc_id is not null and n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(of.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left_anti")
