"""A trie of conversation prefixes, by fingerprints that compose.

A sequence of turns is known by an element of a monoid: its length n and, for
each of some moduli, the sum of its turns' residues times B^place. Two elements
in a row make (n1 + n2, s1 + B^n1 * s2), so the prefixes of a conversation that
is put together from another's head and its own suffix are had from the products
of both parts; no text is moved, nor written out again. Running products of long
conversations are composed likewise, from ranges of turns.

Prefixes with one fingerprint are a node. In each such group, all last turns
must have one reference (the SHA-256 of role and text, kept with each turn) and
all prefixes one fewer turns long one fingerprint; so, by induction, equal
fingerprints are equal sequences. If a group fails this, everything is computed
with other bases.

What a node says of its subtree is a sum over its members: a conversation leads
the nodes of which it is the smallest member, from some depth on, and each node
below is led by one member. So nothing walks up or down the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Temporary, limit_batches, small_batches, staged

HEAD, EVERY = 5, 100
#: Turn numbers of a conversation that are ranked and summed together.
RANGE_TURNS = 1000
#: The largest four primes below 2^31.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
S = [f"s{k}" for k in range(len(MODULI))]
#: Places below 2^30, five digits of a base of 64.
DIGITS, DIGIT_BITS = 5, 6
CHUNK_IDS = 4096


def _bases(seed: int) -> list[int]:
    """A base for each modulus."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{p}".encode()).digest()[:8], "big") % (p - 1000) + 500 for p in MODULI]


def _power(base: int, p: int, place: Column) -> Column:
    """base^place modulo p, for places below 2^30."""
    out = None
    for d in range(DIGITS):
        step = pow(base, 1 << (DIGIT_BITS * d), p)
        of = F.get(F.lit([pow(step, k, p) for k in range(1 << DIGIT_BITS)]).cast("array<bigint>"), F.shiftright(place, DIGIT_BITS * d).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
        out = of if out is None else (out * of) % p
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), ref, len, and range of every turn of conversations (conv_id, turn, role, text).

    Null turns come first; turns of one number are in the order of their
    references. Turn numbers are cut into ranges, so that a very long
    conversation is spread over tasks.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    ref = F.unhex(F.sha2(F.concat(F.char_length(given("role")).cast("string"), F.lit(":"), given("role"), given("text")).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), ref.alias("ref"), F.char_length(given("text")).cast("long").alias("len"))
    rows = rows.withColumn("range", F.floor(F.col("turn") / RANGE_TURNS))
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), before.alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "ref"))
    ranked = rows.withColumn("inside", inside).join(counts, (F.col("conv_id") == F.col("c")) & F.col("range").eqNullSafe(F.col("r")))
    return ranked.select("conv_id", (F.col("before") + F.col("inside") - 1).cast("long").alias("place"), "ref", "len", "range")


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (conv_id, place, range) with the sums of columns by over all turns of the conversation up to each, as sum_<column>: sums of ranges first, then inside a range."""
    key = ["conv_id", "range"]
    sums = rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in by))
    earlier = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in by))
    inside = W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(inside).alias(f"inside_{c}") for c in by)).join(sums, (F.col("conv_id") == F.col("c")) & F.col("range").eqNullSafe(F.col("r")))
    return out.select(*rows.columns, *((F.col(f"before_{c}") + F.col(f"inside_{c}")).alias(f"sum_{c}") for c in by))


def _fingerprint(*parts: list[Column]) -> Column:
    return F.struct(*((sum(x[1:], start=x[0]) % p).cast("long").alias(s) for s, p, *x in zip(S, MODULI, *parts, strict=True)))


def prefixes(conversations: DataFrame, temporary: Temporary, seed: int = 0) -> DataFrame:
    """conv_id, depth, total, len, before, fp, parent_fp, ref: a row for each prefix of each rebuilt conversation, the root's too. len: code points of the last text, before: of those ahead of it."""
    bases = _bases(seed)
    found = temporary.staged(turns(conversations), "turns")
    # Residues of turns, from the first bytes of the reference; the sums of a range stay below 2^63.
    residue = [F.conv(F.hex(F.substring("ref", 1 + 7 * k, 7)), 16, 10).cast("long") % p for k, p in enumerate(MODULI)]
    heads = found.where((F.col("conv_id") % EVERY == 0) & (F.col("place") < HEAD))
    heads = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "ref", "len", *(x.alias(s) for s, x in zip(S, residue, strict=True))))).alias("head"))  # HEAD turns at most
    convs = found.groupBy("conv_id").agg(F.max("place").alias("last"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    convs = convs.select("conv_id", h.alias("h"), F.greatest(F.col("last") + 1 - h, F.lit(0)).alias("own"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = temporary.staged(convs.select("conv_id", "h", head.alias("head"), (F.size(head) + F.col("own")).cast("long").alias("total")), "conversations")

    def summed(first: Column, s: str, base: int, p: int) -> Column:
        powers = F.lit([pow(base, k, p) for k in range(HEAD)]).cast("array<bigint>")
        terms = F.transform(first, lambda x: (x[s] * F.get(powers, x["place"].cast("int"))) % p)
        return F.aggregate(terms, F.lit(0).cast("long"), lambda total, x: (total + x) % p)

    def product(upto: Column) -> list[Column]:
        """The sums over the first turns of head."""
        return [summed(F.slice(F.col("head"), F.lit(1), upto), s, b, p) for s, b, p in zip(S, bases, MODULI, strict=True)]

    lengths = lambda upto: F.aggregate(F.slice(F.col("head"), F.lit(1), upto), F.lit(0).cast("long"), lambda a, x: a + x["len"])
    d = F.col("d")
    with_depth = convs.select("*", F.explode(F.sequence(F.lit(0), F.size("head"))).alias("d"))
    at = F.get("head", d - 1)
    of_heads = with_depth.select(
        "conv_id", d.cast("long").alias("depth"), "total", F.when(d > 0, at["len"]).otherwise(0).cast("long").alias("len"), F.when(d > 0, lengths(d - 1)).otherwise(0).cast("long").alias("before"),
        _fingerprint(product(d)).alias("fp"), F.when(d > 0, _fingerprint(product(d - 1))).alias("parent_fp"), F.when(d > 0, at["ref"]).alias("ref"),
    )

    # Own turns from h on. Their products count places as they stand; those of the head set them right.
    suffix = found.where(F.col("place") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1))
    suffix = suffix.select("conv_id", "place", "range", "ref", "len", *((x * _power(b, p, F.col("place")) % p).alias(s) for s, x, b, p in zip(S, residue, bases, MODULI, strict=True)))
    suffix = _running(suffix, ["len", *S])
    whole = convs.select(F.col("conv_id").alias("c"), "h", F.size("head").alias("k"), "total", lengths(F.size("head")).alias("head_len"), *(x.alias(f"head_{s}") for s, x in zip(S, product(F.size("head")), strict=True)))
    own = suffix.join(whole, F.col("conv_id") == F.col("c"))
    back = [F.get(F.lit([pow(b, -k, p) for k in range(HEAD + 1)]).cast("array<bigint>"), F.col("h") - F.col("k")) for b, p in zip(bases, MODULI, strict=True)]
    moved = lambda sums: [(x % p) * y % p for x, y, p in zip(sums, back, MODULI, strict=True)]
    heads_ = [F.col(f"head_{s}") for s in S]
    of_suffixes = own.select(
        "conv_id", (F.col("place") - F.col("h") + F.col("k") + 1).cast("long").alias("depth"), "total", "len", (F.col("head_len") + F.col("sum_len") - F.col("len")).alias("before"),
        _fingerprint(heads_, moved([F.col(f"sum_{s}") for s in S])).alias("fp"), _fingerprint(heads_, moved([F.col(f"sum_{s}") - F.col(s) for s in S])).alias("parent_fp"), "ref",
    )
    return of_heads.unionByName(of_suffixes)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids: batches are in the order of node and piece."""
    node, digest = None, None
    done: list[tuple] = []
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["leader", "depth", "ends_sha256"])
    for batch in batches:
        for leader, depth, ids in zip(batch.column("leader").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (leader, depth) != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (leader, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield give(done)
        done = []
    if node:
        yield give([(*node, digest.hexdigest())])


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow each other, as pieces of text of CHUNK_IDS or what a batch has: leader, depth, first, ids."""
    for batch in batches:
        rows: list[list] = []
        for leader, depth, c in zip(*(batch.column(x).to_pylist() for x in ("leader", "depth", "conv_id")), strict=True):
            if rows and rows[-1][:2] == [leader, depth] and len(rows[-1][3]) < CHUNK_IDS:
                rows[-1][3].append(str(c))
            else:
                rows.append([leader, depth, c, [str(c)]])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([",".join(r[3]) for r in rows], pa.string())], ["leader", "depth", "first", "ids"])


def _ends(rows: DataFrame, nodes: DataFrame, temporary: Temporary) -> DataFrame:
    """leader, depth, ends_sha256 of the nodes at which conversations end.

    A node's ids are strung together in ranges first, so that what meets in one
    task for a node with very many ends are a few long texts, one after the
    other; the digest takes them in order.
    """
    ends = rows.where("depth = total").select("conv_id", "depth", "fp")
    ends = ends.join(nodes.select("fp", "depth", "leader"), ["fp", "depth"]).select("leader", "depth", "conv_id")
    ordered = ends.repartitionByRange("leader", "depth", "conv_id").sortWithinPartitions("leader", "depth", "conv_id")
    pieces = temporary.staged(ordered.mapInArrow(_strung, "leader long, depth long, first long, ids string"), "ends")
    return pieces.repartition("leader", "depth").sortWithinPartitions("leader", "depth", "first").mapInArrow(_digested, "leader long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the trie of the rebuilt conversations.

    conversations: conv_id, turn, role, text; other columns are ignored. Null
    roles and texts are empty, null turns come first, turns of one number (and
    so repeated rows) are in the order of their digests. Rows without a conv_id
    belong to no conversation and are left out. Texts count whole. No
    conversations: an empty result, without a root.
    """
    spark = conversations.sparkSession
    for seed in range(100):
        temporary = Temporary(spark)
        rows = temporary.staged(prefixes(conversations, temporary, seed), "prefixes")
        check = F.struct("parent_fp", "ref")
        groups = rows.groupBy("fp", "depth").agg(
            F.min(F.struct("conv_id", "before")).alias("least"), F.max("total").alias("deepest"), F.min(check).eqNullSafe(F.max(check)).alias("sound"), F.min("parent_fp").alias("parent_fp")
        )
        nodes = temporary.staged(groups.select("fp", "depth", F.col("least.conv_id").alias("leader"), F.col("least.before").alias("before"), (F.col("deepest") == F.col("depth")).alias("leaf"), "parent_fp", "sound"), "nodes")
        if nodes.where("not sound").isEmpty():
            break
        temporary.drop()
    else:
        raise RuntimeError("no base without collisions")
    # From which depth on a conversation leads, the code points ahead of that turn, and whether it leads a leaf.
    leads = nodes.groupBy(F.col("leader").alias("c")).agg(F.min(F.struct("depth", "before")).alias("from_"), F.bool_or("leaf").alias("leaf"))
    leads = leads.select("c", F.col("from_.depth").alias("from_depth"), F.col("from_.before").alias("led_before"), "leaf")
    # Conversations that lead nothing have a copy of all of them with a smaller id: all their turns are saved.
    ends = rows.where("depth = total").select(F.col("conv_id").alias("e"), (F.col("before") + F.col("len")).alias("all_len"))
    ends = ends.join(leads, F.col("e") == F.col("c"), "left").select("e", "all_len", "from_depth", "led_before", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    of = rows.join(ends, F.col("conv_id") == F.col("e"))
    from_depth, ahead = F.coalesce("from_depth", F.col("total") + 1), F.coalesce("led_before", "all_len")
    summed = of.groupBy("fp", "depth").agg(
        F.count("*").alias("n_convs"),
        F.sum(((F.col("total") > F.col("depth")) & (from_depth <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(from_depth > F.col("depth"), ahead - F.col("before")).otherwise(0)).cast("long").alias("saved_tokens"),
    )
    whole = nodes.join(summed, ["fp", "depth"])
    # A node's leader leads the parent too, unless this is the first node that it leads.
    parents = nodes.select(F.col("fp").alias("parent_fp"), (F.col("depth") + 1).alias("below"), F.col("leader").alias("parent_leader"))
    first = nodes.join(leads.select("c", "from_depth"), F.col("leader") == F.col("c")).where("depth > 0 and depth = from_depth").select("leader", "depth", "parent_fp")
    first = first.join(parents, (first.parent_fp == parents.parent_fp) & (F.col("depth") == F.col("below"))).select(F.col("leader").alias("l"), F.col("depth").alias("d"), "parent_leader")
    whole = whole.join(first, (F.col("leader") == F.col("l")) & (F.col("depth") == F.col("d")), "left")
    digests = _ends(rows, nodes, temporary)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_leader", "leader"))
    out = whole.withColumn("parent_conv_id", parent).join(digests, ["leader", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select(F.col("leader").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    with small_batches(spark):
        result = staged(out, "trie")
    temporary.drop()
    return limit_batches(result)
