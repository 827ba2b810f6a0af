"""Language-model scores from a hashed maximum-entropy model.

P(word | context) = P(class | context) * P(word | class, context). The common
words fill classes of ``MEMBERS`` each, in order of frequency; rarer words
share classes by the hash of their ending, in which they are as likely as their
counts say. Both softmaxes add up hashed features of the context: the word
before, the word before that (a skip feature) and both (an n-gram feature).
Without features the model is the smoothed unigram model, from which training
starts.

Training is a pass over the training documents in rounds. In each, every task
takes gradient steps on its own split of the documents from the common weights
and returns what changed, in slices of rows; a slice's changes stream through
one task, which averages a row's by how often tasks used it. Tables have a
fixed size whatever the corpus; all words are counted, and words that are not
common are joined with their counts in Spark. A word is known by 64 bits: 59 of
a hash, and the class that its ending gives it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, staged
from .shingles import word_hashes

END = np.uint64(1)  # stands for the end of a text among the words' names
HEAD = 65_536  # words whose counts all tasks get
HEAD_CLASSES, MEMBERS, RARE_CLASSES = 32, 128, 32
CLASSES = HEAD_CLASSES + RARE_CLASSES
MODELLED = HEAD_CLASSES * MEMBERS
CONTEXTS = 2 * MODELLED + 1  # modelled words, hashes of others, the start of a text
PAIRS = 8192
ROWS = 4096
BATCH = 4096
RATE = 1.0
ROUNDS = 2
FOLDS, HELD_OUT = 5, 1
NONE = np.float32(-60.0)  # logit of an empty place in a class
FAR = np.float32(80.0)  # logits end there, so that their exponentials are floats
HELD_TOKENS = 1 << 21  # that are counted at once
SLICE_ROWS = 256  # of a table whose changes move together


def _with_ends(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts: the names of their words and ends, and where each text starts. A name ends in the number of the rare class that its word would have."""
    for words, bounds, endings in word_hashes(texts, True):
        n = len(bounds) - 1
        words &= ~np.uint64(RARE_CLASSES - 1)
        words |= (endings % RARE_CLASSES).astype(np.uint64)
        at = np.ones(len(words) + n, bool)
        at[bounds[1:] + np.arange(n)] = False
        tokens = np.full(len(words) + n, END, np.uint64)
        tokens[at] = words
        yield tokens, bounds[:-1] + np.arange(n)


def _kinds(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(RARE_CLASSES - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of so many texts and how often they are there."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "c"])

    for batch in batches:
        for tokens, _ in _with_ends(batch.column(0)):
            held.append(tokens)
            size += len(tokens)
            if size > HELD_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Vocabulary:
    """The common words, by rank, and what the model needs of each. Codes: the rank of a common word, HEAD for others."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: float, masses: list[float]):
        self.size = len(tokens)
        self.order = np.argsort(tokens, kind="stable")
        self.sorted = tokens[self.order] if self.size else np.zeros(1, np.uint64)
        self.log_count = np.log10(counts + 0.5)
        self.total = total
        self.modelled = min(self.size, MODELLED)
        n = np.arange(self.size)
        self.classes = np.where(n < self.modelled, n // MEMBERS, HEAD_CLASSES + _kinds(tokens))
        self.contexts = np.where(n < self.modelled, n, _hashed_context(tokens))
        self.log_mass = np.log10(np.array(masses, np.float64))  # of the rare classes
        weight = counts[: self.modelled] + 0.5
        by_class = np.bincount(np.arange(self.modelled) // MEMBERS, weight, HEAD_CLASSES) if self.modelled else np.zeros(HEAD_CLASSES)
        start = np.log(np.maximum(np.concatenate([by_class, masses]), 1e-30))
        self.class_bias = np.where(np.concatenate([by_class, np.ones(RARE_CLASSES)]) > 0, start, NONE).astype(np.float32)
        places = np.full(MODELLED, NONE, np.float32)
        places[: self.modelled] = np.log(weight)
        self.word_bias = places.reshape(HEAD_CLASSES, MEMBERS)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.order[at], HEAD) if self.size else np.full(len(tokens), HEAD)

    def features(self, tokens: np.ndarray, starts: np.ndarray):
        """Of each token: code, class, place in it (0 for rare ones), and rows in the tables."""
        codes = self.codes(tokens)
        common = codes < HEAD
        safe = np.where(common, codes, 0)
        cls, ctx = HEAD_CLASSES + _kinds(tokens), _hashed_context(tokens)
        if self.size:
            cls, ctx = np.where(common, self.classes[safe], cls), np.where(common, self.contexts[safe], ctx)
        w1 = np.concatenate([[CONTEXTS - 1], ctx[:-1]])
        w1[starts] = CONTEXTS - 1
        w2 = np.concatenate([[CONTEXTS - 1], w1[:-1]])
        w2[starts] = CONTEXTS - 1
        rows = {"before": w1, "skip": w2, "pair": ((w1 * 0x9E3779B1 + w2 * 0x85EBCA77) >> 7) % PAIRS, "word_before": ((w1 * 0x9E3779B1 + cls * 0xC2B2AE35) >> 5) % ROWS, "word_skip": ((w2 * 0x27D4EB2F + cls * 0x165667B1) >> 5) % ROWS}
        return codes, cls, np.where(cls < HEAD_CLASSES, codes % MEMBERS, 0), rows


def _hashed_context(tokens: np.ndarray) -> np.ndarray:
    return MODELLED + ((tokens >> np.uint64(20)) % np.uint64(MODELLED)).astype(np.int64)


def empty_tables() -> dict[str, np.ndarray]:
    rows = {"before": (CONTEXTS, CLASSES), "skip": (CONTEXTS, CLASSES), "pair": (PAIRS, CLASSES), "word_before": (ROWS, MEMBERS), "word_skip": (ROWS, MEMBERS)}
    return {k: np.zeros(s, np.float32) for k, s in rows.items()}


_ONES = {n: np.ones(n, np.float32) for n in (CLASSES, MEMBERS)}


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) in place, and its sums."""
    np.clip(z, -FAR, FAR, out=z)
    np.exp(z, out=z)
    return z, z @ _ONES[z.shape[1]]


def _of_classes(v: Vocabulary, tables, rows, b: slice) -> tuple[np.ndarray, np.ndarray]:
    z = np.take(tables["before"], rows["before"][b], axis=0)
    z += np.take(tables["skip"], rows["skip"][b], axis=0)
    z += np.take(tables["pair"], rows["pair"][b], axis=0)
    z += v.class_bias
    return _softmax(z)


def _of_words(v: Vocabulary, tables, rows, cls: np.ndarray, b: slice, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.take(tables["word_before"], rows["word_before"][b][head], axis=0)
    z += np.take(tables["word_skip"], rows["word_skip"][b][head], axis=0)
    z += np.take(v.word_bias, cls[b][head], axis=0)
    return _softmax(z)


def log_probabilities(v: Vocabulary, tables, cls, place, rows) -> np.ndarray:
    """log10 of each token's probability; of tokens in rare classes, that of the class."""
    out = np.empty(len(cls))
    for a in range(0, len(cls), BATCH):
        b = slice(a, a + BATCH)
        e, s = _of_classes(v, tables, rows, b)
        out[b] = np.log10(np.maximum(e[np.arange(len(e)), cls[b]] / s, 1e-30, dtype=np.float64))
        head = np.flatnonzero(cls[b] < HEAD_CLASSES)
        if len(head):
            e, s = _of_words(v, tables, rows, cls, b, head)
            out[a + head] += np.log10(np.maximum(e[np.arange(len(head)), place[b][head]] / s, 1e-30, dtype=np.float64))
    return out


def _summed(rows: np.ndarray, gradient: np.ndarray, few: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each is there, and the sums of their gradients: first, second, ... occurrences of all rows at once, frequent rows each for itself."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # no table has more rows; short integers are sorted by their digits
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(first, len(rows)))
    of = np.take(gradient, order, axis=0)
    g = np.take(of, first, axis=0)
    for r in range(1, few):
        more = np.flatnonzero(n > r)
        if not len(more):
            break
        g[more] += np.take(of, first[more] + r, axis=0)
    for i in np.flatnonzero(n > few).tolist():
        g[i] += of[first[i] + few : first[i] + n[i]].sum(0)
    return ordered[first], n, g


def _add_rows(table: np.ndarray, square: np.ndarray, used: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """An AdaGrad step for the rows of a table, repeated ones added up; square: of each row, the squares of all its gradients so far."""
    at, n, g = _summed(rows, gradient)
    s = square[at] + np.einsum("ij,ij->i", g, g)
    square[at] = s
    g *= (-RATE / np.sqrt(1.0 + s)).astype(np.float32)[:, None]
    g += np.take(table, at, axis=0)
    table[at] = g
    used[at] += n


def train_on(v: Vocabulary, tables, square, used, cls, place, rows) -> None:
    for a in range(0, len(cls), BATCH):
        b = slice(a, a + BATCH)
        e, s = _of_classes(v, tables, rows, b)
        e /= s[:, None]
        e[np.arange(len(e)), cls[b]] -= 1
        for k in ("before", "skip", "pair"):
            _add_rows(tables[k], square[k], used[k], rows[k][b], e)
        head = np.flatnonzero(cls[b] < HEAD_CLASSES)
        if len(head):
            e, s = _of_words(v, tables, rows, cls, b, head)
            e /= s[:, None]
            e[np.arange(len(e)), place[b][head]] -= 1
            for k in ("word_before", "word_skip"):
                _add_rows(tables[k], square[k], used[k], rows[k][b][head], e)


def _round(held):
    """name, slice, n, change: for each slice of a table what the task's steps changed: rows, how often they were used, differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, common = held.value
        tables = {k: t.copy() for k, t in common.items()}
        square, used = ({k: np.zeros(len(t), np.float32) for k, t in tables.items()} for _ in range(2))
        for batch in batches:
            for tokens, starts in _with_ends(batch.column(0)):
                train_on(vocabulary, tables, square, used, *vocabulary.features(tokens, starts)[1:])
        for k, t in tables.items():
            out = []
            for first in range(0, len(t), SLICE_ROWS):
                at = first + np.flatnonzero(used[k][first : first + SLICE_ROWS])
                if len(at):
                    change = (t[at] - common[k][at]).astype("<f2")
                    out.append((first // SLICE_ROWS, len(at), zstandard.compress((at - first).astype("<i4").tobytes() + used[k][at].astype("<f4").tobytes() + np.ascontiguousarray(change.view("u1").reshape(-1, 2).T).tobytes(), 3)))
            if out:
                number, n, packed = zip(*out, strict=True)
                yield pa.record_batch([pa.array([k] * len(out)), pa.array(number, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], names=["name", "slice", "n", "change"])

    return run


def _averaged(width: dict[str, int]):
    """name, slice, change: the mean change of each row of a slice, over sorted rows of _round(), one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, weight = None, None, None

        def told() -> pa.RecordBatch:
            mean = (total / np.maximum(weight, 1e-9)[:, None]).astype("<f4")
            return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([zstandard.compress(mean.tobytes(), 1)], pa.binary())], names=["name", "slice", "change"])

        for batch in batches:
            for name, number, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (name, number) != key:
                    if key:
                        yield told()
                    key, total, weight = (name, number), np.zeros((SLICE_ROWS, width[name])), np.zeros(SLICE_ROWS)
                raw = zstandard.decompress(packed)
                at, w = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<f4", n, 4 * n)
                change = np.ascontiguousarray(np.frombuffer(raw, "u1", offset=8 * n).reshape(2, -1).T).view("<f2").reshape(n, -1)
                total[at] += w[:, None] * change
                weight[at] += w
        if key:
            yield told()

    return run


def trained(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The tables after a pass over the texts in docs. A task returns as much as the tables hold at most; so does what comes to the driver."""
    sc = docs.sparkSession.sparkContext
    common = empty_tables()
    width = {k: t.shape[1] for k, t in common.items()}
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        changes = part.mapInArrow(_round(sc.broadcast((v, common))), "name string, slice int, n int, change binary")
        changes = changes.repartition("name", "slice").sortWithinPartitions("name", "slice").mapInArrow(_averaged(width), "name string, slice int, change binary")
        after = {k: t.copy() for k, t in common.items()}
        with small_batches(docs.sparkSession):
            found = changes.collect()
        for row in found:
            t = after[row.name][row.slice * SLICE_ROWS :][:SLICE_ROWS]
            t += np.frombuffer(zstandard.decompress(row.change), "<f4").reshape(-1, width[row.name])[: len(t)]
        common = after
    return common


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tokens array<long>"


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tables = held.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            a = 0
            for tokens, starts in _with_ends(batch.column(2)):
                codes, cls, place, rows = v.features(tokens, starts)
                score = log_probabilities(v, tables, cls, place, rows)
                common, rare = codes < HEAD, cls >= HEAD_CLASSES
                count = np.where(common, v.log_count[np.where(common, codes, 0)], 0.0) if v.size else np.zeros(len(codes))
                score += np.where(rare, count - v.log_mass[np.where(rare, cls - HEAD_CLASSES, 0)], 0.0)
                size = np.diff(np.append(starts, len(codes)))
                known = np.add.reduceat(common.astype(np.int64), starts)
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - known)]).astype(np.int32)), pa.array(tokens[~common].view(np.int64)))
                ids = batch.slice(a, len(starts))
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + len(starts))), ids.column(0), ids.column(1), pa.array(size), pa.array(known), pa.array(np.add.reduceat(count, starts) - size * v.total), pa.array(np.add.reduceat(score, starts)), others],
                    names=[c.split(" ")[0] for c in SCORED.split(", ")],
                )
                a, row = a + len(starts), row + len(starts)

    return run


def vocabulary_of(learn: DataFrame) -> tuple[DataFrame, Vocabulary, int]:
    """token, c of all words of the texts; what the model needs of the common ones; how many tokens there are."""
    counts = staged(learn.select("text").mapInArrow(_counted, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "word_counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    head = most_frequent(counts, HEAD)
    # What the words of each rare class weigh, and its unknown word.
    kind = F.col("token").bitwiseAND(F.lit(RARE_CLASSES - 1))
    mass = {r.kind: r.mass for r in counts.groupBy(kind.alias("kind")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect()}
    tokens, c = np.array([r.token for r in head], np.int64).view(np.uint64), np.array([r.c for r in head], np.float64)
    masses = np.array([mass.get(k, 0.0) + 0.5 for k in range(RARE_CLASSES)])
    np.subtract.at(masses, _kinds(tokens[:MODELLED]), c[:MODELLED] + 0.5)
    return counts, Vocabulary(tokens, c, math.log10(n + 0.5 * (v + 1)), np.maximum(masses, 0.5).tolist()), n


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n rows of largest c, ties by token. How many rows have each c is counted first, so that no task sends many more rows than are wanted."""
    left, least = n, None
    for r in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(n).collect():
        if r.k >= left:
            least = r.c
            break
        left -= r.k
    if least is None:
        rows = counts.collect()
    else:
        rows = counts.where(F.col("c") > least).collect() + counts.where(F.col("c") == least).orderBy("token").limit(left).collect()
    return sorted(rows, key=lambda r: (-r.c, r.token))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are an end only. Repeated rows are scored, and learned
    from, one by one; null ids count as the empty text for the fold. With
    nothing to learn from, all tokens are unknown. No rows: an empty result.
    Texts of any length count whole. score is a log10 probability under the
    model, base_score under the smoothed unigram model.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(docs, divisor=FOLDS) == HELD_OUT).alias("held_out"), "text")
    learn = rows.where("not held_out")
    counts, vocabulary, n = vocabulary_of(learn)
    tables = trained(learn, vocabulary) if n else empty_tables()
    scored = staged(rows.mapInArrow(_scored(spark.sparkContext.broadcast((vocabulary, tables))), SCORED), "scored")
    # Words beyond the common ones meet their counts in a join; both sides are spread by word.
    rest = scored.select("row", F.explode("tokens").alias("token")).join(counts.select("token", "c"), "token", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tokens").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )
