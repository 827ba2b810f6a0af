"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: its states say which token may follow, and the
correct tokenization of a word is its only path that spells the word. It is
built from the merges, in their order, by one merge gadget each. For a merge of
``a b`` into ``c`` the gadget

* copies the state that ``a`` leads to, without the arc ``b``, and lets ``a``
  lead to the copy (so ``a b`` can't be read any more); where no other token
  leads to that state, it is changed in place;
* adds an arc ``c`` beside every arc ``a``, leading to where ``a b`` led.

All arcs of one token lead to the same state, so the table of transitions is a
bit for each state and token, and a state for each token. It is compiled once,
in the driver, and goes to the tasks with equal states and tokens with equal
columns sharing theirs: some 20 MB for 50,000 merges, whatever the data.

Every beginning of a word has one path too. So one token ends at each place: of
those that spell the bytes before it, the only one for which the table has an
arc from the state at the token's own beginning. These are looked up from the
word's end, place by place, as far as they are needed.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, limit_batches

#: The pre-split of byte-level BPE.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Table:
    """bits: a row of bits for each different state; row: that of the state behind each token, -1 if no path has the token; column: the bit of each token. Row 0 is the start's."""

    bits: np.ndarray
    row: np.ndarray
    column: np.ndarray

    @staticmethod
    def compiled(labels: list[bytes], merges: list[tuple[int, int, int]]) -> Table:
        """labels: the bytes of each token id; merges: (left id, right id, merged id) by priority."""
        bits, to, users = np.zeros((1024, -(-len(labels) // 8)), np.uint8), [-1] * len(labels), [1]  # the start itself uses state 0
        for t in range(len(labels)):
            if len(labels[t]) == 1:
                bits[0, t >> 3] |= 1 << (t & 7)
                to[t] = 0
                users[0] += 1
        for a, b, c in merges:
            state = to[a]
            if to[c] >= 0 or state < 0 or not bits[state, b >> 3] >> (b & 7) & 1:
                continue  # a merge that can't happen any more, or whose token exists
            to[c] = to[b]
            users[to[b]] += 1
            if users[state] > 1:
                if len(users) == len(bits):
                    bits.resize((len(bits) + 2048, bits.shape[1]), refcheck=False)
                bits[len(users)] = bits[state]
                users[state] -= 1
                state = to[a] = len(users)
                users.append(1)
            bits[state, b >> 3] &= 255 ^ (1 << (b & 7))
            beside = bits[: len(users), a >> 3] >> (a & 7) & 1
            bits[: len(users), c >> 3] |= beside << (c & 7)
        # States with the same arcs share a row, tokens with the same bits in all rows a column.
        rows: dict[bytes, int] = {}
        of = [rows.setdefault(hashlib.sha256(bits[s]).digest(), len(rows)) if s >= 0 else -1 for s in (0, *to)]
        state = dict(zip(reversed(of), reversed((0, *to)), strict=True))
        kept = np.array([state[r] for r in range(len(rows))])
        columns: dict[bytes, int] = {}
        column = np.array([columns.setdefault(c.tobytes(), len(columns)) for c in _turned(bits, kept)][: len(labels)], np.int32)
        del bits
        shared = np.frombuffer(b"".join(columns), np.uint8).reshape(len(columns), -1)
        turned = np.empty((len(rows), -(-len(columns) // 8)), np.uint8)
        for r, c in zip(range(len(rows)), _turned(shared, np.arange(len(shared))), strict=False):
            turned[r] = c
        return Table(turned, np.array(of[1:], np.int32), column)


def _turned(bits: np.ndarray, rows: np.ndarray, block: int = 64) -> Iterator[np.ndarray]:
    """The columns of these rows of a matrix of bits as rows, block bytes of columns at a time."""
    for first in range(0, bits.shape[1], block):
        yield from np.packbits(np.unpackbits(bits[rows, first : first + block], axis=1, bitorder="little").T, axis=1, bitorder="little")


class TokenAutomaton:
    """Encodes words by a compiled table. labels: the bytes of each token id."""

    def __init__(self, labels: list[bytes], table: Table):
        rows = [r.tobytes() for r in table.bits]
        self.start, self.behind = rows[0], [rows[r] for r in table.row.tolist()]
        #: For each token the byte of its bit in a row, and the bit.
        self.byte, self.bit = (table.column >> 3).tolist(), (1 << (table.column & 7)).tolist()
        # The labels, read from their ends, as a tree: at each node byte -> (node below, its token or -1).
        leaf: dict = {}
        self.root: dict[int, tuple[dict, int]] = {}
        for t in sorted(np.flatnonzero(table.row >= 0).tolist(), key=lambda t: len(labels[t])):
            node, label = self.root, labels[t][::-1]
            for byte in label[:-1]:
                below, token = node.get(byte, (leaf, -1))
                if below is leaf:
                    below = {}
                    node[byte] = (below, token)
                node = below
            node[label[-1]] = (node.get(label[-1], (leaf, -1))[0], t)
        self.size = list(map(len, labels))

    def encode(self, word: bytes) -> list[int]:
        """The labels on the path that spells the word. The token that ends at a place is the one with an arc in the table from the state at its beginning, of which there is one; places that the word's last token doesn't depend on are left out."""
        byte, bit, behind, size, root = self.byte, self.bit, self.behind, self.size, self.root
        n = len(word)
        state, last, tokens = [None] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        state[0] = self.start
        todo, at = [], n
        while state[n] is None:
            some = tokens[at]
            if some is None:  # the tokens that end here, the longest last
                some, node, begin = [], root, at
                while begin:
                    begin -= 1
                    step = node.get(word[begin])
                    if step is None:
                        break
                    node, token = step
                    if token >= 0:
                        some.append(token)
                tokens[at] = some
            while True:
                token = some[-1]
                row = state[at - size[token]]
                if row is None:
                    todo.append(at)
                    at -= size[token]
                    break
                if row[byte[token]] & bit[token]:
                    last[at], state[at] = token, behind[token]
                    if todo:
                        at = todo.pop()
                    break
                some.pop()
        path = []
        while n:
            path.append(last[n])
            n -= size[last[n]]
        return path[::-1]


@dataclass
class Vocabulary:
    """A vocabulary file: the bytes of each token, special tokens, the compiled table."""

    labels: list[bytes]
    special: dict[str, int]
    table: Table

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in vocab.items():
            labels[i] = bytes(to_byte[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return Vocabulary(labels, special, Table.compiled(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))


class ByteBpe:
    """A byte-level BPE vocabulary: pre-split, special tokens, automaton."""

    def __init__(self, vocabulary: Vocabulary, cached: int = 150_000):
        self.special = vocabulary.special
        self.automaton = TokenAutomaton(vocabulary.labels, vocabulary.table)
        self.labels = list(vocabulary.labels)
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.pre_split = regex.compile(PRE_SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rare_space = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.of_word = Recent(lambda w: struct.pack(f"<{len(x := self.automaton.encode(w.encode()))}I", *x), cached)
        self.of_piece = Recent(lambda p: self._split(" " + p), cached)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.pre_split.findall(text)))

    def _plain(self, text: str) -> bytes:
        # A single space between other characters always begins a word of the pre-split, so it may be cut there; elsewhere the pre-split sees the text whole.
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.rare_space.search(text):
            return self._split(text)
        first, _, rest = text.partition(" ")
        return self._split(first) + (b"".join(map(self.of_piece.__getitem__, rest.split(" "))) if rest else b"")

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.at_special.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: Compiled vocabularies by application and path: in the driver as sent, in a worker process as read.
_SENT: dict[tuple[str, str], Broadcast] = {}
_LOADED: dict[tuple[str, str], ByteBpe] = {}


def sent(path: str) -> Callable[[], ByteBpe]:
    """What gives a task the vocabulary. It is compiled once an application and goes to all tasks: its size is that of the file and the table, whatever the data."""
    context = SparkSession.active().sparkContext
    key = (context.applicationId, path)
    if key not in _SENT:
        _SENT[key] = context.broadcast(Vocabulary.read(path))
    vocabulary = _SENT[key]

    def loaded() -> ByteBpe:
        if key not in _LOADED:
            _LOADED[key] = ByteBpe(vocabulary.value)
        return _LOADED[key]

    return loaded


def encoded(text: Column, vocabulary: str) -> Column:
    """struct(n_tokens, ids, decoded) of each text. Null and empty texts have no ids and decode to ''; texts of any length are taken whole."""

    loaded = sent(vocabulary)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded()
        for batch in batches:
            ids = [bpe.encode(t) for t in batch]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    return run(text)


def digests(text: Column, vocabulary: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): as encoded(), but only digests leave the worker."""

    loaded = sent(vocabulary)

    @F.pandas_udf(DIGESTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded()
        for batch in batches:
            ids = [bpe.encode(t) for t in batch]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]})

    return run(text)


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no ids and the digests of nothing. Repeated rows
    and null ids stay. Texts of any length count whole. No rows: an empty result.
    """
    return limit_batches(docs.select("doc_id", digests(F.col("text"), vocabulary).alias("r")).select("doc_id", "r.*"))
