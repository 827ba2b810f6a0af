"""Five-word shingle sets as sorted 64-bit hashes.

A word is a run of other bytes than space and tab to carriage return, A-Z
lower-cased. It is hashed in blocks of 64 bytes: a block's hash is a polynomial
of random numbers, one for each byte, taken from running sums over the whole
column; a word's adds up its blocks', each mixed with the block's number first,
so rearranged blocks differ, and the word's length. A shingle's hash mixes
those of its words. Hashes have 64 bits: two shingles of one pair of documents
that share a hash by chance are not to be expected in 10^10 pairs of long
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
PIECE = 1 << 18  # bytes hashed at once, or one word that has more
_BLOCK_BYTES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd; fixed value: 2^64 divided by the golden ratio
_BLOCK = np.uint64(0xD6E8FEB86659FD93)  # odd
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, np.uint64)[_LOWER]
_LETTER = (_LOWER % 31).astype(np.int32)
_BASE = 0xB5297A4D3F84D5B5  # odd
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in bytes that texts begin at starts of, where each word begins, and where it ends."""
    gap = _BREAK[data]
    first = np.ones(len(data) + 1, bool)  # a text begins, or ends, here
    first[1:-1] = gap[:-1]
    first[starts[starts < len(data)]] = True
    begin = np.flatnonzero(first[:-1] & ~gap)
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:] | first[1:-1]
    end = np.flatnonzero(last & ~gap) + 1
    size = end - begin
    up, down = (_UP, _DOWN) if len(data) <= PIECE else (_powers(_BASE, len(data) + 1), _powers(pow(_BASE, -1, 1 << 64), len(data) + 1))
    value = _VALUE[data]
    value *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    if len(size) and size.max() > _BLOCK_BYTES:
        blocks = -(-size // _BLOCK_BYTES)
        of, ahead = np.repeat(np.arange(len(size)), blocks), np.cumsum(blocks) - blocks
        number = np.arange(len(of)) - np.repeat(ahead, blocks)
        block = begin[of] + number * _BLOCK_BYTES
        h = (total[np.minimum(block + _BLOCK_BYTES, end[of])] - total[block]) * down[block]
        h = np.add.reduceat(_mix(h + number.astype(np.uint64) * _BLOCK), ahead)
    else:
        h = _mix((total[end] - total[begin]) * down[begin])
    return _mix(h + size.astype(np.uint64) * _STEP), begin, end


def _endings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below 31^3 for the last three bytes of each word."""
    out = _LETTER[data[end - 1]]
    for k, times in ((1, 31), (2, 961)):
        out += times * _LETTER[data[np.maximum(end - 1 - k, 0)]] * (end - begin > k)
    return out


def _shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text, from its words' hashes."""
    k = min(SHINGLE, len(words))
    h = np.full(len(words) - k + 1, len(words) if len(words) < SHINGLE else 0, np.uint64)
    for i in range(k):
        h *= _STEP
        h += words[i : len(words) - k + 1 + i]
        h = _mix(h)
    return _distinct(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """One long text in pieces that end at a gap (a longer word is a piece of its own)."""
    a, gaps = 0, np.flatnonzero(_BREAK[data])
    while a < len(data):
        i = np.searchsorted(gaps, a + PIECE)
        b = len(data) if a + PIECE >= len(data) else int(gaps[i - 1]) if i and gaps[i - 1] > a else int(gaps[i]) if i < len(gaps) else len(data)
        yield a, b
        a = b


def word_hashes(texts: pa.Array, with_endings: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """The column in runs of texts: the hashes of their words, one text after the other; for each text where its words begin, and the end of the last; the words' endings, if asked for. Null is a text without words."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        own = data[offsets[i] : offsets[i + 1]]
        if len(own) > PIECE:
            found = [(own[a:b], *_words(own[a:b], np.zeros(1, np.int64))) for a, b in _pieces(own)]
            words = np.concatenate([w for _, w, _, _ in found])
            yield words, np.array([0, len(words)]), np.concatenate([_endings(d, b, e) for d, _, b, e in found]) if with_endings else None
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        starts, run = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        words, begin, end = _words(run, starts[:-1])
        yield words, np.searchsorted(begin, starts), _endings(run, begin, end) if with_endings else None
        i = j


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a column of strings, in order; none for null and for texts without words."""
    for words, bounds, _ in word_hashes(texts):
        whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            whole *= _STEP
            whole += words[k : len(words) - SHINGLE + 1 + k] if len(whole) else 0
            whole = _mix(whole)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                yield np.empty(0, np.uint64)
            else:
                yield _distinct(whole[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _shingles(words[a:b])


def set_key(hashes: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
