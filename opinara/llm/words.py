"""Word spans and hashes of whole Arrow string columns, in numpy.

Words are told apart byte by byte, which is exact for UTF-8: every byte of a character
beyond ASCII is 0x80 or more. A word's hash is a polynomial of its bytes modulo 2**64,
mixed; it is the same on every executor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed values of the hash.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SEED = 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for ``i`` in ``0..n``."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        factors = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return have[: n + 1]


@dataclass
class Words:
    """Words of ``n`` texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray  # lower-cased bytes of all texts
    start: np.ndarray  # of each word, a byte position in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # of each text, in data

    def text(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")

    def strings(self) -> pa.Array:
        """All words as an Arrow column."""
        lengths = (self.end - self.start).astype(np.int64)
        offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offsets[1:])
        where = np.arange(offsets[-1]) + np.repeat(self.start - offsets[:-1], lengths)
        data = self.data[where]
        return pa.LargeStringArray.from_buffers(
            len(lengths), pa.py_buffer(offsets), pa.py_buffer(data)
        )


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the offset of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of each text of an Arrow string column; a null text has none."""
    raw, offsets = raw_bytes(column)
    n = len(offsets) - 1
    data = LOWER[raw] if lower else raw
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    left, right = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # a word ends where its text does
        left[cuts] = inside[1:-1][cuts]
        right[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, span_hash(data, start, end), first, offsets)


BLOCK = 1 << 16


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans may have any length and do not overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    value = (total[end] - total[start]) * powers(BASE_INVERSE, n)[start]
    return mix(value ^ ((end - start).astype(np.uint64) * np.uint64(SEED)))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes: ``len(words) - k + 1`` of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(BASE)
        out += mix(words[j : j + n] + np.uint64(SEED)) if j == 1 else words[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def grams_within(w: Words, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of the ``k``-word grams that lie within one text.

    ``whole_if_short``: a text of fewer than ``k`` words, but not none, gives one gram.
    """
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes = gram_hash(w.hash, k)
    same = owner[: len(hashes)] == owner[k - 1 :][: len(hashes)] if len(hashes) else np.zeros(0, bool)
    doc, value = owner[: len(hashes)][same], hashes[same]
    if whole_if_short:
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            own = np.array(
                [whole_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short], dtype=np.uint64
            )
            doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    return doc, value


def whole_hash(words: np.ndarray) -> int:
    return int(gram_hash(words, len(words))[0]) ^ len(words)
