"""Public tokenizers over whole Arrow columns, each distinct pre-token encoded once.

A byte-pair encoder treats every pre-token by itself, so the ids of a text are those of
its pre-tokens in order. Texts of ASCII and Latin letters, whose pre-tokens all engines
agree on, are cut by byte classes in numpy; their distinct pre-tokens go to the library
once per Python worker, as long as a bounded table keeps them. A text with any other
character, or with the string of an added token, goes through the library whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from opinara.llm.words import raw_bytes, span_hash

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

KEPT_PIECES = 1_500_000  # pre-tokens a Python worker keeps between runs, some 25 bytes each
BATCH_BYTES = 2_000_000  # texts are encoded in runs of about so many bytes

# Byte classes: letters, digits, white space, anything else, bytes of other characters.
LETTER, DIGIT, SPACE, OTHER, ODD = range(5)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[9, 10, 13, 32]] = SPACE
CLASS[[11, 12, *range(28, 32), 0, *range(1, 9), *range(14, 28), 127]] = ODD
CLASS[0x80:0xC3] = ODD  # continuation bytes are set by their lead byte
CLASS[0xC3:0xC9] = LETTER  # U+00C0 to U+0233
CLASS[0xC9:] = ODD
NOT_LETTERS = (0xC397, 0xC3B7, 0xC4B0)  # ×, ÷ and İ, whose lower case is two characters


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable character that byte-level encoders write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte, ODD where the fast path does not know the character."""
    kind = CLASS[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        lead = (data[high] >= 0xC3) & (data[high] <= 0xC8)
        at = high[lead]
        at = at[at + 1 < len(data)]
        after = data[at + 1]
        pair = data[at].astype(np.uint16) * 256 + after
        fine = (after >= 0x80) & (after < 0xC0) & ~np.isin(pair, NOT_LETTERS) & (pair <= 0xC8B3)
        kind[at[fine] + 1] = LETTER
        kind[at[~fine]] = ODD
    return kind


def contractions(data: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """Length of the contraction that each quote position starts, 0 if none."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b = padded[quote + 1], padded[quote + 2]
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    return np.where(one, 2, np.where(two, 3, 0))


def byte_pieces(data: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the byte-level encoder's pre-tokens; ``begins`` are starts of texts."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[begins] = True
    text_cut = np.zeros(n + 1, dtype=bool)
    text_cut[begins] = True
    # the last white space before a word stands apart, or joins it if it is a blank
    last = np.flatnonzero(cut[1:-1] & (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_cut[1:-1])
    cut[last] = True
    blanks = last[data[last] == 32]
    cut[blanks + 1] = False
    # a quote that starts a pre-token and is followed by one of a few endings
    quote = np.flatnonzero((data == 39) & cut[:-1] & cut[1:])
    return with_contractions(data, cut, quote, text_cut, kind)


def word_pieces(data: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the word encoder's pre-tokens, white space among them."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[begins] = True
    text_cut = np.zeros(n + 1, dtype=bool)
    text_cut[begins] = True
    quote = np.flatnonzero((data == 39) & cut[:-1] & cut[1:])
    return with_contractions(data, cut, quote, text_cut, kind)


def with_contractions(data, cut, quote, text_cut, kind) -> np.ndarray:
    if len(quote):
        quote = quote[~text_cut[quote + 1]]
        length = contractions(data, quote)
        inside = (length > 0) & ~((length == 3) & text_cut[np.minimum(quote + 2, len(data))])
        quote, length = quote[inside], length[inside]
        cut[quote + 1] = False
        ends = quote + length
        cut[ends[ends < len(data)]] = True
    return np.flatnonzero(cut[:-1])


class PieceTable:
    """Values of pre-tokens by hash: sorted arrays that grow with every batch."""

    def __init__(self, width: type):
        self.keys = np.zeros(0, np.uint64)
        self.lengths = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.pool = np.zeros(0, width)

    def find(self, keys: np.ndarray) -> np.ndarray:
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        if len(self.keys) == 0:
            return np.full(len(keys), -1)
        return np.where(self.keys[where] == keys, where, -1)

    def add(self, keys: np.ndarray, values: list) -> None:
        lengths = np.fromiter(map(len, values), np.int32, len(values))
        at = len(self.pool) + np.cumsum(lengths) - lengths
        flat = [x for v in values for x in v]
        self.pool = np.concatenate([self.pool, np.array(flat, dtype=self.pool.dtype)])
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.lengths = np.insert(self.lengths, where, lengths[order])
        self.at = np.insert(self.at, where, at[order])


class Encoder:
    """Ids of whole columns by the byte-level vocabulary.

    ``batch(column)`` gives all ids as unsigned 16-bit numbers and the offset of each
    text among them. A null text is an empty one.
    """

    cuts = staticmethod(byte_pieces)
    lower = False

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.added = [
            t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()
        ]
        self.table = PieceTable(np.uint16)

    def whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def piece(self, piece: bytes) -> list[int]:
        shown = piece.decode("latin-1").translate(byte_letters())
        return [t.id for t in self.model.tokenize(shown)]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = raw_bytes(column)
        ids, counts, low = [], [], 0
        n = len(offsets) - 1
        while low < n:
            high = int(np.searchsorted(offsets, offsets[low] + BATCH_BYTES, side="right")) - 1
            high = min(n, max(high, low + 1))
            part, count = self.run(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            ids.append(part)
            counts.append(count)
            low = high
        total = np.zeros(n + 1, np.int64)
        np.cumsum(np.concatenate(counts) if counts else [], out=total[1:])
        return (np.concatenate(ids) if ids else self.table.pool[:0]), total

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        data = raw
        if self.lower:
            data = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        kind = classes(data)
        odd = np.concatenate([[0], np.cumsum(kind == ODD)])
        odd = odd[offsets[1:]] > odd[offsets[:-1]]
        text = raw.tobytes()
        for mark in self.added:
            at = text.find(mark)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, side="right")) - 1
                odd[k] |= at + len(mark) <= offsets[k + 1]
                at = text.find(mark, at + 1)
        begins = offsets[:-1][offsets[:-1] < len(data)]
        if len(data) == 0:
            return self.table.pool[:0], np.zeros(n, np.int64)
        start = self.cuts(data, kind, begins)
        end = np.append(start[1:], len(data))
        keep = np.ones(len(start), bool)
        if odd.any():
            keep &= ~odd[np.searchsorted(offsets, start, side="right") - 1]
        if self.lower:
            keep &= kind[start] != SPACE
        start, end = start[keep], end[keep]
        keys = span_hash(data, start, end)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        found = self.table.find(unique)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.table.keys) + len(missing) > KEPT_PIECES:
                # start anew with all pre-tokens of this run, however many
                self.table = PieceTable(self.table.pool.dtype.type)
                missing = np.arange(len(unique))
            s = data.tobytes()
            pieces = [s[a:b] for a, b in zip(start[first[missing]].tolist(), end[first[missing]].tolist())]
            self.table.add(unique[missing], list(map(self.piece, pieces)))
            found = self.table.find(unique)
            if (found < 0).any():
                raise AssertionError("a pre-token is missing from the table")
        return self.gather(text, offsets, odd, start, found[inverse])

    def gather(self, text, offsets, odd, start, entry):
        lengths = self.table.lengths[entry].astype(np.int64)
        base = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=base[1:])
        where = np.arange(base[-1]) + np.repeat(self.table.at[entry] - base[:-1], lengths)
        ids = self.table.pool[where]
        at = base[np.searchsorted(start, offsets)]
        counts = np.diff(at)
        if odd.any():
            parts, done = [], 0
            for k in np.flatnonzero(odd):
                own = self.whole(text[offsets[k] : offsets[k + 1]])
                parts += [ids[done : at[k]], np.array(own, ids.dtype)]
                counts[k], done = len(own), at[k]
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary, with what it has learnt."""
    return Encoder(path)
