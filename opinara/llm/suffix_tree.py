"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of up to ``depth`` preceding words, or the start of a text. Contexts
that occur ``least_count`` times in the training texts are candidates, however large the
corpus. A candidate becomes a state if its next symbols diverge from those of its longest
suffix that is one: tokens times Kullback-Leibler divergence reach ``least_gain``. All
next symbols of a state are kept. Distributions are smoothed by a discount whose mass goes
to the suffix's distribution, in the end to additive counts of single tokens. A token is
scored in the longest suffix of what stands before it that is a state.

``least_context`` and ``least_next`` can thin the tree further: least share of a context
in all training tokens, and of a symbol in its context (others share what is left).

The tree grows with the corpus. All contexts that end in the same word, and all that
follows them, form a subtree of their own; so each token is dealt once, with the words
before it, by the last of them. A bucket of subtrees is counted, tested and scored where
its tokens meet, and only sums per text leave it. The ``head`` most frequent words go to
all tasks; tokens beyond it are joined with the counts first. A context with more than
``group`` tokens is too large to meet in one place: such contexts are few, they and their
next symbols are counted level by level as tables, and the tokens after them are dealt by
the longest part of their context that is one word longer.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize, slices
from opinara.llm.words import SPACED, mix, words_of

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # stand for no word
ADDED = 0.1  # to every count of a token
FILTER_BITS = 1 << 26


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    least_count: int = 25
    least_context: float = 0.0
    least_next: float = 0.0
    least_gain: float = 25.0
    discount: float = 0.5
    head: int = 400_000
    group: int = 1 << 22


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a context with one more recent word; the empty context is 0."""
    return mix(context + mix(word + np.uint64(0x9D)))


def pair(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Name of a symbol after a state."""
    return mix(state ^ mix(symbol + np.uint64(0x51)))


def held_out(keys: pa.Array) -> np.ndarray:
    """Whether crc32 of each key's text is divisible by 10; a null key is not held out."""
    return np.array([k is not None and zlib.crc32(k.encode()) % 10 == 0 for k in keys.to_pylist()], bool)


@dataclass
class Tokens:
    """Tokens of several texts: words, then an end; ``contexts[k]`` of ``k`` words before."""

    symbol: np.ndarray
    owner: np.ndarray
    contexts: list[np.ndarray]  # from one word on; 0 where the text has fewer
    sequence: np.ndarray | None = None  # start, words, end of each text
    at: np.ndarray | None = None  # of each token in the sequence
    before: np.ndarray | None = None  # symbols before it in its text, the start among them


def tokens_of(column: pa.Array, depth: int) -> Tokens:
    w = words_of(column, SPACED)
    counts = np.diff(w.first)
    n = len(counts)
    # start, words, end of each text in turn
    sequence = np.empty(len(w.hash) + 2 * n, np.uint64)
    begin = w.first[:-1] + 2 * np.arange(n)
    owner = np.repeat(np.arange(n), counts)
    sequence[begin] = START
    sequence[begin + counts + 1] = END
    sequence[np.arange(len(w.hash)) + 2 * owner + 1] = w.hash
    at = np.ones(len(sequence), bool)
    at[begin] = False
    at = np.flatnonzero(at)
    owner = np.repeat(np.arange(n), counts + 1)
    before = at - begin[owner]
    contexts = []
    for k in range(1, depth + 1):
        deep = before >= k
        name = np.zeros(int(deep.sum()), np.uint64)
        for j in range(k, 0, -1):
            name = extend(name, sequence[at[deep] - j])
        full = np.zeros(len(at), np.uint64)
        full[deep] = name
        contexts.append(full)
    return Tokens(sequence[at], owner, contexts, sequence, at, before)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where missing."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    where = np.searchsorted(keys, wanted)
    where[where == len(keys)] = 0
    return np.where(keys[where] == wanted, where, -1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def training(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(1).filter(pa.array(~held_out(batch.column(0))))


def token_counts(rows: DataFrame) -> DataFrame:
    """``(h, c)``: how often each token occurs in training texts; the start counts texts."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = training(batch)
        t = tokens_of(texts, 0)
        h, c = np.unique(t.symbol, return_counts=True)
        h, c = np.append(h, START), np.append(c, len(texts))
        return pa.RecordBatch.from_arrays([signed(h), pa.array(c)], names=["h", "c"])

    return map_slices(rows, count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frame_arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded table as unsigned (names) and signed (counts) arrays."""
    frame = df.toArrow()
    return {c: frame.column(c).to_numpy() for c in frame.column_names}


def bitmap(names: DataFrame) -> np.ndarray:
    """Bitmap of the column ``s``: at most FILTER_BITS / 64 rows reach the driver."""
    words = frame_arrays(
        names.select(F.pmod("s", F.lit(FILTER_BITS)).alias("bit"))
        .select(F.expr("bit div 64 AS w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT)) AS b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"]] = words["b"]
    return out.view(np.uint64)


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each context can be one of the bitmap; no context, 0, cannot."""
    at = (names & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    set_ = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return set_.astype(bool) & (names != 0)


def candidates(pairs: DataFrame, least: float) -> DataFrame:
    """``(s, up, n)``: contexts one word longer than those of ``(s, up, x, c)``."""

    def name(batches):
        for batch in batches:
            s, up, x = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            # a single word's suffix is the empty context
            longer = np.where(s == 0, np.uint64(0), extend(up, x))
            yield pa.RecordBatch.from_arrays([signed(extend(s, x)), signed(longer), batch.column(3)], names=["s", "up", "n"])

    frequent = pairs.where((F.col("c") >= least) & (F.col("x") != int(END.view(np.int64))))
    return frequent.select("s", "up", "x", "c").mapInArrow(name, "s long, up long, n long")


def next_counts(rows: DataFrame, bits, level: int) -> DataFrame:
    """``(s, x, c)``: how often symbol ``x`` follows each context that passes the bitmap."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokens_of(training(batch), level)
        s = t.contexts[level - 1]
        hit = passes(bits.value, s)
        s, x = s[hit], t.symbol[hit]
        _, first, c = np.unique(pair(s, x), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([signed(s[first]), signed(x[first]), pa.array(c)], names=["s", "x", "c"])

    return map_slices(rows, count, "s long, x long, c long").groupBy("s", "x").agg(F.sum("c").alias("c"))


def grow(rows: DataFrame, counts: DataFrame, n_tokens: int, single: float, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree as tables: states, what follows them, and the contexts tested.

    States: ``(s, above, n, m, back)``, the longest suffix that is a state (0: none), its
    tokens, its rows among the entries, and what other symbols get of the suffix's share.
    Entries: ``(s, x, c, p)``, the probability of each symbol seen after a state.
    Contexts: ``(s, up, n)``, all that are frequent enough.
    """
    context = rows.sparkSession.sparkContext
    least = max(s.least_count, s.least_context * n_tokens)
    states, entries, tested = [], [], []
    none = F.lit(0).cast("long")
    # what is known of the contexts one word shorter: of every symbol seen after a
    # candidate, its probability in the longest suffix of it that is a state
    solved = counts.select(
        none.alias("s"), none.alias("up"), F.col("h").alias("x"), "c", none.alias("state"), ((F.col("c") + ADDED) / single).alias("p")
    )
    for level in range(1, s.depth + 1):
        found = materialize(candidates(solved, least), f"candidates_{level}")
        bits = context.broadcast(bitmap(found))
        shorter = solved.select(F.col("s").alias("up"), "x", F.col("state").alias("above"), F.col("p").alias("below"))
        joined = next_counts(rows, bits, level).join(found, "s").join(shorter, ["up", "x"])
        joined = materialize(joined.withColumn("kept", F.col("c") >= s.least_next * F.col("n")), f"next_{level}")
        kept = lambda v: F.sum(F.when(F.col("kept"), v).otherwise(0))
        sums = joined.groupBy("s").agg(
            F.first("above").alias("above"),
            F.first("n").alias("n"),
            F.count("x").alias("m"),
            kept(F.col("c")).alias("seen"),
            kept(F.lit(s.discount)).alias("taken"),
            kept(F.col("below")).alias("seen_below"),
            kept(F.col("c") * F.log(F.col("c") / F.col("n") / F.col("below"))).alias("gain"),
        )
        left = F.col("n") - F.col("seen")
        left_below = F.greatest(1 - F.col("seen_below"), F.lit(1e-12))
        gain = F.col("gain") + F.when(left > 0, left * F.log(left / F.col("n") / left_below)).otherwise(0)
        back = F.greatest((left + F.col("taken")) / F.col("n"), F.lit(1e-12)) / left_below
        own = materialize(sums.where(gain >= s.least_gain).select("s", "above", "n", "m", back.alias("back")), f"states_{level}")
        states.append(own)
        tested.append(found)
        p = (
            F.when(F.col("back").isNull(), F.col("below"))
            .when(F.col("kept"), (F.col("c") - s.discount) / F.col("n"))
            .otherwise(F.col("back") * F.col("below"))
        )
        state = F.when(F.col("back").isNull(), F.col("above")).otherwise(F.col("s"))
        solved = materialize(
            joined.join(own.select("s", "back"), "s", "left").select("s", "up", "x", "c", state.alias("state"), p.alias("p")),
            f"solved_{level}",
        )
        entries.append(solved.where("s = state").select("s", "x", "c", "p"))
    return tuple(functools.reduce(DataFrame.union, x) for x in (states, entries, tested))


def least_power(df: DataFrame, column: str, limit: int) -> int:
    """The least power of two that at most ``limit`` rows reach in a column of counts."""
    reached = df.agg(*(F.sum((F.col(column) >= 2**k).cast("long")).alias(f"k{k}") for k in range(63))).first()
    return next((2**k for k in range(63) if (reached[k] or 0) <= limit), 2**62)


@dataclass
class Tree:
    """The head: states sorted by name, and their entries sorted by ``pair`` name."""

    bits: np.ndarray  # of all states, those beyond the head too
    state: np.ndarray
    suffix: np.ndarray  # place of the longest suffix that is a state, -1: none
    back: np.ndarray  # log10 of what a symbol without entry gets of the suffix's share
    whole: np.ndarray  # whether all entries of the state are here
    entry: np.ndarray
    value: np.ndarray  # log10 probability

    def look(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probabilities as far as the tree has them, which tokens it leaves to
        counts, and which ones the tables have to decide."""
        place, unknown = np.full(len(t.symbol), -1), np.zeros(len(t.symbol), bool)
        for context in t.contexts:  # the longest comes last
            found = find(self.state, context)
            here = (context != 0) & (found >= 0)
            place = np.where(here, found, place)
            unknown = np.where(here, False, unknown | passes(self.bits, context))
        total = np.zeros(len(t.symbol))
        open_ = np.flatnonzero((place >= 0) & ~unknown)
        rest = (place < 0) & ~unknown
        while len(open_):
            at = find(self.entry, pair(self.state[place[open_]], t.symbol[open_]))
            hit = at >= 0
            total[open_[hit]] += self.value[at[hit]]
            miss = open_[~hit]
            unknown[miss] |= ~self.whole[place[miss]]
            miss = miss[self.whole[place[miss]]]
            total[miss] += self.back[place[miss]]
            place[miss] = self.suffix[place[miss]]
            done = place[miss] < 0
            rest[miss[done]] = True
            open_ = miss[~done]
        total[unknown] = 0
        return total, rest, unknown

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of a tree that is all head: log10 probabilities, and tokens left to counts."""
        total, rest, unknown = self.look(t)
        if unknown.any():
            raise ValueError("the tree has states or entries beyond its head")
        return total, rest


def head_of(states: DataFrame, entries: DataFrame, s: Settings) -> Tree:
    """States and entries of the highest counts, at most ``head`` of each."""
    bits = bitmap(states)
    least = max(least_power(states, "n", s.head), least_power(entries, "c", s.head))
    top, follow = frame_arrays(states.where(F.col("n") >= least)), frame_arrays(entries.where(F.col("c") >= least))
    order = np.argsort(top["s"].view(np.uint64))
    state, above = top["s"].view(np.uint64)[order], top["above"].view(np.uint64)[order]
    names = follow["s"].view(np.uint64)
    owner = find(state, names)  # never missing: a state occurs as often as its entries
    entry = pair(names, follow["x"].view(np.uint64))
    by = np.argsort(entry)
    return Tree(
        bits,
        state,
        find(state, above),
        np.log10(top["back"][order]),
        np.bincount(owner, minlength=len(state)) == top["m"][order],
        entry[by],
        np.log10(follow["p"][by]),
    )


def learn(rows: DataFrame, counts: DataFrame, n_tokens: int, single: float, s: Settings) -> Tree:
    """The head of the tree of all training texts."""
    states, entries, _ = grow(rows, counts, n_tokens, single, s)
    return head_of(states, entries, s)


@dataclass
class Model:
    """What all tasks get: the head's words, by name and by number, and the large contexts."""

    names: np.ndarray  # sorted
    ids: np.ndarray  # their numbers, frequent words first
    hashes: np.ndarray  # of each number from here on
    logs: np.ndarray
    enough: np.ndarray  # whether a context may have the word
    rare_enough: bool  # and one beyond the head
    hot: np.ndarray  # contexts too large for a bucket, sorted
    tree: Tree | None  # of these
    buckets: int
    least: float
    s: Settings


NONE = -1  # number of no word; of words beyond the head: -2 and less


@dataclass
class Look:
    """Tokens of a slice as the tasks see them before any counting."""

    t: Tokens
    rare: np.ndarray  # words beyond the head
    x: np.ndarray  # number of each token's word
    words: list[np.ndarray]  # of the words before it, the last one first
    base: np.ndarray  # log10 by single counts, 0 beyond the head
    value: np.ndarray  # log10 by the large contexts
    open: np.ndarray  # whether the value has to be joined
    dealt: np.ndarray  # whether smaller contexts may be states
    bucket: np.ndarray


def look(column: pa.Array, m: Model) -> Look:
    t = tokens_of(column, m.s.depth if len(m.hot) else 0)
    distinct, inverse = np.unique(t.sequence, return_inverse=True)
    at = find(m.names, distinct)
    known = at >= 0
    number = np.empty(len(distinct), np.int32)
    number[known] = m.ids[at[known]]
    rare = distinct[~known]
    number[~known] = -2 - np.arange(len(rare))
    enough = np.full(len(distinct), m.rare_enough)
    enough[known] = m.enough[number[known]]
    enough |= distinct == START
    x = number[inverse[t.at]]
    base = np.zeros(len(x))
    base[x >= 0] = m.logs[x[x >= 0]]
    words, alive = [], np.ones(len(x), bool)
    for j in range(1, m.s.depth + 1):
        alive = alive & (t.before >= j)
        place = inverse[(t.at - j)[alive]]
        alive[alive] = enough[place]
        w = np.full(len(x), NONE, np.int32)
        w[alive] = number[place[enough[place]]]
        words.append(w)
    if not len(m.hot):
        group = extend(np.zeros(len(distinct), np.uint64), distinct)[inverse[t.at - 1]]
        return Look(t, rare, x, words, base, base, x < 0, words[0] != NONE, into(group, m))
    total, rest, unknown = m.tree.look(t)
    large = [(c != 0) & (find(m.hot, c) >= 0) for c in t.contexts]
    group, dealt, done = np.zeros(len(x), np.uint64), np.zeros(len(x), bool), np.zeros(len(x), bool)
    for c, w, big in zip(t.contexts, words, large):  # the first that is not large
        here = ~big & ~done
        group[here], dealt[here] = c[here], w[here] != NONE
        done |= here
    value = total + np.where(rest, base, 0.0)
    return Look(t, rare, x, words, base, value, unknown | (rest & (x < 0)), dealt, into(group, m))


def into(group: np.ndarray, m: Model) -> np.ndarray:
    return ((group >> np.uint64(20)) % np.uint64(m.buckets)).astype(np.int32)


BUCKETS = 48  # at least, so that many tasks have work
DEALT = 1 << 19  # tokens that a task gathers before it sends them
BLOCK = (
    "bucket int, n int, docs int, rare int, uid binary, own binary, doc binary, x binary, "
    "words binary, names binary, value binary, base binary, known binary"
)


def pack(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values, then the second ones."""
    values = np.ascontiguousarray(values)
    return pa.compress(values.view(np.uint8).reshape(values.size, values.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    if n == 0:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


class Blocks:
    """Tokens of a task, sent to their buckets as compressed columns."""

    def __init__(self):
        self.parts, self.docs, self.rare, self.n = [], 0, 0, 0

    def add(self, uid, own, doc, x, words, rare, bucket, *more) -> None:
        """``doc``: number of each token's text among ``uid``; ``more``: value, base, known."""
        move = lambda v: np.where(v < NONE, v - self.rare, v).astype(np.int32)
        self.parts.append((uid, own, rare, doc.astype(np.int32) + self.docs, bucket, move(x), *(move(w) for w in words), *more))
        self.docs, self.rare, self.n = self.docs + len(uid), self.rare + len(rare), self.n + len(x)

    def flush(self, depth: int) -> Iterator[pa.RecordBatch]:
        uid, own, rare, doc, bucket, *columns = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(bucket, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
        rows, begin = [], 0
        for end in ends if len(order) else []:
            at = order[begin:end]
            begin = end
            texts, own_doc = np.unique(doc[at], return_inverse=True)
            numbers = np.stack([c[at] for c in columns[: depth + 1]])
            beyond = numbers < NONE
            names, place = np.unique(rare[-2 - numbers[beyond]], return_inverse=True)
            numbers[beyond] = -2 - place
            numbers += 1  # no word is 0
            fields = [uid[texts], own[texts], own_doc.astype(np.int32), numbers[0], numbers[1:].ravel(), names]
            more = [pack(c[at]) for c in columns[depth + 1 :]]
            rows.append([int(bucket[at[0]]), len(at), len(texts), len(names), *map(pack, fields), *more, *[None] * (3 - len(more))])
        self.__init__()
        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = [pa.int32() if " int" in x else pa.binary() for x in BLOCK.split(", ")]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def deal(texts: DataFrame, model) -> DataFrame:
    """Blocks of the tokens whose words are all known to the head."""

    def run(batches):
        m, out = model.value, Blocks()
        for batch in batches:
            for part in slices(batch, "text"):
                found = look(part.column(2), m)
                send = found.dealt & ~found.open & (found.x >= 0)
                uid, own = part.column(0).to_numpy(), ~held_out(part.column(1))
                more = [found.value[send]] if len(m.hot) else []
                out.add(uid, own, found.t.owner[send], found.x[send], [w[send] for w in found.words], found.rare, found.bucket[send], *more)
                if out.n >= DEALT:
                    yield from out.flush(m.s.depth)
        if out.parts:
            yield from out.flush(m.s.depth)

    return texts.mapInArrow(run, BLOCK)


def squeeze(words: list[np.ndarray], m: Model) -> list[np.ndarray]:
    """Numbers of the words of contexts, several to an integer; beyond the head only the start."""
    bits = (len(m.ids) + 1).bit_length()
    codes = [np.where(w < NONE, 1, np.where(w == NONE, 0, w.astype(np.int64) + 2)) for w in words]
    each = 63 // bits
    return [sum(c << (bits * j) for j, c in enumerate(codes[k : k + each])) for k in range(0, len(codes), each)]


def stretch(columns: list[np.ndarray], start: int, m: Model) -> list[np.ndarray]:
    """The other way round; ``start``: the number of the start."""
    bits = (len(m.ids) + 1).bit_length()
    each = 63 // bits
    codes = [(columns[j // each] >> (bits * (j % each))) & ((1 << bits) - 1) for j in range(m.s.depth)]
    return [np.where(c == 1, start, np.where(c == 0, NONE, c - 2)) for c in codes]


def deal_joined(texts: DataFrame, model, large, counts: DataFrame, single: float) -> DataFrame:
    """Blocks of the tokens that have to be joined with the counts of words, and with the
    tables of the large contexts (``large``: states and entries, or none)."""
    wide, any_word, depth = large is not None, model.value.rare_enough, model.value.s.depth
    words = [f"w{k + 1}" for k in range(depth if any_word else len(squeeze([np.zeros(1)] * depth, model.value)))]
    names = words + [f"s{k + 1}" for k in range(depth if wide else 0)]

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        found = look(batch.column(2), m)
        at = np.flatnonzero(found.open | (found.x < 0))
        owner = found.t.owner[at]
        before = [np.where(found.dealt[at], w[at], NONE) for w in found.words]
        if any_word:
            symbols = np.concatenate([found.rare, m.hashes, np.zeros(1, np.uint64)])
            name = lambda v: symbols[np.where(v < NONE, -2 - v, np.where(v < 0, len(symbols) - 1, v + len(found.rare)))]
            columns = [signed(name(w)) for w in before]
        else:
            columns = [pa.array(c) for c in squeeze(before, m)]
        if wide:
            columns += [signed(np.where(passes(m.tree.bits, c[at]), c[at], np.uint64(0))) for c in found.t.contexts]
        fields = [
            pa.array(batch.column(0).to_numpy()[owner]),
            pa.array(~held_out(batch.column(1))[owner]),
            signed(found.t.symbol[at]),
            pa.array(found.x[at] < 0),
            pa.array(found.bucket[at]),
        ]
        return pa.RecordBatch.from_arrays(fields + columns, names=["uid", "own", "h", "beyond", "bucket", *names])

    schema = "uid long, own boolean, h long, beyond boolean, bucket int"
    tokens = map_slices(texts, pick, ", ".join([schema, *(f"{c} long" for c in names)])).join(counts, "h", "left")
    base = (F.coalesce("c", F.lit(0)) + ADDED) / single
    p = base
    if wide:
        states, entries = large
        tokens = tokens.withColumn("p", base)
        for k in range(1, depth + 1):
            own = F.when(F.col(f"s{k}") != 0, F.col(f"s{k}"))
            tokens = (
                tokens.withColumn("s", own)
                .join(entries.select("s", F.col("x").alias("h"), F.col("p").alias("entry")), ["s", "h"], "left")
                .join(F.broadcast(states.select("s", "back")), "s", "left")  # few: each is large
                .withColumn("p", F.coalesce("entry", F.col("p") * F.coalesce("back", F.lit(1.0))))
                .drop("s", "entry", "back")
            )
        p = F.col("p")
    counted = F.when(F.col("beyond"), F.log10(base)).otherwise(0.0)
    known = F.col("beyond") & F.col("c").isNotNull()
    tokens = tokens.select("uid", "own", "h", "bucket", *words, F.log10(p).alias("value"), counted.alias("base"), known.alias("known"))

    def run(batches):
        m, out = model.value, Blocks()
        for batch in batches:
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            found = np.stack([column[c].view(np.uint64) for c in ["h", *(words if any_word else [])]])
            distinct = np.unique(np.append(found, START))
            at = find(m.names, distinct)
            number = np.where(at >= 0, m.ids[at] if len(m.ids) else NONE, -2 - np.arange(len(distinct)))
            number[distinct == 0] = NONE  # stands for no word
            x, *before = number[np.searchsorted(distinct, found)]
            if not any_word:
                before = stretch([column[c] for c in words], number[np.searchsorted(distinct, START)], m)
            uid, doc = np.unique(column["uid"], return_inverse=True)
            own = np.zeros(len(uid), bool)
            own[doc] = column["own"]
            out.add(uid, own, doc, x, before, distinct, column["bucket"], column["value"], column["base"], column["known"])
            if out.n >= DEALT:
                yield from out.flush(m.s.depth)
        if out.parts:
            yield from out.flush(m.s.depth)

    return tokens.mapInArrow(run, BLOCK)


def starts(changed: np.ndarray) -> np.ndarray:
    """Where runs begin; ``changed``: whether each value but the first differs from the one before."""
    return np.append(0, np.flatnonzero(changed) + 1)


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their places, in little memory where both fit into 64 bits."""
    bits = len(key).bit_length()
    if int(key.max()) >> (63 - bits):
        order = np.argsort(key)
        return key[order], order
    key <<= bits
    key |= np.arange(len(key))
    key.sort()
    order = (key & ((1 << bits) - 1)).astype(np.int32)
    key >>= bits
    return key, order


def subtrees(of: np.ndarray, x: np.ndarray, words: np.ndarray, own: np.ndarray, p: np.ndarray, hashes: np.ndarray, m: Model) -> None:
    """Sets ``p``, by what stands above, to the probability of each token in its longest state.

    ``of``: places of the tokens in ``x`` and ``words``; ``words[k]`` are the words before,
    as numbers (-1: none), the last word first. The tokens of every context that is not
    large are all here. ``own``: learnt from.
    """
    s, width = m.s, len(hashes)
    at = np.flatnonzero(words[0][of] != NONE).astype(np.int32)
    context = words[0][of[at]].astype(np.int64)
    for k in range(s.depth):
        if len(at) == 0:
            break
        # tokens by context and symbol
        context *= width
        context += x[of[at]]
        key, order = in_order(context)
        at = at[order]
        del context, order
        begin = starts(key[1:] != key[:-1])
        of_context = key[begin] // width
        first = starts(of_context[1:] != of_context[:-1])  # pair of each context
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))
        times = np.diff(np.append(begin, len(key)))  # tokens of each pair, held out or not
        del key
        c = np.add.reduceat(own[at], begin, dtype=np.int64)
        n = np.add.reduceat(c, first)
        below = p[at[begin]]
        frequent = n >= m.least
        large = np.zeros(len(first), bool)
        if len(m.hot):
            name = np.zeros(len(first), np.uint64)
            for j in range(k, -1, -1):
                name = extend(name, hashes[words[j][of[at[begin[first]]]]])
            large = find(m.hot, name) >= 0
        kept = (c > 0) & (c >= s.least_next * n[owner])
        add = lambda v: np.bincount(owner[kept], weights=v[kept], minlength=len(first))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen, seen_below = add(c), add(below)
            left, left_below = n - seen, np.maximum(1 - seen_below, 1e-12)
            gain = add(c * np.log(c / n[owner] / below)) + np.where(left > 0, left * np.log(left / n / left_below), 0.0)
            back = np.maximum((left + s.discount * np.bincount(owner[kept], minlength=len(first))) / n, 1e-12) / left_below
            inside = np.where(kept, (c - s.discount) / n[owner], back[owner] * below)
        # after a large context the tokens of a pair may differ in what stands above: left alone
        state = frequent & ~large & (gain >= s.least_gain)
        decided = np.repeat(state[owner], times)
        p[at[decided]] = np.repeat(inside[state[owner]], times[state[owner]])
        if k + 1 < s.depth:
            going = np.repeat((frequent | large)[owner], times) & (words[k + 1][of[at]] != NONE)
            context = np.repeat(owner, times)[going] * width
            at = at[going]
            context = np.unique(context + words[k + 1][of[at]], return_inverse=True)[1]


PART = 1 << 19  # tokens that are counted at a time


def score_bucket(table: pa.Table, m: Model) -> pa.Table:
    """Sums per text over the tokens of a bucket: known ones, base and score."""
    # joined tokens, which bring their value, come first
    rows = np.argsort(table["value"].is_null().to_numpy(), kind="stable")
    sizes = {c: table[c].to_numpy()[rows] for c in ("n", "docs", "rare")}
    take = lambda c, i: table[c][int(rows[i])].as_py()
    docs, begin, places = (np.cumsum(np.append(0, sizes[c])) for c in ("docs", "rare", "n"))
    each = range(len(rows))
    uid = np.concatenate([unpack(take("uid", i), np.int64, sizes["docs"][i]) for i in each])
    own = np.concatenate([unpack(take("own", i), bool, sizes["docs"][i]) for i in each])
    rare = np.concatenate([unpack(take("names", i), np.uint64, sizes["rare"][i]) for i in each])
    rare, place = np.unique(rare, return_inverse=True)
    hashes = np.concatenate([m.hashes, rare])
    doc, numbers = np.empty(places[-1], np.int32), np.empty((m.s.depth + 1, places[-1]), np.int32)
    value, base, known = [np.zeros(0)], np.zeros(len(uid)), np.zeros(len(uid))
    for i in each:
        n, here = sizes["n"][i], slice(places[i], places[i + 1])
        own_doc = unpack(take("doc", i), np.int32, n)
        doc[here] = own_doc + docs[i]
        number = np.concatenate([unpack(take("x", i), np.int32, n), unpack(take("words", i), np.int32, m.s.depth * n)]) - 1
        beyond = number < NONE
        number[beyond] = len(m.hashes) + place[begin[i] - 2 - number[beyond]]
        numbers[:, here] = number.reshape(-1, n)
        if (v := take("value", i)) is not None:
            value.append(unpack(v, float, n))
        if (v := take("base", i)) is not None:
            texts, size = slice(docs[i], docs[i + 1]), sizes["docs"][i]
            base[texts] = np.bincount(own_doc, unpack(v, float, n), size)
            known[texts] = np.bincount(own_doc, unpack(take("known", i), bool, n), size)
    value = np.concatenate(value)
    parts = -(-len(doc) // PART)
    score = np.zeros(len(uid))
    of = (numbers[1] % parts).astype(np.int16 if parts < 1 << 15 else np.int32)  # by the last word: contexts stay whole
    for k in range(parts):
        at = np.flatnonzero(of == k).astype(np.int32)
        joined = np.searchsorted(at, len(value))
        p = np.empty(len(at))
        p[:joined], p[joined:] = value[at[:joined]], m.logs[numbers[0, at[joined:]]]
        np.power(10, p, out=p)
        subtrees(at, numbers[0], numbers[1:], own[doc[at]], p, hashes, m)
        score += np.bincount(doc[at], weights=np.log10(p, out=p), minlength=len(uid))
    pa.default_memory_pool().release_unused()
    texts, to = np.unique(uid, return_inverse=True)
    add = lambda v: np.bincount(to, weights=v, minlength=len(texts))
    return pa.table({"uid": texts, "known": add(known).astype(np.int64), "base": add(base), "score": add(score)})


def score_texts(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Texts whose crc32 of the key is not divisible by 10 are learnt from; a null key is
    such. A null or empty text is one token, the end. With nothing to learn from every
    token has probability 1 by the base formula. Repeated rows count and score each.
    """
    s = settings
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    counts = materialize(token_counts(rows), "token_counts")
    word = F.col("h") != int(START.view(np.int64))
    steps = sorted({1, *(b * 2**k for k in range(61) for b in (2, 3))})
    facts = counts.agg(
        F.coalesce(F.sum(F.when(word, F.col("c"))), F.lit(0)).alias("n"),
        F.sum((word & (F.col("c") > 0)).cast("long")).alias("v"),
        F.max("c").alias("top"),
        *(F.sum((word & (F.col("c") >= c)).cast("long")).alias(f"k{c}") for c in steps),
    ).first()
    n_tokens, single = facts["n"], facts["n"] + ADDED * ((facts["v"] or 0) + 1)
    rare = next((c for c in steps if (facts[f"k{c}"] or 0) <= s.head), 2**62)
    head = frame_arrays(counts.where(word & (F.col("c") >= rare)))
    ids = np.argsort(-head["c"], kind="stable")
    hashes, times = head["h"].view(np.uint64)[ids], head["c"][ids]
    order = np.argsort(hashes)
    least = max(s.least_count, s.least_context * n_tokens)
    large, tree, hot = None, None, np.zeros(0, np.uint64)
    if (facts["top"] or 0) >= max(s.group, least):
        wide = replace(s, least_count=max(s.group, s.least_count))
        *large, tested = grow(rows, counts.where("c > 0"), n_tokens, single, wide)
        tree = head_of(*large, s)
        hot = np.unique(frame_arrays(tested.select("s"))["s"].view(np.uint64))
    model = spark.sparkContext.broadcast(
        Model(
            hashes[order], order.astype(np.int32), hashes, np.log10((times + ADDED) / single), times >= least,
            rare > least, hot, tree, max(BUCKETS, -(-4 * n_tokens // (3 * s.group))), least, s,
        )
    )

    def own_facts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = look(batch.column(2), model.value)
        n = batch.num_rows
        add = lambda v: np.bincount(found.t.owner, weights=v, minlength=n)
        alone = ~found.open & ~found.dealt & (found.x >= 0)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(3),
                pa.array(held_out(batch.column(1))),
                pa.array(np.bincount(found.t.owner, minlength=n)),
                pa.array(add(found.x >= 0).astype(np.int64)),
                pa.array(add(found.base)),
                pa.array(add(np.where(alone, found.value, 0.0))),
            ],
            names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
        )

    kind = docs.schema[key].dataType.simpleString()
    k, body = F.col(key).cast("string"), F.col(text)
    # rows of the same name have the same key and text, so they score the same
    uid = F.xxhash64(k.isNull(), k, body.isNull(), body)
    texts = docs.select(uid.alias("uid"), k.alias("k"), body.alias("text"), F.col(key).alias("doc_id"))
    own = map_slices(
        texts, own_facts, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double"
    ).withColumn("copies", F.lit(1))
    texts = texts.drop("doc_id")
    joined = counts.where(word & (F.col("c") > 0) & (F.lit(bool(large)) | (F.col("c") < rare)))
    blocks = deal(texts, model).union(deal_joined(texts, model, large, joined, single))
    sums = blocks.groupBy("bucket").applyInArrow(
        lambda table: score_bucket(table, model.value), "uid long, known long, base double, score double"
    )
    whole = own.unionByName(sums, allowMissingColumns=True).groupBy("uid").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        *(F.max(c).alias(c) for c in ("held_out", "n_tokens")),
        *(F.sum(c).alias(c) for c in ("copies", "known", "base", "score")),
    )
    return whole.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.expr("known div copies").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
