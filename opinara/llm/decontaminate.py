"""Benchmark passages in documents, by a prefix-filtered set join.

1. Every benchmark item gives windows of consecutive words; an item of fewer words is one
   window. A window's tokens are its shingles.
2. Tokens are ordered by rarity: how often each occurs in the documents. A document that
   contains a window contains all its tokens, so one is a sufficient prefix: the rarest.
3. The documents' shingles are joined with those prefix tokens only. A match says where
   the window must start; it is dropped if it would cross an end of the text.
4. The words there, as many as the window has, must equal the window's.

Two bitmaps of fixed size, of all tokens and of the prefix tokens, let tasks emit only
shingles that can match. Copies of a text are joined once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize
from opinara.llm.words import ALNUM, Words, gram_hash, mix, words_of

FILTER_BITS = 1 << 23


def shingles(w: Words, sizes: list[int]):
    """``(word number, text number, hash)`` of every shingle of the given sizes."""
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k in sizes:
        g = mix(gram_hash(w.hash, k) + np.uint64(k))
        at = np.flatnonzero(owner[: len(g)] == owner[k - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
        yield at, owner[at] if len(at) else at, g[at]


def long_lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """``(item_id, wid, words, tokens)``: word hashes and shingle hashes of each window."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column(1), ALNUM)
        owner, name, words, tokens = [], [], [], []
        for i in range(batch.num_rows):
            h = w.hash[w.first[i] : w.first[i + 1]]
            n = min(size, len(h))
            k = min(shingle, n)
            for at in range(len(h) - n + 1 if n else 0):
                own = h[at : at + n]
                owner.append(i)
                words.append(own)
                tokens.append(mix(gram_hash(own, k) + np.uint64(k)))
                name.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(name, pa.binary()), long_lists(words), long_lists(tokens)],
            names=["item_id", "wid", "words", "tokens"],
        )

    kind = items.schema["item_id"].dataType.simpleString()
    return map_slices(items, cut, f"item_id {kind}, wid binary, words array<long>, tokens array<long>")


def bitmap(tokens: DataFrame) -> np.ndarray:
    """Bitmap of the column ``g``: at most FILTER_BITS / 64 rows reach the driver."""
    words = (
        tokens.select(F.pmod("g", F.lit(FILTER_BITS)).alias("bit"))
        .select(F.expr("bit div 64 AS w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT)) AS b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    at = (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def token_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """``(g, n)``: how often shingles that pass the bitmap occur, summed within tasks."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column(0), ALNUM)
        found = [g[passes(bits.value, g)] for _, _, g in shingles(w, sizes)]
        g, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    parts = map_slices(docs.select("text"), count, "g long, n long")
    return parts.groupBy("g").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, bits, sizes: list[int], size: int) -> DataFrame:
    """Each document with the shingles that may be prefix tokens, and words around them.

    ``places``: position of the shingle, its hash, words before it, and the word hashes of
    its surroundings, as far as a window holding it can reach.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column(1), ALNUM)
        n = batch.num_rows
        at, owner, g = (np.concatenate(x) for x in zip(*shingles(w, sizes))) if sizes else (np.zeros(0, np.int64),) * 3
        hit = np.flatnonzero(passes(bits.value, g.view(np.uint64))) if len(g) else np.zeros(0, np.int64)
        hit = hit[np.argsort(owner[hit], kind="stable")]
        at, owner, g = at[hit], owner[hit], g[hit]
        low = np.maximum(at - size + 1, w.first[owner]) if len(at) else at
        high = np.minimum(at + size, w.first[owner + 1]) if len(at) else at
        around = long_lists([w.hash[a:b] for a, b in zip(low.tolist(), high.tolist())])
        inner = pa.StructArray.from_arrays(
            [pa.array((at - w.first[owner]) if len(at) else at), pa.array(g.view(np.int64)), pa.array(at - low), around],
            names=["pos", "g", "before", "around"],
        )
        cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        texts = batch.column(1).cast(pa.large_binary())
        names = [hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(w.first).astype(np.int64)), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), inner)],
            names=["doc_id", "n_words", "name", "places"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs,
        find,
        f"doc_id {kind}, n_words long, name binary, "
        "places array<struct<pos: long, g: long, before: long, around: array<long>>>",
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 5,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per input row.

    A word is hit if it lies in any occurrence of a window. ``items_sha256`` is of the
    sorted, comma-joined ids of items with an occurring window, of the empty string if
    there is none. Texts and items that are null or have no words give no windows and no
    hits; an item without an id can hit words but is not listed. Items with the same
    window are all listed. Repeated rows give repeated results.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    cut = materialize(windows(items, window, shingle), "windows")
    distinct = cut.groupBy("wid").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens"))
    tokens = materialize(
        distinct.select(
            "wid", F.least(F.size("words"), F.lit(shingle)).alias("k"), F.posexplode("tokens").alias("off", "g")
        ),
        "window_tokens",
    )
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect())  # at most `shingle`
    counts = token_counts(docs, context.broadcast(bitmap(tokens)), sizes)
    rarest = (
        tokens.join(counts, "g", "left")
        .groupBy("wid")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "g")).alias("t"))
        .where("t.n > 0")  # a window with a token that never occurs occurs nowhere
        .select("wid", "t.off", "t.g")
    )
    prefixes = materialize(
        rarest.join(distinct.select("wid", "words"), "wid").withColumn("len", F.size("words")), "prefixes"
    )
    scanned = materialize(places(docs, context.broadcast(bitmap(prefixes)), sizes, window), "places")
    found = (
        scanned.where(F.size("places") > 0)
        .groupBy("name")
        .agg(F.first("places").alias("places"), F.first("n_words").alias("n_words"))
        .select("name", "n_words", F.explode("places").alias("p"))
        .select("name", "n_words", "p.*")
        .join(prefixes, "g")
        .where("off <= before AND pos - off + len <= n_words")
        .where("slice(around, CAST(before - off + 1 AS INT), len) = words")
        .select("name", "wid", (F.col("pos") - F.col("off")).alias("start"), "len")
    )
    hits = materialize(found, "hits")
    order = Window.partitionBy("name").orderBy("start", "end")
    ends = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        hits.select("name", "start", (F.col("start") + F.col("len")).alias("end"))
        .distinct()
        .withColumn("new", F.col("end") - F.greatest("start", F.least("end", F.coalesce(ends, F.lit(0)))))
        .groupBy("name")
        .agg(F.sum("new").alias("n_hit"))
    )
    ids = (
        hits.select("name", "wid")
        .distinct()
        .join(cut.where("item_id IS NOT NULL").select("wid", F.col("item_id").cast("string").alias("id")).distinct(), "wid")
        .groupBy("name")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    per_text = covered.join(ids, "name", "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return scanned.select("doc_id", "n_words", "name").join(per_text, "name", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
