"""Resampling towards a target: documents drawn by how much their word runs favour it.

A feature is a run of one to three words; its bucket is its CRC-32 modulo the number of
buckets. A bucket gains the log ratio of its smoothed shares in target and corpus, a
document weighs the sum of its features' gains, and a Gumbel draw by a hash of its id
makes the highest scores a sample without replacement with odds ``exp(weight / 1000)``.

CRCs are taken of the distinct features of a slice, grouped by length into matrices and
scattered back to the places where they stand. Task by task, one row a bucket is summed;
the bucket table has a fixed size, so it goes to the driver and to all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize, slices
from opinara.llm.crc import span_crc
from opinara.llm.words import ALNUM, Words, span_hash, words_of
from opinara.operators.ordering import long_digits, running_total


@dataclass(frozen=True)
class Settings:
    longest: int = 3  # words of a feature
    buckets: int = 10_000
    scale: int = 1000  # gains and scores are whole numbers of 1/scale nats
    seed: int = 42
    least_words: int = 20  # of a document that may be drawn
    percent: int = 5  # of them, drawn


def joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with one space after each, and where each starts and ends."""
    lengths = w.end - w.start
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    inside = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(end) else end
    total = int(lengths.sum())
    source = np.repeat(w.start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(end) else end
    places = np.arange(total)
    data[places + inside] = w.data[places + source]
    return data, start, end


def feature_buckets(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, bucket)`` of every feature of every text, and each text's words."""
    w = words_of(column, ALNUM)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    data, start, end = joined(w)
    owners, starts, ends = [], [], []
    for k in range(1, s.longest + 1):
        last = len(owner) - k + 1
        if last <= 0:
            break
        same = owner[:last] == owner[k - 1 :]
        owners.append(owner[:last][same])
        starts.append(start[:last][same])
        ends.append(end[k - 1 :][same])
    if not owners:
        return owner, owner, counts
    low, high = np.concatenate(starts), np.concatenate(ends)
    _, first, place = np.unique(span_hash(data, low, high), return_index=True, return_inverse=True)
    bucket = span_crc(data, low[first], high[first]) % np.uint32(s.buckets)
    return np.concatenate(owners), bucket.astype(np.int64)[place], counts


def bucket_counts(texts: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Features of all texts per bucket; the table has one row a bucket at most."""

    def run(batches):
        total = np.zeros(s.buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(feature_buckets(part.column("text"), s)[1], minlength=s.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long")
    counts = np.zeros(s.buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Whole-number gain of each bucket."""
    size, wanted = float(corpus.sum()) + s.buckets, float(target.sum()) + s.buckets
    return np.array(
        [math.floor(s.scale * math.log((t + 1.0) * size / ((c + 1.0) * wanted))) for c, t in zip(corpus, target)],
        dtype=np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket, words = feature_buckets(part.column("text"), s)
        n = part.num_rows
        sums = np.zeros(n, dtype=np.int64)
        np.add.at(sums, owner, gains[bucket])
        columns = [part.column("doc_id"), words, np.bincount(owner, minlength=n), sums]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, s: Settings = Settings()) -> Column:
    """Whole-number Gumbel draw of an id; a null id draws as an empty one."""
    text = F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(s.scale)) * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document of ``(doc_id, text)``.

    ``target`` has a ``text``. Ranks go from 1 by falling score, ties to the smaller
    ``doc_id``, then any order; a null id comes last. Documents not drawn have none.
    A null or empty text has no features and weighs 0; it has too few words to be drawn.
    No documents give no rows; no target texts give a target without features. Other
    columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, s), bucket_counts(target, s), s)
    scored = weigh(docs, gains, s).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), s))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.where(F.col("n_words") >= s.least_words)
    n = able.count() * s.percent // 100
    if n == 0:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))

    # Documents at least as good as each score; the windows see distinct scores only.
    per = able.groupBy((-F.col("score")).alias("down")).agg(F.count(F.lit(1)).alias("docs"))
    reached = running_total(per, [F.col("down")], long_digits(F.col("down")), {"upto": F.col("docs")})
    cut = -reached.where(F.col("upto") >= n).agg(F.min("down")).first()[0]

    drawn = (F.col("n_words") >= s.least_words) & (F.col("score") >= cut)
    order = [-F.col("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    digits = [
        F.shiftright(-F.col("score"), 16),
        -F.col("score"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 16), F.lit((1 << 63) - 1)),
        # Row numbers order the rows of one id only.
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
        F.shiftright("row", 16),
    ]
    ranked = running_total(scored.where(drawn), order, digits, {"rank": F.lit(1)})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")).cast("long"))
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
