"""Spelling variants: frequent words one edit apart, grouped under the most frequent one.

Words are counted over all texts. The vocabulary acceptor, the one-edit transducer and
the acceptor again are composed; the composition is cut into partitions by its initial
states, the states that the acceptor reaches over the first letters, and each partition is
built and enumerated by one task. Two words whose first letters agree meet in a partition
of the acceptor; two that differ there agree at the end, and meet in one of the acceptor
of the reversed words. A partition with too many words is cut by one more letter; the
pairs that differ in just that letter then meet by what is left of them without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.automata import Acceptor, OneEdit
from opinara.llm.batches import map_slices, materialize
from opinara.llm.crc import span_crc
from opinara.llm.words import LOWER, raw_bytes


@dataclass(frozen=True)
class Settings:
    least_length: int = 6  # code points of a word; at least twice ``head``
    least_count: int = 5
    drop_one_in: int = 199  # runs of which one letter goes
    times: int = 5  # a form is so many times as frequent
    head: int = 3  # letters that name a partition
    largest: int = 20_000  # words of a partition; a larger one is cut


def word_table(ids: pa.Array, texts: pa.Array, s: Settings) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a slice, with one letter dropped where the rule says so, and counts."""
    raw, offsets = raw_bytes(texts)
    data = LOWER[raw]
    # U+00C0 to U+00FF are C3 and one more byte, and C3 starts nothing else
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    letter = ((data >= 0x61) & (data <= 0x7A)) | (data == 0xC3) | second
    padded = np.zeros(len(data) + 2, dtype=bool)
    padded[1:-1] = letter
    left, right = letter & ~padded[:-2], letter & ~padded[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    left[cuts] = letter[cuts]
    right[cuts - 1] = letter[cuts - 1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    points = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
    first = np.searchsorted(points, start)
    size = np.searchsorted(points, end) - first
    long = size >= s.least_length
    start, end, first, size = start[long], end[long], first[long], size[long]
    if len(start) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)

    names = ["" if i is None else str(i) for i in ids.to_pylist()]
    before = np.array([zlib.crc32(f"{name}:".encode()) for name in names], dtype=np.uint32)
    owner = np.searchsorted(offsets, start, side="right") - 1
    h = span_crc(data, start, end, before[owner]).astype(np.int64)
    cut = h % s.drop_one_in == 0
    gone = points[first + h % size]  # the letter that goes
    gone_bytes = 1 + (data[gone] == 0xC3)

    keep = ~(cut & (size == s.least_length))  # otherwise too short without its letter
    start, end, cut, gone, gone_bytes = (a[keep] for a in (start, end, cut, gone, gone_bytes))
    lengths = end - start - np.where(cut, gone_bytes, 0)
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
    source = place + np.repeat(start, lengths)
    after = np.repeat(np.where(cut, gone - start, lengths), lengths) <= place
    source += after * np.repeat(np.where(cut, gone_bytes, 0), lengths)
    words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data[source]))
    counted = words.value_counts()
    return counted.field(0), counted.field(1).to_numpy()


def frequent_words(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, n = word_table(part.column("doc_id"), part.column("text"), s)
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

    counted = map_slices(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_count)


def _best(table: dict, word: str, other: str, n: int) -> None:
    have = table.get(word)
    if have is None:
        table[word] = [1, n, other]
        return
    have[0] += 1
    if n > have[1] or (n == have[1] and other < have[2]):
        have[1:] = [n, other]


def _near_within(side: int, part: list[tuple[str, str, int]], s: Settings) -> pa.RecordBatch:
    """Near words of one partition's words; from the reversed side only those that no
    partition of the other side holds together."""
    word = {text: w for text, w, _ in part}
    count = {text: n for text, _, n in part}
    table: dict[str, list] = {}
    for x, y in OneEdit(Acceptor(sorted(word))).pairs():
        a, b = word[x], word[y]
        if side and a[: s.head] == b[: s.head]:
            continue
        _best(table, a, b, count[y])
        _best(table, b, a, count[x])
    rows = [(w, *v) for w, v in table.items()]
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "n", "form"])


NEAR = "word string, n_near long, n long, form string"


def _parted(rows: DataFrame, s: Settings) -> DataFrame:
    """Near words of all partitions ``(side, key)``, one partition in memory at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        name, part = None, []
        for batch in batches:
            for side, key, text, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (side, key) != name:
                    if len(part) > 1:
                        yield _near_within(name[0], part, s)
                    name, part = (side, key), []
                part.append((text, word, n))
        if len(part) > 1:
            yield _near_within(name[0], part, s)

    dealt = rows.select("side", "key", "text", "word", "n").repartition("side", "key")
    return dealt.sortWithinPartitions("side", "key").mapInArrow(run, NEAR)


def _at_letter(rows: DataFrame, depth: int, s: Settings) -> DataFrame:
    """Near words that agree in ``depth`` letters and differ in the next.

    Words meet under what is left without that letter: those that have another letter
    there, and the one that has none. A meeting has one word a letter at most, so its size
    is bounded by the alphabet.
    """
    plain = rows.select("side", "text", "word", "n", F.lit(None).cast("string").alias("letter"), F.col("text").alias("rest"))
    without = rows.where(F.length("text") > depth).select(
        "side", "text", "word", "n",
        F.substring("text", depth + 1, 1).alias("letter"),
        F.concat(F.substring("text", 1, depth), F.expr(f"substring(text, {depth + 2})")).alias("rest"),
    )
    met = without.unionByName(plain).groupBy("side", "rest").agg(F.collect_list(F.struct("letter", "text", "word", "n")).alias("all"))
    met = met.where(F.size("all") > 1)
    pairs = met.select("side", F.explode("all").alias("a"), "all").select("side", "a", F.explode("all").alias("b"))
    differ = (F.col("a.letter") != F.col("b.letter")) | (
        # one has a letter more, which is not the one that stands there in the other
        F.col("a.letter").isNotNull() & F.col("b.letter").isNull()
        & (F.substring("b.text", depth + 1, 1) != F.col("a.letter"))
    ) | (
        F.col("b.letter").isNotNull() & F.col("a.letter").isNull()
        & (F.substring("a.text", depth + 1, 1) != F.col("b.letter"))
    )
    apart = (F.col("side") == 0) | (F.substring("a.word", 1, s.head) != F.substring("b.word", 1, s.head))
    near = pairs.where(differ & apart).select(
        F.col("a.word").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("b.n").alias("n"), F.col("b.word").alias("form")
    )
    return near


def near_words(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(word, n_near, n, form)``: near words of each word that has any, the best of them.

    ``words``: a written table ``(word, n)`` of distinct words.
    """
    rows = words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "word", "n")
    rows = rows.withColumn("text", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    depth, found = s.head, None
    while True:
        rows = rows.withColumn("key", F.substring("text", 1, depth))
        sizes = rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size"))
        large = sizes.where(F.col("size") > s.largest).select("side", "key")
        several = large.limit(1).count() > 0  # without any, the last cut was enough
        fitting = rows.join(large, ["side", "key"], "left_anti") if several else rows
        near = _parted(fitting, s)
        found = near if found is None else found.unionByName(near)
        if not several:
            break
        cut = rows.join(large, ["side", "key"], "left_semi")
        cut = materialize(cut.select("side", "text", "word", "n"), "cut")
        found = found.unionByName(_at_letter(cut, depth, s))
        rows = cut.where(F.length("text") > depth)
        depth += 1
    best = F.min_by("form", F.struct((-F.col("n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("n").alias("n"), best.alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the last word that the forms lead to.

    Each round joins every word with twice the steps; a form is several times as frequent
    as its word, so chains are short and never close.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left")
        moved = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "links")
        links = moved.select("word", "root")
        if moved.where("more").limit(1).count() == 0:
            return links


def group_variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every frequent word of ``(doc_id, text)``.

    Runs of letters A-Z, a-z and U+00C0 to U+00FF are words, A-Z lower-cased; one run in
    ``drop_one_in`` loses a letter, by a CRC of id and run, so that misspellings exist.
    Null and empty texts have none; a null id counts as an empty one. Every row counts,
    repeated ones too. Of equally frequent near words the smallest in code-point order is
    the form. Other columns are not read; no documents give no rows.
    """
    words = materialize(frequent_words(docs, s), "words")
    near = near_words(words, s).withColumnRenamed("n", "form_n")
    table = words.join(near, "word", "left")
    follows = F.coalesce(F.col("form_n") >= s.times * F.col("n"), F.lit(False))
    table = table.select(
        "word",
        F.when(follows, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("form_n")).alias("form_n"),
    )
    table = materialize(table, "variants")
    ends = roots(table.where("form IS NOT NULL"))
    full = table.join(ends, "word", "left")
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
