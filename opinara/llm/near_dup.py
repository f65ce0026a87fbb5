"""Near-duplicate groups: MinHash bands, odd sketches, exact links.

1. Every text becomes its set of word shingles. Texts with the same set form a class;
   everything after works on classes, so exact copies cost one row per task.
2. MinHash samples of a class give bands, whose hashes name buckets, and an odd sketch:
   a bitmap in which every sample toggles one bit. Samples that two classes share cancel
   in the exclusive or of their bitmaps, so its population count tells how many differ,
   most precisely where similarity is high.
3. In each bucket all classes are compared with the smallest and the largest one. Pairs
   whose sketches may reach the threshold are confirmed on full sets; links join classes
   into components.
4. Buckets that still hold several components are compared in blocks of bounded size,
   each pair of blocks in its own group of rows, by sketch. Components that sketches
   cannot tell apart form clusters, in which all pairs of different components are
   compared on full sets, again in pairs of blocks. A group of rows gives only the edges
   that join components, fewer than it has rows. So no link is lost that a band has seen,
   and a bucket of thousands of copies, one component by then, is not compared again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import materialize, slices
from opinara.llm.graph import components
from opinara.llm.words import BASE, grams_within, mix, words_of

SCAN_BYTES = 1_000_000  # of text per slice: its hashes stay in the processor's cache


@dataclass(frozen=True)
class Settings:
    """``percent`` of the union that two sets must share. With ``bands * rows`` samples a
    pair at the threshold misses every band with probability (1 - t**rows)**bands: under
    one in a million for the defaults. ``margin`` is in standard deviations of the sketch."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    bits: int = 512
    margin: float = 6.0
    block: int = 512
    set_block: int = 128
    filter_bits: int = 1 << 23

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair may reach the threshold."""
        t, k = self.percent / 100, self.samples
        differ = k * (1 - t) + self.margin * math.sqrt(k * t * (1 - t))
        expected = self.bits / 2 * (1 - math.exp(-4 * min(differ, k) / self.bits))
        return min(self.bits, math.ceil(expected + self.margin * math.sqrt(self.bits) / 4))


# Settings of the registered query: sets of three words, 85 of 100.
THREE_WORDS = Settings(words=3, percent=85, bands=24, rows=5)


def multipliers(n: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)
    return mix(steps) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their offsets."""
    words = words_of(column)
    doc, value = grams_within(words, k, whole_if_short=True)
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    n = len(words.first) - 1
    at = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        value[at[i] : at[i + 1]].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return value[keep], kept[at]


def set_names(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two signed numbers."""
    names = []
    for salt in (np.uint64(0x51ED27), np.uint64(0xA24BAED4)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + salt), dtype=np.uint64)])
        names.append(mix(total[at[1:]] - total[at[:-1]]).view(np.int64))
    return names[0], names[1]


def signatures(value: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and odd sketches; rows of empty sets hold zeros."""
    n = len(at) - 1
    bands = np.zeros((n, s.bands), np.uint64)
    bitmap = np.zeros((n, s.bits), np.uint8)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        begin, rows = at[:-1][full], np.arange(len(full))
        band = np.zeros(len(full), np.uint64)
        toggled = np.zeros((len(full), s.bits), np.uint8)
        for j, factor in enumerate(multipliers(s.samples)):
            least = np.minimum.reduceat(value * factor, begin)
            sample = mix(least + np.uint64(j))
            toggled[rows, (sample % np.uint64(s.bits)).astype(np.int64)] ^= 1
            band = mix(band * np.uint64(BASE) + sample)
            if j % s.rows == s.rows - 1:
                bands[full, j // s.rows] = band
                band = np.zeros(len(full), np.uint64)
        bitmap[full] = toggled
    packed = np.packbits(bitmap, axis=1).view(np.uint64) if n else np.zeros((0, s.bits // 64), np.uint64)
    return bands, packed


def long_lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = pa.array(np.arange(0, n * width + 1, width), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1).view(np.int64)))


def sign(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SCAN_BYTES):
                value, at = shingle_sets(part.column(1), s.words)
                one, two = set_names(value, at)
                bands, sketch = signatures(value, at, s)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(one), pa.array(two), long_lists(sketch), long_lists(bands)],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, n_shingles long, s1 long, s2 long, sketch array<long>, bands array<long>",
    )


def full_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """``(cid, items)`` of the wanted classes ``(cid, s1, s2)``, from the texts again.

    A bitmap of fixed size, by set name, goes to all tasks; the few other sets that pass
    it fall out in the join. A task emits a set once.
    """
    words = (
        wanted.select(F.pmod("s1", F.lit(s.filter_bits)).alias("bit"))
        .select(F.expr("bit div 64 AS w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT)) AS b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()  # at most filter_bits / 64 rows
    )
    bitmap = np.zeros(s.filter_bits // 64, np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SCAN_BYTES):
                value, at = shingle_sets(part.column(0), s.words)
                one, two = set_names(value, at)
                bits = np.mod(one, s.filter_bits)
                hit = (shared.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
                take = np.flatnonzero((hit == 1) & (at[1:] > at[:-1])).tolist()
                fresh = []
                for i in take:
                    name = (int(one[i]), int(two[i]))
                    if name not in done:
                        done.add(name)
                        fresh.append(i)
                if len(done) > 200_000:  # forgetting costs repeated rows only
                    done.clear()
                if fresh:
                    items = [value[at[i] : at[i + 1]].view(np.int64) for i in fresh]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[fresh]), pa.array(two[fresh]), pa.array(items, pa.list_(pa.int64()))],
                        names=["s1", "s2", "items"],
                    )

    sets = docs.select("text").mapInArrow(run, "s1 long, s2 long, items array<long>")
    return sets.join(wanted, ["s1", "s2"]).groupBy("cid").agg(F.first("items").alias("items"))


def sketch_bits(a: str, b: str):
    pairs = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda t, x: t + x)


def may_link(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes and sketches allow a link, with both sizes."""
    a = classes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    b = classes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
    sized = pairs.join(a, "a").join(b, "b").where(
        F.expr(f"100 * least(na, nb) >= {s.percent} * greatest(na, nb)")
    )
    return sized.where(sketch_bits("ka", "kb") <= s.most_bits).select("a", "b", "na", "nb")


def confirm(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose full sets share ``percent`` of their union."""
    a = sets.select(F.col("cid").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("cid").alias("b"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib")).cast("long")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", shared.alias("shared"))
    return both.where(f"100 * shared >= {s.percent} * (na + nb - shared)").select("a", "b")


class Forest:
    """Joined names, for edges that join what was apart."""

    def __init__(self, names: np.ndarray):
        self.names, self.of = np.unique(names, return_inverse=True)
        self.root = np.arange(len(self.names))

    def roots(self, rows) -> np.ndarray:
        return self.root[self.of[rows]]

    def join(self, x: int, y: int) -> tuple[int, int] | None:
        a, b = self.root[self.of[x]], self.root[self.of[y]]
        if a == b:
            return None
        self.root[self.root == b] = a
        return int(self.names[self.of[x]]), int(self.names[self.of[y]])


def by_blocks(rows: DataFrame, key: str, block: int, size: str = "size") -> DataFrame:
    """Rows once for every pair of blocks of their group that they belong to.

    A group of ``size`` rows is cut into blocks by hash. Two blocks, or one with itself,
    make a group ``(key, i, j)`` of a bounded number of rows.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    return (
        rows.withColumn("blk", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("blk", "other"))
        .withColumn("j", F.greatest("blk", "other"))
        .drop("other", size)
        .repartition(key, "i", "j")
        .sortWithinPartitions(key, "i", "j")
    )


def edges_in_groups(rows: DataFrame, key: str, find) -> DataFrame:
    """Edges ``(a, b)`` that ``find`` yields for each group of sorted rows ``(key, i, j)``."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "i", "j")]
            change = np.zeros(batch.num_rows, bool)
            for v in k:
                change[1:] |= v[1:] != v[:-1]
            change[0] = last is not None and last != tuple(v[0] for v in k)
            low = 0
            for high in np.flatnonzero(change).tolist():
                if high > low:
                    held.append(batch.slice(low, high - low))
                yield from emit(held)
                held, low = [], high
            held.append(batch.slice(low))
            last = tuple(v[-1] for v in k)
        yield from emit(held)

    def emit(held):
        if held:
            found = list(find(pa.Table.from_batches(held).combine_chunks()))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def column(g: pa.Table, name: str) -> np.ndarray:
    return g.column(name).to_numpy()


def flat(g: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    lists = g.column(name).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def plausible(s: Settings):
    """Edges that join the components of a bucket which sketches cannot tell apart."""

    def find(g: pa.Table):
        n, comp, blk = column(g, "n"), column(g, "comp"), column(g, "blk")
        across = g.column("i")[0] != g.column("j")[0]
        k = flat(g, "sketch")[0].view(np.uint64).reshape(len(n), -1)
        order = np.argsort(n, kind="stable")
        n, comp, blk, k = n[order], comp[order], blk[order], k[order]
        forest = Forest(comp)
        if len(forest.names) < 2:
            return
        for x in range(len(n)):
            y = np.arange(x + 1, np.searchsorted(n, n[x] * 100 // s.percent, side="right"))
            if across:
                y = y[blk[y] != blk[x]]
            y = y[forest.roots(y) != forest.roots(x)]
            y = y[np.bitwise_count(k[y] ^ k[x]).sum(1) <= s.most_bits] if len(y) else y
            for z in y.tolist():
                edge = forest.join(x, z)
                if edge:
                    yield edge

    return find


def linked(s: Settings):
    """Edges that join components of a cluster by links of full sets, all pairs compared."""

    def find(g: pa.Table):
        comp, blk = column(g, "comp"), column(g, "blk")
        across = g.column("i")[0] != g.column("j")[0]
        forest = Forest(comp)
        if len(forest.names) < 2:
            return
        items, at = flat(g, "items")
        n, rows = np.diff(at), np.repeat(np.arange(len(comp)), np.diff(at))
        _, name, times = np.unique(items, return_inverse=True, return_counts=True)
        again = times > 1
        name, rows = (np.cumsum(again) - 1)[name[again[name]]], rows[again[name]]
        shared = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(name, kind="stable")
        name, rows = name[order], rows[order]
        for low in range(0, int(again.sum()), 8192):
            part = slice(*np.searchsorted(name, [low, low + 8192]))
            held = np.zeros((len(n), 8192), np.float32)
            held[rows[part], name[part] - low] = 1
            shared += held @ held.T
        link = 100.0 * shared >= float(s.percent) * (n[:, None] + n[None, :] - shared)
        link &= comp[:, None] != comp[None, :]
        if across:
            link &= blk[:, None] != blk[None, :]
        for x, y in np.argwhere(np.triu(link, 1)).tolist():
            edge = forest.join(x, y)
            if edge:
                yield edge

    return find


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    A component is named by its smallest key, which is the one kept. Texts without words
    have no shingles and are linked with nothing; a text of fewer words than a shingle is
    one shingle. Null keys take part in links but name no component: if no row of a
    component has a key, its name is null, and rows without a key are not kept.
    """
    s = settings
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(sign(docs, s), "signed")
    classes = materialize(
        signed.where("n_shingles > 0")
        .groupBy("s1", "s2")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            F.first("bands").alias("bands"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("cid", F.posexplode("bands").alias("band", "h")).select(
        "cid", F.xxhash64("band", "h").alias("h")
    )
    shared = (
        banded.groupBy("h")
        .agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    members = materialize(banded.join(shared, "h"), "members")
    stars = members.where("cid <> lo").select(F.col("lo").alias("a"), F.col("cid").alias("b")).unionByName(
        members.where("cid <> lo AND cid <> hi").select(F.col("cid").alias("a"), F.col("hi").alias("b"))
    )
    pairs = materialize(may_link(stars.distinct(), classes, s), "pairs")
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    wide = members.where("size > 3").select("cid")
    wanted = classes.select("cid", "s1", "s2").join(ends.unionByName(wide).distinct(), "cid", "left_semi")
    sets = materialize(full_sets(docs, wanted, s), "sets")
    links = materialize(confirm(pairs, sets, s), "links")
    first = components(links)
    # buckets of more than three that still hold several components
    placed = members.where("size > 3").join(first, F.col("cid") == F.col("node"), "left").select(
        "h", "cid", "size", F.coalesce("component", "cid").alias("comp")
    )
    placed = materialize(placed, "placed")
    open_buckets = (
        placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    )
    sketches = classes.select("cid", F.col("n_shingles").alias("n"), "sketch")
    opened = placed.join(open_buckets, "h", "left_semi").join(sketches, "cid")
    coarse = components(edges_in_groups(by_blocks(opened, "h", s.block), "h", plausible(s)))
    # components that a sketch cannot tell apart: all their pairs, on full sets
    inside = placed.select("cid", F.col("comp").alias("node")).distinct().join(coarse, "node").select(
        F.col("component").alias("cluster"), "cid", F.col("node").alias("comp")
    )
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    clusters = inside.join(sizes, "cluster").join(sets, "cid")
    more = edges_in_groups(by_blocks(clusters, "cluster", s.set_block), "cluster", linked(s))
    grouped = components(
        first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    )
    placed_all = classes.join(grouped, F.col("cid") == F.col("node"), "left").select(
        "s1", "s2", "doc_id", F.coalesce("component", "cid").alias("comp")
    )
    names = placed_all.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed_all.join(names, "comp").select("s1", "s2", "component_id")
    # a text without shingles is its own component
    rows = signed.select("doc_id", "n_shingles", "s1", "s2")
    found = rows.where("n_shingles > 0").join(named, ["s1", "s2"], "left").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
