"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most ``capacity`` ids; a full piece is a sequence of
its own. The others are dealt by hash to shards of a bounded number of pieces. Several
islands evolve packings of each shard in tasks of their own. A packing is a grouping of
pieces into bins; crossover injects whole well-filled bins of one parent into another,
removes the bins that hold a piece twice, and puts displaced pieces back by best fit.
After each epoch an island's elite moves on to the next island of its shard. The pieces
of bins that stayed poorly filled anywhere are dealt anew and evolve once more together.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize
from opinara.llm.tokenizing import encoder


@dataclass(frozen=True)
class Evolution:
    shard_pieces: int = 16_000
    islands: int = 2
    epochs: int = 2
    population: int = 4
    generations: int = 6
    well_filled: float = 0.99  # of capacity, of bins that crossover may inject
    seed: int = 7


def cut_documents(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, end id included."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = encoder(vocabulary).batch(batch.column(1))
        owner, piece, start, length, check = [], [], [], [], []
        for i in range(batch.num_rows):
            own = np.append(ids[at[i] : at[i + 1]], ids.dtype.type(end_id)).astype("<u4")
            k = -(-len(own) // capacity)
            head = len(own) - capacity * (k - 1)
            low = 0
            for p in range(k):
                high = head + capacity * p
                owner.append(i)
                piece.append(p)
                start.append(low)
                length.append(high - low)
                check.append(zlib.crc32(own[low:high].tobytes()))
                low = high
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, check)),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Open bins by free space, for best fit in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def open(self, name: int, space: int) -> None:
        self.free[space].append(name)
        self.mask |= 1 << space

    def place(self, size: int) -> int:
        """The fullest bin that still takes ``size``, or a new one."""
        fits = self.mask >> size
        if not fits:
            name, space = self.count, self.capacity
            self.count += 1
        else:
            space = size + (fits & -fits).bit_length() - 1
            names = self.free[space]
            name = names.pop()
            if not names:
                self.mask ^= 1 << space
        self.open(name, space - size)
        return name


def best_fit(lengths: np.ndarray, order: np.ndarray, kept: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of all pieces: ``kept`` has those that stay, -1 for pieces to place in ``order``."""
    out = kept.copy()
    bins = Bins(capacity)
    stay = np.flatnonzero(kept >= 0)
    if len(stay):
        names, out[stay] = np.unique(kept[stay], return_inverse=True)
        space = capacity - np.bincount(out[stay], weights=lengths[stay]).astype(np.int64)
        bins.count = len(names)
        for name in range(len(names)):
            bins.open(name, int(space[name]))
    out[order] = [bins.place(size) for size in lengths[order].tolist()]
    return out


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, which are easier to empty."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return -len(fill), float((fill**2).sum())


def crossover(a, b, lengths, capacity, well_filled, rng) -> np.ndarray:
    """A child: ``a`` with some whole well-filled bins of ``b``."""
    fill = np.bincount(b, weights=lengths) / capacity
    inject = (fill >= well_filled) & (rng.random(len(fill)) < 0.5)
    held = inject[b]
    struck = np.zeros(a.max() + 1, bool)
    struck[a[held]] = True
    # some of the least filled bins give up their pieces, too
    own = np.bincount(a, weights=lengths) / capacity
    struck |= (own < well_filled) & (rng.random(len(own)) < 0.5)
    kept = np.where(struck[a], -1, a)
    kept[held] = a.max() + 1 + b[held]
    loose = np.flatnonzero(kept < 0)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    return best_fit(lengths, order, kept, capacity)


def evolve(lengths: np.ndarray, arrivals: list[np.ndarray], capacity: int, e: Evolution, rng) -> list[np.ndarray]:
    """Evolve packings of one shard on one island; the best come first."""
    population = list(arrivals)
    none = np.full(len(lengths), -1, np.int64)
    while len(population) < e.population:
        noise = rng.random(len(lengths)) * (0 if not population else capacity / 16)
        population.append(best_fit(lengths, np.argsort(-lengths - noise, kind="stable"), none, capacity))
    rank = lambda p: fitness(lengths, p, capacity)
    least = -(-int(lengths.sum()) // capacity)
    population.sort(key=rank, reverse=True)
    for _ in range(e.generations):
        if population[0].max() + 1 <= least:
            break
        i, j = rng.permutation(len(population))[:2] if len(population) > 1 else (0, 0)
        population.append(crossover(population[i], population[j], lengths, capacity, e.well_filled, rng))
        population.append(crossover(population[j], population[i], lengths, capacity, e.well_filled, rng))
        population.sort(key=rank, reverse=True)
        del population[e.population :]
    return population


def pack_shards(pieces: DataFrame, capacity: int, e: Evolution) -> DataFrame:
    """``(uid, shard, bin, length)`` for the pieces ``(uid, shard, length)`` of all shards."""
    cols = "shard long, island int, bins array<int>"

    def start(key, rows):
        return run(key, rows, [])

    def go_on(key, rows, elite):
        best = elite.sort_values("island")["bins"]
        return run(key, rows, [np.asarray(b, np.int64) for b in best])

    def run(key, rows, arrivals):
        if not len(rows):
            return pd.DataFrame({"shard": [], "island": [], "bins": []})
        rows = rows.sort_values("uid")
        seed = [e.seed, int(key[0]) & 0xFFFFFFFF, int(key[1]), len(arrivals)]
        found = evolve(rows["length"].to_numpy(np.int64), arrivals, capacity, e, np.random.default_rng(seed))
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [found[0].astype(np.int32)]})

    def finish(key, rows, elite):
        rows = rows.sort_values("uid")
        lengths = rows["length"].to_numpy(np.int64)
        packings = [np.asarray(b, np.int64) for b in elite.sort_values("island")["bins"]]
        best = max(packings, key=lambda p: fitness(lengths, p, capacity))
        return pd.DataFrame({"uid": rows["uid"], "shard": rows["shard"], "bin": best, "length": lengths})

    rows = pieces.select("uid", "shard", "length")
    islands = F.explode(F.sequence(F.lit(0), F.lit(e.islands - 1))).alias("island")
    everywhere = rows.select("*", islands)
    elite = materialize(everywhere.groupBy("shard", "island").applyInPandas(start, cols), "elite")
    for _ in range(e.epochs - 1):
        moved = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(e.islands)).cast("int"))
        both = elite.unionByName(moved) if e.islands > 1 else elite
        elite = materialize(
            everywhere.groupBy("shard", "island")
            .cogroup(both.groupBy("shard", "island"))
            .applyInPandas(go_on, cols),
            "elite",
        )
    return (
        rows.groupBy("shard")
        .cogroup(elite.groupBy("shard"))
        .applyInPandas(finish, "uid long, shard long, bin long, length long")
    )


def dealt(pieces: DataFrame, e: Evolution, salt: int) -> DataFrame:
    shards = max(1, -(-pieces.count() // e.shard_pieces))
    return pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(shards)))


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 1024,
    evolution: Evolution = Evolution(),
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A null or empty text is one piece, the end id. Rows with a repeated or null key are
    packed like any other. An empty table gives an empty one.
    """
    e = evolution
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(
        cut_documents(docs, vocabulary, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()),
        "pieces",
    )
    parts = pieces.where(F.col("length") < capacity).select("uid", "length")
    packed = materialize(pack_shards(dealt(parts, e, 0), capacity, e), "packed")
    # bins that stayed poorly filled are opened again and dealt anew
    fills = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    poor = fills.where(F.col("fill") < e.well_filled * capacity).select("shard", "bin")
    opened = packed.join(poor, ["shard", "bin"], "left_semi").select("uid", "length")
    again = materialize(pack_shards(dealt(opened, e, 1), capacity, e), "packed_again")
    settled = packed.join(poor, ["shard", "bin"], "left_anti")
    # rounds are told apart by the lowest bit, shards by the bits above 32
    named = lambda rows, n: rows.select(
        "uid", "length", ((F.col("shard") * (1 << 32) + F.col("bin")) * 2 + n).alias("sequence_id")
    )
    binned = named(settled, 0).unionByName(named(again, 1))
    before = F.coalesce(F.expr("sum(length) OVER (PARTITION BY sequence_id ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    placed = binned.select("uid", "sequence_id", before.alias("offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(
        *names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.join(placed, "uid").select(*names, "sequence_id", "offset")
    return full.unionByName(rest)
