"""Pearson, Spearman and Kendall matrices over rows complete in all columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.ordering import double_digits, lookup_join, running_total
from opinara.operators.profiling import is_missing
from opinara.session import cut_lineage, materialize


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    whole = F.lit(True)
    for c in cols:
        whole = whole & ~is_missing(df, c)
    return df.where(whole).select(*[F.col(c).cast("double").alias(c) for c in cols])


def _check(cols: Sequence[str]) -> None:
    if len(cols) < 2:
        raise ValueError("correlation needs two or more numeric columns")


def _long(row: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle as ``(a, b, r)`` in column order, from one pass."""
    _check(cols)
    pairs = list(combinations(cols, 2))
    rows = complete_rows(df, cols)
    return _long(rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]), pairs)


def _rank_table(rows: DataFrame, col: str) -> DataFrame:
    """``(col, times, avg_rank, dense)`` per distinct value; ``times`` counts its rows."""
    counts = rows.groupBy(col).agg(F.sum("n").alias("times"))
    ranked = running_total(
        counts,
        [F.col(col)],
        double_digits(F.col(col)),
        {"upto": F.col("times"), "dense": F.lit(1)},
    )
    return ranked.select(
        col, "times", (F.col("upto") - (F.col("times") - 1) / 2).alias("avg_rank"), "dense"
    )


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson of average ranks; equal rows are counted once and weighted."""
    _check(cols)
    rows = cut_lineage(complete_rows(df, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))
    total = rows.agg(F.sum("n").alias("t")).scalar()
    ranked = rows
    for i, c in enumerate(cols):
        table = _rank_table(rows, c).withColumnRenamed("avg_rank", f"k{i}")
        ranked = lookup_join(ranked, table, c, "times", [f"k{i}"], total)
    pairs = list(combinations(range(len(cols)), 2))
    n = F.sum("n")
    # Ranks are centred on their mean, which is the same for every column.
    z = {i: F.col(f"k{i}") - (F.col("all") + 1) / 2 for i in range(len(cols))}
    centred = ranked.withColumn("all", total)
    sums = centred.agg(
        n.alias("n"),
        *[F.sum(F.col("n") * z[i] * z[i]).alias(f"v{i}") for i in z],
        *[F.sum(F.col("n") * z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )
    row = sums.select(
        *[
            (F.col(f"c{i}_{j}") / F.sqrt(F.col(f"v{i}") * F.col(f"v{j}"))).alias(f"r{p}")
            for p, (i, j) in enumerate(pairs)
        ]
    )
    return _long(row, list(combinations(cols, 2)))


DIGIT = 6  # bits of a rank that are compared at a time
PART_ROWS = 500_000  # about as many stand in one part of the order


def _ties(rows: DataFrame, col: str) -> DataFrame:
    """One row: distinct values, rows, and pairs of rows of one value."""
    t = F.col("t").cast("double")
    counts = rows.groupBy(col).agg(F.sum("n").alias("t"))
    return counts.agg(F.count(F.lit(1)).alias("d"), F.sum("t").alias("n"), F.sum(t * (t - 1) / 2).alias("same"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before, the first row among them."""
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(differs)


def _scored(y: np.ndarray, digit: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[float, np.ndarray]:
    """Score of rows of one group in the order of ``y``, and the counts per digit after
    them; ``seen`` holds those before them, all of smaller ``y``."""
    rows = np.arange(len(y))
    weight = np.zeros((len(y) + 1, len(seen)))
    weight[rows + 1, digit] = n
    upto = np.cumsum(weight, 0) + seen
    at = _starts(y)
    before = upto[np.repeat(at, np.diff([*at, len(y)]))]  # equal y do not count
    below = np.cumsum(before, 1)
    lower, higher = below[rows, digit] - before[rows, digit], below[:, -1] - below[rows, digit]
    return float(n @ (lower - higher)), upto[-1]


def _concordance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score ``s`` of a part of the rows ``(level, prefix, y, digit, n)``, which are in
    order, and the counts per digit of its first and last group ``(level, prefix)``,
    the only ones that other parts may share."""
    part = TaskContext.get().partitionId()
    groups: list[tuple] = []  # first and last so far, with their counts
    score, held = 0.0, None

    def add(rows: list[np.ndarray]) -> float:
        total, low = 0.0, _starts(*rows[:2])
        for a, b in zip(low, [*low[1:], len(rows[0])]):
            group = int(rows[0][a]), int(rows[1][a])
            fresh = not groups or groups[-1][0] != group
            seen = np.zeros(1 << DIGIT) if fresh else groups.pop()[1]
            s, seen = _scored(*(c[a:b] for c in rows[2:]), seen)
            groups[1:] = []
            groups.append((group, seen))
            total += s
        return total

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        rows = rows if held is None else [np.concatenate(both) for both in zip(held, rows)]
        if len(rows[0]):
            last = _starts(*rows[:3])[-1]  # rows of this y may go on in the next batch
            held = [c[last:] for c in rows]
            score += add([c[:last] for c in rows]) if last else 0.0
    if held is not None:
        score += add(held)
    out = [(part, *group, d, float(c), 0.0) for group, seen in groups for d, c in enumerate(seen)]
    out += [(part, 0, 0, -1, 0.0, score)] if held is not None else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["part", "level", "prefix", "digit", "n", "s"])


def _score(ranked: DataFrame, y: str, levels: int, size: int) -> float:
    """Concordant less discordant pairs of rows ``(rx, y, n)``, in parts along ``y``."""
    keys = ["level", "prefix", "y"]
    rows = ranked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select(
        F.col("level").cast("bigint").alias("level"),
        F.expr(f"shiftright(rx, {DIGIT} * (level + 1))").alias("prefix"),
        F.col(y).alias("y"),
        F.expr(f"shiftright(rx, {DIGIT} * level) & {(1 << DIGIT) - 1}L").alias("digit"),
        F.col("n").cast("double").alias("n"),
    )
    if levels > 1:  # at most one row per digit
        rows = materialize(rows.groupBy(*keys, "digit").agg(F.sum("n").alias("n")), "digits")
    parts = rows.repartitionByRange(max(1, -(-size * levels // PART_ROWS)), *keys).sortWithinPartitions(*keys)
    found = materialize(
        parts.mapInArrow(_concordance, "part long, level long, prefix long, digit long, n double, s double"), "concordance"
    )
    # groups that go on from part to part: rows of the parts before, per digit
    shared = found.where("digit >= 0")
    earlier = Window.partitionBy("level", "prefix", "digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("part", "level", "prefix")
    upto = across.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shared.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0.0))).select(
        "n", "before", F.sum("before").over(upto).alias("upto"), F.sum("before").over(across).alias("all")
    )
    lower, higher = F.col("upto") - F.col("before"), F.col("all") - F.col("upto")
    own = found.agg(F.sum("s")).first()[0] or 0.0
    return own + (placed.agg(F.sum(F.col("n") * (lower - higher))).first()[0] or 0.0)


def kendall_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two columns as ``(a, b, r)``, exact, without forming pairs of rows.

    Write the dense rank of one column, that of fewer values, in digits of six bits. Two
    different ranks agree down to one digit and differ there, so every pair of rows with
    different ranks meets in exactly one group ``(level, higher digits)``, and the digits
    tell their order. Along the other column, running counts per digit tell each row how
    many partners are concordant and how many discordant. The rows are dealt by range of
    group and that column; groups cut by a range are settled from counts per part. Work
    grows with distinct pairs times the number of digits.
    """
    rows = materialize(complete_rows(df, [x, y]).groupBy(x, y).agg(F.count(F.lit(1)).alias("n")), "pairs")
    ties = {r["c"]: r for r in _ties(rows, x).withColumn("c", F.lit(0)).union(_ties(rows, y).withColumn("c", F.lit(1))).collect()}
    size, n = rows.count(), ties[0]["n"]
    score = every = None
    if n:
        few, other = (x, y) if ties[0]["d"] <= ties[1]["d"] else (y, x)
        table = _rank_table(rows, few).select(few, "times", (F.col("dense") - 1).alias("rx"))
        ranked = lookup_join(rows, table, few, "times", ["rx"], F.lit(n))
        levels = max(1, -(-(min(t["d"] for t in ties.values()) - 1).bit_length() // DIGIT))
        score, every = _score(ranked, other, levels, size), float(n) * (n - 1) / 2
    score, every = F.lit(score).cast("double"), F.lit(every).cast("double")
    return df.sparkSession.range(1).select(
        F.lit(x).alias("a"),
        F.lit(y).alias("b"),
        (score / F.sqrt((every - F.lit(ties[0]["same"])) * (every - F.lit(ties[1]["same"])))).alias("r"),
    )


def kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    _check(cols)
    rows = complete_rows(df, cols)
    parts = [kendall_pair(rows, a, b) for a, b in combinations(cols, 2)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def correlations(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, cols)


def strong_pairs(corr: DataFrame, cols: Sequence[str], threshold: float = 0.7, k: int = 10) -> DataFrame:
    """The first ``k`` pairs, in column order, with a strong correlation."""
    order = F.array(*[F.lit(c) for c in cols])
    strong = corr.where(F.abs("r") > threshold)
    ranked = strong.orderBy(
        F.array_position(order, F.col("a")), F.array_position(order, F.col("b"))
    )
    return ranked.select("a", "b", F.abs("r").alias("r")).limit(k)
