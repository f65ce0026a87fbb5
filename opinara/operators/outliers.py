"""Interquartile fences and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.ordering import id_positions
from opinara.operators.profiling import exact_quantiles, fence_struct, is_missing
from opinara.session import cut_lineage

SAMPLE = 256  # default rows per tree, the size the method was published with


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Complete rows with a value outside its column's fences, and how many."""
    complete = df
    for c in cols:
        complete = complete.where(~is_missing(df, c))
    limits = fence_struct(complete, cols, k)
    flags = F.lit(0)
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        outside = (x < limits[f"f{i}"]["lower"]) | (x > limits[f"f{i}"]["upper"])
        flags = flags + outside.cast("int")
    return complete.withColumn("n_flags", flags).where(F.col("n_flags") > 0)


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(feature, cut, left, right, depth value)``; feature -1 marks a leaf."""
    limit = max(1, math.ceil(math.log2(max(len(points), 2))))
    nodes: list[tuple] = []
    waiting = [(points, 0, None)]
    while waiting:
        rows, depth, slot = waiting.pop()
        here = len(nodes)
        if slot is not None:
            parent, side = slot
            nodes[parent][side] = here
        varied = np.flatnonzero(rows.min(0) < rows.max(0)) if len(rows) > 1 else []
        if depth >= limit or len(varied) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_path_norm(len(rows)))])
            continue
        feature = int(rng.choice(varied))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = rng.uniform(low, high)
        left = rows[:, feature] <= cut
        nodes.append([feature, float(cut), -1, -1, 0.0])
        waiting.append((rows[left], depth + 1, (here, 2)))
        waiting.append((rows[~left], depth + 1, (here, 3)))
    return [tuple(n) for n in nodes]


def fit_forest(
    df: DataFrame,
    cols: Sequence[str],
    key: str,
    trees: int = 100,
    seed: int = 42,
    sample: int = SAMPLE,
) -> list[np.ndarray]:
    """One node array per tree, each grown on ``sample`` distinct rows, or all if fewer.

    Every tree draws positions among all rows; rows are found by their position in key
    order. Draws and nodes are at most ``trees * sample`` and twice that, at any size.
    """
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    narrow = df.select(F.col(key).alias("key"), *values)
    rows = narrow.count()
    drawn = [
        (tree, int(at) + 1, place)
        for tree in range(trees)
        for place, at in enumerate(
            np.random.default_rng([seed, tree, 1]).choice(rows, min(sample, rows), replace=False)
        )
    ]
    places = df.sparkSession.createDataFrame(drawn, "tree int, pos long, place int")
    sampled = id_positions(narrow, "key", out="pos").join(F.broadcast(places), "pos")
    names = [f"x{i}" for i in range(len(cols))]

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        points = rows.sort_values("place")[names].to_numpy()
        nodes = _grow(points, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "value"])
        return out.assign(tree=tree, node=range(len(nodes)))

    schema = "feature int, cut double, left int, right int, value double, tree int, node int"
    grown = sampled.groupBy("tree").applyInPandas(grow, schema).toPandas()
    grown = grown.sort_values(["tree", "node"])
    return [
        g[["feature", "cut", "left", "right", "value"]].to_numpy()
        for _, g in grown.groupby("tree")
    ]


def score_rows(
    df: DataFrame, cols: Sequence[str], forest: list[np.ndarray], sample_rows: int
) -> DataFrame:
    """Add ``iso_depth_score`` = 2^(-mean path / norm); near 1 is anomalous."""
    norm = max(float(_path_norm(sample_rows)), 1e-12)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        grown = shared.value
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for tree in grown:
                feature, cut = tree[:, 0].astype(int), tree[:, 1]
                child = tree[:, 2:4].astype(int)
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    right = x[rows, np.maximum(f, 0)] > cut[at]
                    at = np.where(inner, child[at, right.astype(int)], at)
                total += tree[at, 4]
            yield pd.Series(np.power(2.0, -total / (len(grown) * norm)))

    udf = F.pandas_udf(score, "double")
    return df.withColumn("iso_depth_score", udf(*[F.col(c).cast("double") for c in cols]))


def isolation_forest(
    df: DataFrame,
    cols: Sequence[str],
    key: str,
    trees: int = 100,
    contamination: float = 0.05,
    seed: int = 42,
    sample: int = SAMPLE,
) -> DataFrame:
    """Complete rows with ``iso_score`` (negative is anomalous) and ``iso_label`` (-1, 1).

    The cut is the exact contamination quantile of all scores. Scores are written to
    the checkpoint folder once, since both the quantile and the labels read them.
    """
    complete = df
    for c in cols:
        complete = complete.where(~is_missing(df, c))
    complete = complete.select(key, *cols)
    forest = fit_forest(complete, cols, key, trees, seed, sample)
    scored = score_rows(complete, cols, forest, complete.limit(sample).count())
    kept = cut_lineage(scored.select(key, *cols, (-F.col("iso_depth_score")).alias("raw")))
    cut = exact_quantiles(kept, ["raw"], [contamination]).select("quantile").scalar()
    return kept.select(
        key,
        *cols,
        (F.col("raw") - cut).alias("iso_score"),
        F.when(F.col("raw") < cut, -1).otherwise(1).alias("iso_label"),
    )
