"""Quality rules: base counts and robust multivariate outliers.

Each text gives counts, the counts a vector: log mean word length, and the arcsine roots
of the shares of symbols, repeated lines and repeated words. Per language and source, a
minimum-covariance-determinant estimate describes the bulk of the vectors. It starts from
two deterministic guesses and concentrates: the ``share`` of rows nearest to the estimate
gives the next one. The start of the smaller determinant goes on. Rows far from their
group's final estimate are rejected.

Every step is two aggregations of all rows: counts per group and distance bin, which give
the distance that holds the share, and sums of products below it. Groups are never
gathered. A group of fewer than ``least_rows`` rows joins the rest of its language, a
language's rest that is still smaller joins all other such rows; a rest of fewer rows than
that is judged by the base rules alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.batches import materialize, slices
from opinara.llm.words import BASE, SPACED, gram_hash, mix, raw_bytes, span_hash, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
DIMS = 4


@dataclass(frozen=True)
class Settings:
    """``floor``: least standard deviation of each statistic, so that a statistic which is
    constant in a group does not make every other value an outlier."""

    share: float = 0.75
    tail: float = 1e-5  # of a normal bulk, rejected as outliers
    steps: int = 6
    least_rows: int = 100
    floor: tuple[float, ...] = (0.10, 0.06, 0.12, 0.10)


def count_text(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text; a null text has none."""
    w = words_of(column, SPACED, lower=False)
    raw, offsets = raw_bytes(column)
    n = len(offsets) - 1
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    inside = SPACED[raw]
    out = {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": per_text(inside & ((raw < 0x80) | (raw >= 0xC0))),
        "n_symbols": per_text(SYMBOL[raw]),
    }
    # lines with a word, and those equal to an earlier one
    breaks = np.flatnonzero(raw == 10)
    begins = np.union1d(breaks + 1, offsets[:-1])
    begins = begins[begins < len(raw)]
    text = np.searchsorted(offsets, begins, side="right") - 1
    after = np.append(breaks, len(raw))
    ends = np.minimum(after[np.searchsorted(breaks, begins)], offsets[text + 1])
    total = np.concatenate([[0], np.cumsum(inside)])
    worded = total[ends] > total[begins]
    begins, ends, text = begins[worded], ends[worded], text[worded]
    out["n_lines"] = np.bincount(text, minlength=n)
    _, lines = distinct(text, span_hash(raw, begins, ends))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[lines], minlength=n)
    # words in three-word windows that occur twice or more
    owner = np.repeat(np.arange(n), out["n_words"])
    g = gram_hash(w.hash, 3)
    at = np.flatnonzero(owner[: len(g)] == owner[2:]) if len(g) else np.zeros(0, np.int64)
    key = mix(g[at] + mix(owner[at].astype(np.uint64) + np.uint64(BASE))) if len(at) else g[:0]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = at[times[inverse] > 1]
    covered = np.zeros(len(owner) + 3, np.int64)
    np.add.at(covered, repeated, 1)
    np.add.at(covered, repeated + 3, -1)
    hit = np.cumsum(covered)[: len(owner)] > 0
    out["n_repeat_words"] = np.bincount(owner[hit], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, value)`` and the place of one row of each."""
    return np.unique(mix(value + mix(text.astype(np.uint64) + np.uint64(BASE))), return_index=True)


def with_counts(docs: DataFrame, text: str, into: str) -> DataFrame:
    """All columns of ``docs`` and a struct of counts of its text."""
    names = docs.columns
    where = names.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                counts = count_text(part.column(where))
                inner = pa.StructArray.from_arrays([pa.array(counts[c]) for c in COUNTS], names=list(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns, inner], names=[*names, into])

    fields = ", ".join(f"{c}: long" for c in COUNTS)
    schema = docs.select("*", F.lit(None).cast(f"struct<{fields}>").alias(into)).schema
    return docs.mapInArrow(run, schema)


def base_failed(c) -> Column:
    """Fewer than 50 words, or over half of them in repeated windows; ``c`` gives counts."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def vector(c) -> list[Column]:
    """The transformed statistics of a text with words."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0)))))
    return [
        F.log(F.try_divide(c("word_chars"), c("n_words"))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def chi2_cdf(x: float, half: int) -> float:
    """Of an even number of degrees of freedom, ``2 * half``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))


def chi2_quantile(p: float, half: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, half) < p else (low, mid)
    return low


X = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
MODEL = "g_lang string, g_source string, level int, start int, rows long, mean array<double>, inverse array<double>, logdet double"
GROUP = ["g_lang", "g_source", "level"]


def distance(x: list[Column], mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of a vector to its group's estimate."""
    d = [v - F.col(mean)[i] for i, v in enumerate(x)]
    terms = [
        d[i] * d[j] * F.col(inverse)[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)
    ]
    return sum(terms[1:], terms[0])


def group_keys(rows: DataFrame, s: Settings) -> DataFrame:
    """``(lang, source, g_lang, g_source, level)``: the group of each language and source."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < s.least_rows)
    rest = F.sum("n").over(Window.partitionBy("lang", "small"))
    level = F.when(~F.col("small"), 0).when(rest >= s.least_rows, 1).otherwise(2)
    return sizes.withColumn("level", level).select(
        "lang",
        "source",
        F.when(F.col("level") < 2, F.coalesce("lang", F.lit(""))).otherwise("").alias("g_lang"),
        F.when(F.col("level") < 1, F.coalesce("source", F.lit(""))).otherwise("").alias("g_source"),
        "level",
    )


def same_source(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what ``keys`` has for their language and source; null is a value."""
    right = keys.withColumnsRenamed({"lang": "k_lang", "source": "k_source"})
    on = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    return rows.join(right, on, how).drop("k_lang", "k_source")


def bin_median(rows: DataFrame, values: dict[str, Column], width: float) -> DataFrame:
    """Median bin of each value per group, from counts per bin."""
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.floor(v / width).alias("bin")) for k, v in values.items()))
    counts = rows.select(*GROUP, F.explode(pairs).alias("p")).groupBy(*GROUP, "p.name", "p.bin").count()
    by = Window.partitionBy(*GROUP, "name")
    run = F.sum("count").over(by.orderBy("bin"))
    found = counts.select(*GROUP, "name", "bin", run.alias("run"), F.sum("count").over(by).alias("all"))
    middle = found.where("2 * run >= all").groupBy(*GROUP, "name").agg(F.min("bin").alias("bin"))
    return middle.groupBy(*GROUP).pivot("name", list(values)).agg(F.first((F.col("bin") + 0.5) * width))


def estimate(sums: DataFrame, s: Settings, factor: float) -> DataFrame:
    """Means and inverse covariances from sums of products, one group a row."""
    floor = np.array(s.floor) ** 2

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n = max(r["rows"], 1)
                mean = np.array([r[x] / n for x in X])
                cov = np.zeros((DIMS, DIMS))
                for k, (i, j) in enumerate(PAIRS):
                    cov[i, j] = cov[j, i] = r[f"p{k}"] / n - mean[i] * mean[j]
                cov = cov * factor + np.diag(floor)
                inverse = np.linalg.inv(cov)
                out.append(
                    (r["g_lang"], r["g_source"], r["level"], r["start"], n, mean.tolist(),
                     [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1]))
                )
            yield pd.DataFrame(out, columns=["g_lang", "g_source", "level", "start", "rows", "mean", "inverse", "logdet"])

    return sums.mapInPandas(solve, MODEL)


def sums_of(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.sum(x).alias(x) for x in X),
        *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)),
    )


def concentrate(rows: DataFrame, model: DataFrame, s: Settings, factor: float) -> DataFrame:
    """One step: re-estimate from the share of each group that is nearest to its model."""
    near = rows.join(model.select(*GROUP, "start", "mean", "inverse"), GROUP).select(
        *GROUP, "start", *X, F.floor(64 * F.log2(distance([F.col(x) for x in X]) + 1e-9)).alias("bin")
    )
    by = [*GROUP, "start"]
    counts = near.groupBy(*by, "bin").count()
    w = Window.partitionBy(*by)
    run = counts.select(*by, "bin", F.sum("count").over(w.orderBy("bin")).alias("run"), F.sum("count").over(w).alias("all"))
    limit = run.where(F.col("run") >= F.col("all") * s.share).groupBy(*by).agg(F.min("bin").alias("limit"))
    inner = near.join(limit, by).where("bin <= limit")
    return materialize(estimate(sums_of(inner, by), s, factor), "model")


def fit(counted: DataFrame, s: Settings) -> DataFrame:
    """``(lang, source, mean, inverse)`` from ``(lang, source, counts)`` rows."""
    c = lambda name: F.col(f"counts.{name}")
    rows = counted.where(~base_failed(c)).select("lang", "source", *(v.alias(x) for v, x in zip(vector(c), X)))
    rows = materialize(rows, "vectors")
    keys = materialize(group_keys(rows, s), "groups")
    model = estimate_groups(same_source(rows, keys).select(*GROUP, *X), s)
    known = model.where(F.col("rows") >= s.share * s.least_rows)
    # written, so that its size is known where rows meet it
    return materialize(keys.join(known, GROUP).select("lang", "source", "mean", "inverse"), "group_models")


def estimate_groups(rows: DataFrame, s: Settings) -> DataFrame:
    """``MODEL`` of every group of the vectors ``rows``."""
    mid = bin_median(rows, {x: F.col(x) for x in X}, 1 / 512)
    mids = mid.select(*GROUP, *(F.col(x).alias(f"m{i}") for i, x in enumerate(X)))
    off = rows.join(mids, GROUP).select(*GROUP, *(F.abs(F.col(x) - F.col(f"m{i}")).alias(f"d{i}") for i, x in enumerate(X)))
    spread = bin_median(off, {f"d{i}": F.col(f"d{i}") for i in range(DIMS)}, 1 / 512)
    scale = [F.greatest(F.col(f"d{i}") * 1.4826, F.lit(s.floor[i])) for i in range(DIMS)]
    guess = materialize(mids.join(spread, GROUP).select(*GROUP, *(f"m{i}" for i in range(DIMS)), *(x.alias(f"s{i}") for i, x in enumerate(scale))), "guess")
    # first start: spreads alone; second: with correlations of bounded scores
    score = [F.tanh((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}")) for i, x in enumerate(X)]
    scored = rows.join(guess, GROUP).select(*GROUP, *(v.alias(x) for v, x in zip(score, X)))
    moments = sums_of(scored, GROUP).join(guess, GROUP)

    def begin(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n, mean = max(r["rows"], 1), [r[f"m{i}"] for i in range(DIMS)]
                sd = np.array([r[f"s{i}"] for i in range(DIMS)])
                m = np.array([r[x] / n for x in X])
                corr = np.eye(DIMS)
                for k, (i, j) in enumerate(PAIRS):
                    corr[i, j] = corr[j, i] = r[f"p{k}"] / n - m[i] * m[j]
                root = np.sqrt(np.maximum(np.diag(corr), 1e-3))
                corr = 0.9 * corr / np.outer(root, root)
                np.fill_diagonal(corr, 1.0)
                for start, cov in enumerate((np.diag(sd**2), corr * np.outer(sd, sd))):
                    inverse = np.linalg.inv(cov)
                    out.append((r["g_lang"], r["g_source"], r["level"], start, n, mean, [float(inverse[i, j]) for i, j in PAIRS], 0.0))
            yield pd.DataFrame(out, columns=["g_lang", "g_source", "level", "start", "rows", "mean", "inverse", "logdet"])

    half = DIMS // 2
    inner = chi2_quantile(s.share, half)
    factor = s.share / chi2_cdf(inner, half + 1)  # consistency at the normal law
    model = materialize(moments.mapInPandas(begin, MODEL), "starts")
    for step in range(s.steps):
        model = concentrate(rows, model, s, factor)
        if step == 1:
            best = Window.partitionBy(*GROUP).orderBy("logdet", "start")
            model = model.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return model


def verdict(counts: str, mean: str, inverse: str, s: Settings) -> Column:
    """Kept: the base rules hold and the vector is not far from its group's bulk."""
    c = lambda name: F.col(counts)[name]
    limit = chi2_quantile(1 - s.tail, DIMS // 2)
    near = distance(vector(c), mean, inverse) <= limit
    return ~base_failed(c) & F.coalesce(near, F.lit(True))


def quality(
    docs: DataFrame,
    settings: Settings = Settings(),
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """Counts and verdicts, one row per input row.

    A null or empty text has no words and fails the base rule. Null languages and sources
    are groups like any other. Repeated rows count each. An empty table gives none.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = materialize(with_counts(rows, "text", "counts").drop("text"), "counts")
    model = fit(counted, settings)
    joined = same_source(counted, model, "left")
    c = lambda name: F.col(f"counts.{name}")
    return joined.select(
        "doc_id",
        *(c(x).alias(x) for x in COUNTS if x != "n_lines"),
        base_failed(c).alias("base_failed"),
        verdict("counts", "mean", "inverse", settings).alias("kept"),
    )


def keep_good(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose verdict is to keep them."""
    model = fit(with_counts(docs.select("text", "lang", "source"), "text", "counts").drop("text"), settings)
    model = model.toDF("lang", "source", "model_mean", "model_inverse")
    names = docs.columns
    own = [n if n in ("text", "lang", "source") else f"c{i}" for i, n in enumerate(names)]
    rows = same_source(with_counts(docs.toDF(*own), "text", "counts"), model, "left")
    kept = rows.where(verdict("counts", "model_mean", "model_inverse", settings))
    return kept.select(*(F.col(a).alias(b) for a, b in zip(own, names)))
