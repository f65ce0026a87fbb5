"""Column profiles, quantiles and distribution data.

Moments come from one map-side-combined aggregate over all columns. Distinct counts,
modes and quantiles come from counts per value, whose shuffle key is the value, and
exact quantiles are read off running totals of those counts, so that no task ever
holds all values of a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    TimestampType,
)

from opinara.operators.ordering import double_digits, running_total
from opinara.session import materialize
from opinara.sources.schema import columns_by_type

QUARTILES = (0.25, 0.5, 0.75)
MOMENTS = ["mean", "std", "min", "max", "skew", "kurtosis"]

# Bytes of the fixed-width types.
WIDTHS = {
    BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, DateType: 4,
    LongType: 8, DoubleType: 8, TimestampType: 8,
}


def is_missing(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, (FloatType, DoubleType)):
        return F.col(col).isNull() | F.isnan(col)
    return F.col(col).isNull()


def sample_skew(c: Column, n: Column) -> Column:
    """Bias-corrected skewness; null below three values, zero for constants."""
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, zero for constants."""
    g2 = F.kurtosis(c)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(g2.isNull() | F.isnan(g2), 0.0).otherwise(corrected))


def _long(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """One row ``(col, value)`` per present cell."""
    cells = [
        F.struct(
            F.lit(c).alias("col"),
            F.when(~is_missing(df, c), F.col(c).cast(kind)).alias("value"),
        )
        for c in cols
    ]
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols: Sequence[str], kind: str = "double") -> DataFrame:
    return _long(df, cols, kind).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES
) -> DataFrame:
    """``(col, prob, quantile)`` with linear interpolation between neighbours. Counts per
    value are written once when called."""
    return quantiles_of_counts(materialize(value_counts(df, cols), "value_counts"), probs)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(col, prob, quantile)`` of a table ``(col, value, n)`` that is cheap to read.

    Running totals over blocks of neighbouring values tell which block holds each end of
    a quantile; only the values of those blocks, two at most per quantile, are ordered.
    """
    digits = double_digits(F.col("value"))
    block = ["__top", "__next"]
    keyed = counts.select("col", "value", "n", *[d.alias(b) for d, b in zip(digits, block)])
    sums = keyed.groupBy("col", *block).agg(F.sum("n").alias("n"))
    placed = running_total(
        sums, [F.col("__next")], [F.col("__top")], {"upto": F.col("n")}, ["col"], {"upto": "rows"}
    )
    place = (F.col("rows") - 1) * F.col("prob")
    ends = F.array(
        F.struct(F.lit(True).alias("low"), F.floor(place).alias("rank")),
        F.struct(F.lit(False).alias("low"), F.ceil(place).alias("rank")),
    )

    def covers(rank: Column) -> Column:
        return (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))

    wanted = (
        placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"t": place - F.floor(place), "end": F.explode(ends)})
        .where(covers(F.col("end.rank")))
    )
    # ranks count from the first row of their block on
    wanted = materialize(
        wanted.select(
            "col", *block, "prob", "t", "end.low", (F.col("end.rank") - F.col("upto") + F.col("n")).alias("rank")
        ),
        "quantile_blocks",
    )
    near = keyed.join(F.broadcast(wanted.select("col", *block).distinct()), ["col", *block], "left_semi")
    ranked = running_total(near, [F.col("value")], digits[len(block) :], {"upto": F.col("n")}, ["col", *block])
    found = ranked.join(F.broadcast(wanted), ["col", *block]).where(covers(F.col("rank")))
    low = F.col("low")
    quantiles = found.groupBy("col", "prob").agg(
        F.max(F.when(low, F.col("value"))).alias("a"),
        F.max(F.when(~low, F.col("value"))).alias("b"),
        F.max("t").alias("t"),
    )
    return quantiles.select(
        "col", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("quantile")
    )


def quartile_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with ``q25``, ``median`` and ``q75``."""
    return _quartiles_wide(exact_quantiles(df, cols))


def _quartiles_wide(quantiles: DataFrame) -> DataFrame:
    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))

    return quantiles.groupBy("col").agg(
        at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_pct)``; zero percent for an empty table."""
    rows = F.count(F.lit(1))
    one_row = df.agg(
        rows.alias("__rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns]
    )
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in df.columns]
    long = one_row.select("__rows", F.inline(F.array(*cells)))
    pct = F.when(F.col("__rows") > 0, 100 * F.col("missing_count") / F.col("__rows"))
    return long.select("column", "missing_count", F.coalesce(pct, F.lit(0.0)).alias("missing_pct"))


def numeric_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column, computed in a single pass."""
    row = []
    for c in cols:
        x = F.when(~is_missing(df, c), F.col(c).cast("double"))
        n = F.count(x).cast("double")
        row.append(
            F.struct(
                F.lit(c).alias("col"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                sample_skew(x, n).alias("skew"),
                sample_kurtosis(x, n).alias("kurtosis"),
            )
        )
    return df.agg(F.array(*row).alias("rows")).select(F.inline("rows"))


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, n_unique, mode)``; the smallest value wins among equally frequent ones."""
    counts = value_counts(df, cols, "string")
    return counts.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).getField("value").alias("mode"),
    )


def typed_counts(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``(col, number, whole, text, n)`` per distinct value of every column.

    ``number`` is a numeric column's value as a double. Values that are one double stay
    apart by ``whole`` (integers; zeros with a sign) or ``text`` (decimals). Other columns
    have ``text`` alone. Numbers are not spelled out, which costs more than counting them.
    """
    cells = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        number = whole = text = F.lit(None)
        if field.name in numeric:
            number = c
        if field.name not in numeric or isinstance(kind, DecimalType):
            text = c
        elif isinstance(kind, (FloatType, DoubleType)):
            whole = F.when((c == 0) & (c.cast("string") == "-0.0"), 1)
        else:
            whole = c
        cells.append(
            F.struct(
                F.lit(field.name).alias("col"),
                number.cast("double").alias("number"),
                whole.cast("bigint").alias("whole"),
                text.cast("string").alias("text"),
                is_missing(df, field.name).alias("missing"),
            )
        )
    long = df.select(F.inline(F.array(*cells))).where("NOT missing")
    return long.groupBy("col", "number", "whole", "text").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing cells, distinct values, and either the numeric
    summary or the mode. Values are counted and written once when called; distinct
    values, modes and quartiles are read off those counts."""
    numeric, _ = columns_by_type(df)
    types = F.create_map(
        *[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    )
    base = missing_summary(df).select(
        F.col("column").alias("col"),
        F.col("missing_count").alias("n_missing"),
        "missing_pct",
    )
    counts = materialize(typed_counts(df, numeric), "value_counts")
    modes = counts.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("text"))).getField("text").alias("mode"),
    )
    base = base.join(modes, "col", "left")
    if numeric:
        numbers = counts.where("number IS NOT NULL").select("col", F.col("number").alias("value"), "n")
        base = base.join(numeric_moments(df, numeric), "col", "left")
        base = base.join(_quartiles_wide(quantiles_of_counts(numbers, QUARTILES)), "col", "left")
    unique = F.coalesce(F.col("n_unique"), F.lit(0))
    return base.select(
        F.col("col").alias("column"),
        types[F.col("col")].alias("dtype"),
        "n_missing",
        "missing_pct",
        unique.alias("n_unique"),
        (unique <= 1).alias("is_constant"),
        *([*MOMENTS, "q25", "median", "q75"] if numeric else []),
        F.when(~F.col("col").isin(numeric), F.col("mode")).alias("mode"),
    )


def profile_flags(profiled: DataFrame, max_missing: float = 50.0, max_unique: int = 100) -> DataFrame:
    """``(column, flag)`` for mostly missing, high-cardinality and constant columns."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("missing_pct") > max_missing, "high_missing"),
            F.when(
                (F.col("dtype") == "string") & (F.col("n_unique") > max_unique),
                "high_cardinality",
            ),
            F.when(F.col("is_constant"), "constant"),
        )
    )
    return profiled.select("column", F.explode(flags).alias("flag"))


def payload_bytes(df: DataFrame) -> DataFrame:
    """``(column, bytes)``: string bytes plus fixed widths of present values."""
    sums = []
    for f in df.schema:
        width = WIDTHS.get(type(f.dataType))
        size = (
            F.octet_length(F.col(f.name).cast("string")).cast("bigint")
            if width is None
            else F.when(F.col(f.name).isNotNull(), F.lit(width).cast("bigint"))
        )
        total = F.coalesce(F.sum(size), F.lit(0).cast("bigint"))
        sums.append(F.struct(F.lit(f.name).alias("column"), total.alias("bytes")))
    return df.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def _spread(df: DataFrame, col: str) -> Column:
    """Scalar struct with count, extremes, deviation and moments of one column."""
    x = F.when(~is_missing(df, col), F.col(col).cast("double"))
    n = F.count(x).cast("double")
    return (
        df.agg(
            F.struct(
                n.alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                F.stddev_samp(x).alias("sd"), sample_skew(x, n).alias("skew"),
                sample_kurtosis(x, n).alias("kurt"),
            ).alias("s")
        )
        .select("s")
        .scalar()
    )


def histogram(df: DataFrame, col: str, bins: int | str = "auto") -> DataFrame:
    """``(bin, low, high, n, skew, kurtosis)`` with equal widths, empty bins included.

    ``auto`` takes the narrower of the Sturges and Freedman-Diaconis widths.
    """
    s = _spread(df, col)
    span = s["hi"] - s["lo"]
    if bins == "auto":
        quartiles = (
            quartile_table(df, [col]).select((F.col("q75") - F.col("q25")).alias("iqr")).scalar()
        )
        sturges = span / (F.log2(s["n"]) + 1)
        robust = 2 * quartiles / F.pow(s["n"], F.lit(1 / 3))
        width = F.when(robust > 0, F.least(robust, sturges)).otherwise(sturges)
        count = F.greatest(F.ceil(span / width), F.lit(1))
    else:
        count = F.lit(bins)
    count = F.coalesce(count, F.lit(1)).cast("bigint")
    x = F.col(col).cast("double")
    index = F.when(span > 0, F.least(F.floor((x - s["lo"]) * count / span), count - 1)).otherwise(0)
    found = (
        df.where(~is_missing(df, col))
        .select(index.cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # blocks of bins, so that no array grows with the number of bins
    whole = df.sparkSession.range(1).select(
        count.alias("k"), s["lo"].alias("lo"), (span / count).alias("w"),
        s["skew"].alias("skew"), s["kurt"].alias("kurtosis"),
    )
    blocks = whole.withColumn("b", F.explode(F.expr("sequence(0L, (k - 1) div 65536)")))
    grid = blocks.withColumn(
        "bin", F.explode(F.expr("sequence(b * 65536, least(k - 1, b * 65536 + 65535))"))
    ).drop("k", "b")
    return grid.join(found, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "skew",
        "kurtosis",
    )


def density(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density on ``grid`` points between the extremes, Scott's bandwidth.

    Every value counts. Equal values are summed first, and the terms of a grid point
    within each task, so ``grid`` rows per task are shuffled.
    """
    s = _spread(df, col)
    counts = value_counts(df, [col]).withColumn("s", s)
    bandwidth = F.col("s.sd") * F.pow(F.col("s.n"), F.lit(-0.2))
    points = counts.select(
        "n", "value", F.col("s.lo").alias("lo"), (F.col("s.hi") - F.col("s.lo")).alias("span"),
        bandwidth.alias("h"), F.col("s.n").alias("rows"),
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
    ).withColumn("x", F.col("lo") + F.col("span") * F.col("point") / (grid - 1))
    z = (F.col("x") - F.col("value")) / F.col("h")
    weight = F.col("n") * F.exp(-z * z / 2) / (F.col("rows") * F.col("h") * math.sqrt(2 * math.pi))
    return points.groupBy("point", "x").agg(F.sum(weight).alias("density"))


def fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles and the limits ``k`` interquartile ranges outside them."""
    iqr = F.col("q75") - F.col("q25")
    return quartile_table(df, cols).withColumns(
        {"lower": F.col("q25") - k * iqr, "upper": F.col("q75") + k * iqr}
    )


def fence_struct(df: DataFrame, cols: Sequence[str], k: float) -> Column:
    """All limits as one scalar struct: field ``<i>`` holds ``lower`` and ``upper``."""
    table = fences(df, cols, k)
    fields = [
        F.max(F.when(F.col("col") == c, F.struct("lower", "upper"))).alias(f"f{i}")
        for i, c in enumerate(cols)
    ]
    return table.agg(F.struct(*fields).alias("s")).scalar()


def box_summary(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and the number of points beyond them, per column."""
    limits = fence_struct(df, cols, k)
    rows = []
    for i, c in enumerate(cols):
        x = F.when(~is_missing(df, c), F.col(c).cast("double"))
        low, high = limits[f"f{i}"]["lower"], limits[f"f{i}"]["upper"]
        rows.append(
            F.struct(
                F.lit(c).alias("col"),
                F.min(F.when(x >= low, x)).alias("whisker_low"),
                F.max(F.when(x <= high, x)).alias("whisker_high"),
                F.count_if((x < low) | (x > high)).alias("n_outside"),
            )
        )
    whiskers = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return quartile_table(df, cols).join(whiskers, "col")
