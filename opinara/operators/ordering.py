"""Positions and running totals in a total order, without a one-task window.

A plain ``row_number() over (order by key)`` sorts the whole table, or a whole class,
in one task. Here every row falls into a block by a digit that never decreases along
the order; the window runs inside a block, and the rows of the blocks before it are
added from a table of block totals. A class holding most of the table is still spread
over as many blocks as any other data of its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = (3, 6)  # hex digits of the hash: 4,096 blocks of 4,096 blocks each


def hash_key(seed: int | str, *cols: Column) -> Column:
    """Order of a seeded shuffle; the same on any partitioning and in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_digits(key: Column) -> list[Column]:
    return [F.substring(key, 1, n) for n in HASH_DIGITS]


def long_digits(c: Column) -> list[Column]:
    """Sixteen bits a level: any window over distinct integers, dense or sparse, holds at
    most 65,536 of them."""
    value = c.cast("bigint")
    return [F.shiftright(value, 48), F.shiftright(value, 32), F.shiftright(value, 16)]


def dense_digits(c: Column) -> list[Column]:
    """Blocks of 65,536 neighbours of a dense rank, whose blocks are few by construction."""
    return [F.shiftright(c.cast("bigint"), 16)]


def double_digits(c: Column) -> list[Column]:
    """Sign and power of two, then sixteen more bits of the fraction a level."""
    value = c.cast("double")
    size, sign = F.abs(value), F.signum(value).cast("bigint")
    plain = (size > 0) & (size < float("inf"))
    power = F.floor(F.log2(F.when(plain, size)))
    fraction = size / F.pow(F.lit(2.0), power) - 1
    top = F.when(plain, power + 1100).when(size > 0, 9999).otherwise(0)
    levels = [F.coalesce(F.floor(fraction * float(1 << n)), F.lit(0)) for n in (16, 32)]
    return [sign * x.cast("bigint") for x in (top, *levels)]


def _non_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\u0000"))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    digits: Sequence[Column],
    weights: Mapping[str, Column] | None = None,
    part: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    part_table: DataFrame | None = None,
) -> DataFrame:
    """Add the inclusive running sum of each weight, per ``part``, along ``order``.

    ``digits`` must never decrease along ``order``, compared from the first on.
    ``totals`` maps a weight to the name of a column with its sum over the part.
    ``part_table`` holds more columns per part, joined at the size of the block table
    so that a frequent part value does not skew the join with the rows.
    """
    weights = dict(weights or {"position": F.lit(1)})
    totals = dict(totals or {})
    parts = [f"__p{i}" for i in range(len(part))]
    levels = [f"__d{i}" for i in range(len(digits))]
    block = parts + levels
    keys = [_non_null(F.col(p)).alias(n) for p, n in zip(part, parts)]
    keys += [d.alias(n) for d, n in zip(digits, levels)]
    amounts = {f"__w{i}": w for i, w in enumerate(weights.values())}
    names = dict(zip(weights, amounts))
    keyed = df.select("*", *keys, *[w.alias(n) for n, w in amounts.items()])

    blocks = keyed.groupBy(*block).agg(*[F.sum(n).alias(n) for n in amounts])
    # Totals per prefix of the block key, shortest prefix last.
    tables = [blocks]
    for depth in range(len(levels) - 1, 0, -1):
        tables.append(
            tables[-1].groupBy(*parts, *levels[:depth]).agg(*[F.sum(n).alias(n) for n in amounts])
        )
    offsets: DataFrame | None = None
    for depth, table in enumerate(reversed(tables), start=1):
        before = (
            Window.partitionBy(*parts, *levels[: depth - 1])
            .orderBy(levels[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = table.select(
            *parts,
            *levels[:depth],
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}b") for n in amounts],
            *(
                [
                    F.sum(names[w]).over(Window.partitionBy(*parts)).alias(f"{names[w]}t")
                    for w in totals
                ]
                if depth == 1
                else []
            ),
        )
        if offsets is None:
            offsets = step
            continue
        upper = offsets.withColumnsRenamed({f"{n}b": f"{n}u" for n in amounts})
        joined = step.join(upper, [*parts, *levels[: depth - 1]])
        offsets = joined.withColumns(
            {f"{n}b": F.col(f"{n}b") + F.col(f"{n}u") for n in amounts}
        ).drop(*[f"{n}u" for n in amounts])
    if part_table is not None:
        extra = part_table.select(
            *[_non_null(F.col(p)).alias(n) for p, n in zip(part, parts)],
            *[c for c in part_table.columns if c not in part],
        )
        offsets = offsets.join(extra, parts, "left")

    inside = (
        Window.partitionBy(*block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = keyed.withColumns({f"{n}r": F.sum(n).over(inside) for n in amounts})
    full = ranked.join(offsets, block)
    results = {w: F.col(f"{n}r") + F.col(f"{n}b") for w, n in names.items()}
    results |= {out: F.col(f"{names[w]}t") for w, out in totals.items()}
    helpers = [*block, *amounts]
    for n in amounts:
        helpers += [f"{n}r", f"{n}b", f"{n}t"]
    return full.withColumns(results).drop(*helpers)


def id_positions(
    df: DataFrame, key: str, part: Sequence[str] = (), out: str = "position", **more
) -> DataFrame:
    """1-based position by an integer id, per part."""
    return running_total(
        df, [F.col(key)], long_digits(F.col(key)), {out: F.lit(1)}, part, **more
    )


def attach_columns(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The columns of ``right`` beside those of ``left``, row by row.

    The first row along the integer ``left_key`` gets the first along ``right_key``, and
    so on; the keys need not have equal values. ``right_key`` itself is not attached. Keys
    must be distinct and not null. Tables of unequal length, or with columns of equal
    names, are an error; empty tables give an empty one.
    """
    more = [c for c in right.columns if c != right_key]
    clash = sorted({c.lower() for c in more} & {c.lower() for c in left.columns})
    if clash:
        raise ValueError(f"both tables have columns {clash}")
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if n != distinct:
            raise ValueError(f"{key} has nulls or repeated values")
        sides.append(n)
    if sides[0] != sides[1]:
        raise ValueError(f"{sides[0]} rows cannot be set beside {sides[1]}")
    own = id_positions(left, left_key, out="__at")
    other = id_positions(right, right_key, out="__at").select("__at", *more)
    return own.join(other, "__at").select(*left.columns, *more)


def hash_positions(
    df: DataFrame,
    key: str,
    seed: int | str,
    part: Sequence[str] = (),
    out: str = "position",
    **more,
) -> DataFrame:
    """1-based position in the seeded shuffle, per part."""
    keyed = df.withColumn("__hash", hash_key(seed, F.col(key)))
    ranked = running_total(
        keyed,
        [F.col("__hash"), F.col(key)],
        hash_digits(F.col("__hash")),
        {out: F.lit(1)},
        part,
        **more,
    )
    return ranked.drop("__hash")


def first_by_hash(df: DataFrame, key: str, seed: int | str, n: int) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle.

    Only top-level blocks that start inside the first ``n`` rows are ranked; there are
    at most 4,096 of them, so their table is small whatever the data.
    """
    keyed = df.withColumn("__hash", hash_key(seed, F.col(key)))
    keyed = keyed.withColumn("__block", F.substring("__hash", 1, HASH_DIGITS[0]))
    counts = keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    ).where(F.col("__start") < n)
    near = keyed.join(F.broadcast(starts.select("__block")), "__block", "left_semi")
    ranked = running_total(
        near, [F.col("__hash"), F.col(key)], hash_digits(F.col("__hash")), {"__rank": F.lit(1)}
    )
    return ranked.where(F.col("__rank") <= n).drop("__hash", "__block", "__rank")


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    rows_col: str,
    values: Sequence[str],
    total: Column,
) -> DataFrame:
    """Join rows with a table of one row per key, when some keys may be very frequent.

    ``table`` counts its rows of ``left`` in ``rows_col``. A key with over one in a
    thousand of all rows is hot; there are fewer than a thousand such keys, so they are
    broadcast. The other rows meet their key by a shuffle join, and the rows already
    served are spread by a hash instead of meeting in one partition.
    """
    hot = table.where(F.col(rows_col) * 1000 > total).select(
        F.col(key), *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot")
    )
    served = left.join(F.broadcast(hot), key, "left")
    served = served.withColumns(
        {
            "__key": F.when(F.col("__hot").isNull(), F.col(key)),
            "__salt": F.when(
                F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(4096))
            ).otherwise(0),
        }
    )
    cold = table.where(F.col(rows_col) * 1000 <= total).select(
        F.col(key).alias("__key"),
        F.lit(0).cast("bigint").alias("__salt"),
        *[F.col(v).alias(f"__cold_{v}") for v in values],
    )
    merged = served.join(cold, ["__key", "__salt"], "left")
    return merged.select(
        *[F.col(c) for c in left.columns],
        *[F.coalesce(F.col(f"__hot_{v}"), F.col(f"__cold_{v}")).alias(v) for v in values],
    )
