"""Seeded samples, shuffles, splits and draws; all depend on ids and seed alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.filters import is_class
from opinara.operators.ordering import (
    first_by_hash,
    hash_key,
    hash_positions,
    id_positions,
    running_total,
)
from opinara.session import cut_lineage


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``min(n, rows)`` rows."""
    return first_by_hash(df, key, seed, n)


def downsample_class(
    df: DataFrame, col: str, value: str, frac: float, seed: int, key: str
) -> DataFrame:
    """Keep all other classes and an exact share of one class."""
    marked = df.withColumn("__class", is_class(col, value))
    chosen = hash_positions(
        marked.where("__class"), key, seed, out="__rank", totals={"__rank": "__rows"}
    ).where(F.col("__rank") <= F.round(F.lit(frac) * F.col("__rows")))
    return marked.where("NOT __class").select(*df.columns).unionByName(chosen.select(*df.columns))


def shuffle_rows(
    df: DataFrame, seed: int, key: str, out: str = "shuffle_pos", sort: bool = False
) -> DataFrame:
    """Dense 1-based position in the seeded shuffle; ``sort`` also orders the output."""
    shuffled = hash_positions(df, key, seed, out=out)
    return shuffled.orderBy(out) if sort else shuffled


def _allocate(classes: DataFrame, label: str, size: str, share: float, out: str) -> DataFrame:
    """Largest-remainder quotas: their sum is the rounded-up share of all rows."""
    sizes = classes.agg(F.sum(size).alias("n")).select(
        F.struct(F.col("n"), F.ceil(F.lit(share) * F.col("n")).alias("want")).alias("s")
    )
    total = sizes.scalar()
    exact = F.col(size) * total["want"] / total["n"]
    based = classes.withColumns(
        {
            "__base": F.floor(exact),
            "__frac": F.round(exact - F.floor(exact), 9),
        }
    )
    # Larger fractions first; the block digit cannot decrease along that order.
    ranked = running_total(
        based,
        [F.col("__frac").desc(), F.col(label)],
        [F.floor((1 - F.col("__frac")) * 4096)],
        {"__rank": F.lit(1)},
    )
    missing = based.agg(F.sum("__base").alias("b")).scalar()
    extra = F.when(F.col("__rank") <= total["want"] - missing, 1).otherwise(0)
    return ranked.withColumn(out, F.col("__base") + extra).drop("__base", "__frac", "__rank")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test: float = 0.2,
    val: float = 0.2,
    seed: int = 42,
    exact_total: bool = True,
) -> DataFrame:
    """Add ``split`` = test, val or train, with the label shares of the whole in each.

    ``val`` is a share of what the test split leaves. With ``exact_total`` the split
    sizes are exact over all classes; otherwise every class is rounded on its own.
    """
    quotas = None
    if exact_total:
        # One row per class, written once: the quotas read it several times over.
        classes = cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
        quotas = _allocate(classes, label, "__n", test, "__test")
        quotas = cut_lineage(quotas.withColumn("__left", F.col("__n") - F.col("__test")))
        quotas = _allocate(quotas, label, "__left", val, "__val")
        quotas = quotas.select(label, "__test", "__val")
    ranked = hash_positions(
        df, key, seed, [label], "__rank", totals={"__rank": "__rows"}, part_table=quotas
    )
    if not exact_total:
        ranked = ranked.withColumn("__test", F.round(F.col("__rows") * test))
        ranked = ranked.withColumn("__val", F.round((F.col("__rows") - F.col("__test")) * val))
    split = (
        F.when(F.col("__rank") <= F.col("__test"), "test")
        .when(F.col("__rank") <= F.col("__test") + F.col("__val"), "val")
        .otherwise("train")
    )
    return ranked.select(*df.columns, split.alias("split"))


def _hash_int(seed: int | str, *cols):
    """Non-negative 60-bit integer from a seeded digest, the same in any SQL engine."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 15), 16, 10).cast("bigint")


def draw_with_replacement(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """``min(rows, k)`` independent draws, numbered by ``draw``."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = (
        df.sparkSession.range(1, k + 1)
        .withColumnRenamed("id", "draw")
        .where(F.col("draw") <= rows)
        .withColumn("__pos", _hash_int(seed, F.col("draw")) % rows + 1)
    )
    placed = id_positions(df, key, out="__pos")
    return draws.join(placed, "__pos").drop("__pos")


def top_values(
    df: DataFrame, col: str, k: int | None = None, include_null: bool = False
) -> DataFrame:
    """Most frequent values; equal counts by value."""
    rows = df if include_null else df.where(F.col(col).isNotNull())
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(k)


def batch_rows(df: DataFrame, size: int, key: str) -> DataFrame:
    """Batch number and 0-based slot inside the batch, in id order, and the batch size."""
    placed = id_positions(df, key, out="__pos", totals={"__pos": "__rows"})
    index = F.col("__pos") - 1
    batch = F.floor(index / size)
    return placed.withColumns(
        {
            "batch_id": batch,
            "slot": index % size,
            "batch_size": F.least(F.lit(size), F.col("__rows") - batch * size),
        }
    ).drop("__pos", "__rows")


def mismatched_pairs(
    df: DataFrame, size: int, key: str, cols: list[str], prefix: str = "KL_"
) -> DataFrame:
    """Attach the columns of the mirrored row of the same batch.

    The middle row of an odd batch meets itself; ``self_paired`` marks it.
    """
    if size <= 1:
        raise ValueError("batch size must be greater than 1")
    placed = batch_rows(df, size, key)
    names = [c for c in placed.columns if c not in ("batch_id", "slot")]
    # a batch has at most ``size`` rows: gathered once, it meets its own reverse
    batches = placed.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", *names))).alias("rows")
    )

    def met(row, other):
        own = [row[c].alias(c) for c in ("slot", *names)]
        return F.struct(*own, *[other[c].alias(f"{prefix}{c}") for c in cols])

    met_rows = F.zip_with("rows", F.reverse("rows"), met)
    joined = batches.select("batch_id", F.inline(met_rows))
    return joined.withColumn(
        "self_paired", F.col("slot") * 2 + 1 == F.col("batch_size")
    ).drop("batch_size")


def expansion_plan(
    df: DataFrame,
    label: str,
    text: str,
    key: str,
    target: int,
    languages: list[str],
    seed: int,
    default_exemplar: str = "Standard review",
) -> DataFrame:
    """``target // labels`` new rows per label, each with an exemplar and a language.

    The plan has at most ``target`` rows; exemplars are found by an equi-join on the
    label and a drawn position, so a frequent label costs no more than a rare one.
    """
    sizes = df.groupBy(label).agg(F.count(text).alias("__n"))
    labels = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    names = F.array(*[F.lit(x) for x in languages])
    plan = (
        sizes.withColumn("__k", F.floor(F.lit(target) / labels))
        .where(F.col("__k") >= 1)
        # blocks of rows, so that no array grows with the target
        .withColumn("__b", F.explode(F.expr("sequence(0L, (__k - 1) div 1000)")))
        .withColumn("row", F.explode(F.expr("sequence(__b * 1000 + 1, least(__k, __b * 1000 + 1000))")))
        .withColumns(
            {
                "__pos": _hash_int(f"{seed}e", F.col(label), F.col("row"))
                % F.greatest(F.col("__n"), F.lit(1))
                + 1,
                "language": F.get(
                    names,
                    (_hash_int(f"{seed}l", F.col(label), F.col("row")) % len(languages)).cast("int"),
                ),
            }
        )
    )
    placed = id_positions(df.where(F.col(text).isNotNull()), key, [label], "__pos").select(
        F.col(label).alias("__label"), "__pos", F.col(text).alias("exemplar")
    )
    # A null label has no exemplars of its own: plain equality leaves it the default.
    match = (F.col(label) == F.col("__label")) & (plan["__pos"] == placed["__pos"])
    return plan.join(placed, match, "left").select(
        label,
        "row",
        "language",
        F.coalesce("exemplar", F.lit(default_exemplar)).alias("exemplar"),
    )
