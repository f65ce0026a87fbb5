"""Row filters and row accounting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.lexicons import ABUSIVE_WORDS
from opinara.functions.text import WORD_PATTERN, contains_any, word_count


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Plain null tests: unlike ``na.drop`` they vanish for columns that are never null,
    such as a label with a fallback, instead of computing the label once more."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` (unique) among equal ``key`` values.

    The minimum is taken per digest with map-side combining, so a value repeated
    without bound sends one narrow row per task; full rows move once, by ``order``.
    """
    firsts = (
        df.select(F.sha2(F.col(key), 256).alias("__digest"), order)
        .groupBy("__digest")
        .agg(F.min(order).alias(order))
        .select(order)
    )
    return df.join(firsts, order, "left_semi")


def min_length(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Keep texts longer than ``n`` characters."""
    return df.where(F.length(col) > n)


def keep_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isin(list(labels)))


def drop_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    """Drop listed labels; a null label stays."""
    return df.where(~F.coalesce(F.col(col).isin(list(labels)), F.lit(False)))


def is_class(col: str, value: str) -> Column:
    """Null counts as another class."""
    return F.col(col).eqNullSafe(F.lit(value))


def partition_by_label(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(col)), df.where(~F.col(col))


def drop_short_abusive(
    df: DataFrame,
    col: str,
    words: Sequence[str] = ABUSIVE_WORDS,
    max_words: int = 3,
    whole_word: bool = False,
) -> DataFrame:
    """Drop texts of up to ``max_words`` words that hold a listed word.

    By default a word also counts inside a longer one.
    """
    low = F.lower(F.col(col))
    if whole_word:
        tokens = F.regexp_extract_all(low, F.lit(WORD_PATTERN), F.lit(0))
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in dict.fromkeys(words)]))
    else:
        hit = contains_any(low, words)
    return df.where(~((word_count(low) <= max_words) & hit))


def max_tokens(
    df: DataFrame,
    cols: Sequence[str],
    limit: int,
    counter: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Keep rows whose columns all have at most ``limit`` tokens."""
    for col in cols:
        df = df.where(counter(F.col(col)) <= limit)
    return df


def row_accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, and the share kept in percent."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marks = before.select(one.alias("i"), zero.alias("k")).unionAll(
        after.select(zero.alias("i"), one.alias("k"))
    )
    counts = marks.agg(
        F.coalesce(F.sum("i"), zero).alias("initial"), F.coalesce(F.sum("k"), zero).alias("kept")
    )
    return counts.select(
        "initial",
        "kept",
        (F.col("initial") - F.col("kept")).alias("removed"),
        F.when(F.col("initial") > 0, 100 * F.col("kept") / F.col("initial")).alias("recovery_pct"),
    )
