"""Column checks and schema dispatch; all on the driver, before any work starts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def keep_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in cols if c in df.columns])


def harmonise(df: DataFrame, mapping: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping)).select(*columns)


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns and all others; booleans are not numeric."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def record_kind(schema: StructType, text_field: str = "text", has_formatter: bool = False) -> str:
    """What a tuning table holds, from its column names."""
    names = set(schema.fieldNames())
    if "labels" in names:
        return "labelled_ids"
    if "input_ids" in names:
        return "ids"
    if {"prompt", "completion"} <= names:
        return "prompt_completion"
    if text_field in names:
        return "text"
    if has_formatter:
        return "formatted"
    raise ValueError(f"no '{text_field}' column and no formatter")


def drop_null_elements(c, is_map: bool = False):
    """Nulls taken out of an array or, for a map, entries with a null value."""
    if is_map:
        return F.map_filter(c, lambda _, v: v.isNotNull())
    return F.filter(c, lambda x: x.isNotNull())
