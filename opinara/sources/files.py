"""Readers and writers for review tables and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from opinara.functions.lexicons import NA_TOKENS

CSV_FORMAT = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Missing-value words of string columns as nulls."""
    words = list(tokens)
    return df.withColumns(
        {
            f.name: F.when(~F.col(f.name).isin(words), F.col(f.name))
            for f in df.schema
            if isinstance(f.dataType, StringType)
        }
    )


def read_reviews_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """Headered CSV with quoted fields, which may hold line breaks.

    A file with line breaks inside fields cannot be split, so large inputs should come
    as many files; ``multi_line=False`` splits files that have none.
    """
    reader = spark.read.schema(schema).options(**CSV_FORMAT).option("multiLine", multi_line)
    return null_tokens(reader.option("enforceSchema", False).csv(path), na_tokens)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


SPREAD = "opinara.spread"  # session setting: parts that small input files are dealt to


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows to as many parts as the session asks for; without the setting, no change.

    For tables of a single small file, whose scan has one task. Sizes are not looked at.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df if parts is None else df.repartition(int(parts), key)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Parquet, JSON or CSV; a partition column lets readers skip what they do not need."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(
            **CSV_FORMAT, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
