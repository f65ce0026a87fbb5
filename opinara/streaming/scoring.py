"""Continuous scoring of arriving reviews and lazy tuning-set preparation.

All steps are per row, so there is no state, no watermark and no shuffle; exactly-once
output comes from the file sink with its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from opinara.functions.text import strip_ws
from opinara.operators.labeling import Labeler, SourceSpec, label_reviews
from opinara.operators.tuning import prepare_tuning_set


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def score_stream(
    df: DataFrame, spec: SourceSpec, labeler: Labeler | None = None, key: str = "id"
) -> DataFrame:
    """Blank reviews are skipped, the others labelled as in batch."""
    filled = df.where(strip_ws(F.coalesce(F.col(spec.text), F.lit(""))) != "")
    return label_reviews(filled, spec, labeler, key=key)


def prepare_stream(df: DataFrame, **options) -> DataFrame:
    return prepare_tuning_set(df, **options)


def start_writing(
    df: DataFrame, out_dir: str, checkpoint: str, once: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Append to Parquet; ``once`` drains what is there and stops."""
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()
