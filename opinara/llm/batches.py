"""Arrow helpers shared by the operators: bounded slices and row maps; written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opinara.session import materialize  # noqa: F401

SLICE_BYTES = 1_000_000  # of text that numpy handles at a time


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``limit`` bytes; at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > limit:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += int(size)
    if low < batch.num_rows:
        yield batch.slice(low)
    pa.default_memory_pool().release_unused()


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text"
) -> DataFrame:
    """Apply ``fn`` to slices of bounded text size; rows never meet rows of other tasks."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)

    return df.mapInArrow(run, schema)
