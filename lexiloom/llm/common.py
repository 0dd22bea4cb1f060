"""What the operators of this folder share: Arrow batches cut by bytes; tables and durable results are the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexiloom.sources.tables import durable, numbered, parts, shared_path, skew_join, spread, table

__all__ = ["by_bytes", "column_bytes", "durable", "map_arrow", "numbered", "parts", "skew_join", "spread", "table", "work_path"]

#: Bytes of text that a mapped function gets at once; a longer text comes alone. Batches themselves are bounded by Spark (64 MB).
TOGETHER = 1 << 20


def work_path(spark: SparkSession, tag: str) -> str:
    return shared_path(spark, tag)


def ends_of(col: pa.Array) -> np.ndarray:
    """Where the rows of a string or binary column begin, and the last one's end, in its bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes are at most so many in each, or those of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = ends_of(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, int(at[lo]) + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, text: int, most: int = TOGETHER) -> DataFrame:
    """df.mapInArrow with batches cut by the bytes of the column at place text."""
    return df.mapInArrow(lambda batches: fn(by_bytes(batches, text, most)), schema)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and each row's bounds in it; null: empty."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
