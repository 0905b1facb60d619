"""Splitting a large table by a set of ids without shuffling what is surely outside."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import tidy
from .words import mix

BITS = 23  # of the bitmap: 1 MB whatever the number of ids


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Which of 2**23 hash cells hold an id: a bitmap of fixed size, gathered in 1024 slices."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(cell >> 13), pa.array(cell & 8191)], ["slice", "cell"])

    found = (ids.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(cells, "slice long, cell long")
             .groupBy("slice").agg(F.collect_set(F.col("cell").cast("short")).alias("cells")).collect())
    marks = np.zeros(1 << BITS, bool)
    for row in found:
        marks[(row[0] << 13) + np.array(row[1], np.int64)] = True
    return np.packbits(marks, bitorder="little")


def _cells(ids: pa.Array) -> np.ndarray:
    values = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64)
    return (mix(values + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)


def maybe_in(df: DataFrame, column: str, bitmap: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose id may be in the bitmap's set (no member is missing), or those that surely are not."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)
    at = df.columns.index(column)

    @tidy
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(batch.column(at))
            hit = (held.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(hit == inside))

    return df.mapInArrow(test, df.schema)


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Anti join of a table of long rows with a set of ids (column ``id``): only rows whose id meets the bitmap are shuffled.

    Rows with a null id stay, repeated rows stay or go together; an empty set drops nothing.
    """
    bitmap = id_bitmap(ids, "id")
    near = maybe_in(df, column, bitmap)
    kept = near.join(ids, near[column] == ids["id"], "left_anti")
    return maybe_in(df, column, bitmap, inside=False).union(kept)
