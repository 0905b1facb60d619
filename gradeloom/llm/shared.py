"""Helpers of the corpus operators: inputs, stored intermediate tables, running totals, Arrow slices, memory of workers."""

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.sources.scratch import scratch_path

SLICE_BYTES = 1 << 20  # text that is expanded into numpy arrays at a time


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold this many rows at most from now on: documents are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``text``, null read as empty; other columns, whatever their names, are dropped."""
    return df.select(*keep, F.coalesce("text", F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and lost executors don't lose it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def running_start(df: DataFrame, by: str, order: list[str], value: Column, out: str, buckets: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows of a group are ordered by a hash bucket of the first order column, then by all of them. A group of any
    size is spread over ``buckets`` tasks' worth of windows; only its bucket sums meet in one window.
    ``by`` must not be null.
    """
    rows = df.withColumn("_value", value).withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)))
    sums = rows.groupBy(by, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(base.hint("merge"), [by, "_bucket"])
            .withColumn(out, (F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0))).cast("long"))
            .drop("_value", "_bucket", "_base"))


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """The C library's function that gives free memory back to the system; glibc has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that this process holds but doesn't use to the system; results don't depend on it."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves no unused memory behind: Python workers outlive their tasks, beside other stages' work."""
    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        give_back()

    return run


def parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches cut small, for work on Python strings."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def text_slices(batch: pa.RecordBatch | pa.Table, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut the text column of a batch into runs of rows of about ``limit`` bytes, at least one row each.

    Yields (first row, end row, bytes, offsets): row ``first + i`` is ``bytes[offsets[i]:offsets[i + 1]]``.
    """
    column = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
    for chunk, start in _chunks(column):
        yield from ((start + a, start + b, data, offsets) for a, b, data, offsets in _array_slices(chunk, limit))


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    start = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield chunk, start
        start += len(chunk)


def _array_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, end, data[ends[row]:ends[end]], ends[row:end + 1] - ends[row]
        row = end


def string_slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of some byte strings, as ``text_slices`` gives them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets
