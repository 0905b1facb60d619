"""Run logs: CSV logs of any layout, and the Parquet log of this library."""

import csv
import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gradeloom.functions.text import flatten_newlines
from gradeloom.schemas import LOG_TYPES, RUN_LOG
from gradeloom.sources.files import Folder, plain
from gradeloom.sources.logtable import LogTable
from gradeloom.sources.quarantine import past_failures, readable

# Quotes are doubled, fields may span lines, blanks belong to the text.
_CSV = {
    "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _listed(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The files that paths, folders and globs name."""
    found = []
    for path in paths:
        try:
            found += map(plain, spark.read.text(path).inputFiles())
        except AnalysisException as error:
            warnings.warn(f"Skipped {path}: {error.getCondition()}")
    return list(dict.fromkeys(found))


def _layouts(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names -> files whose first header has them. Files that are not UTF-8 text have none.

    Headers come from a scan of lines, which can be split. The driver gets one
    line per file, as it lists the files anyway.
    """
    value = F.col("value")
    named = reduce(Column.__and__, [F.contains(value, F.lit(name)) for name in ("dataset", "strategy", "sample_idx")])
    lines = spark.read.text(files).where(named | ~F.is_valid_utf8(value)).select(
        F.regexp_replace(F.when(F.is_valid_utf8(value), value), "[\ufeff\r]", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("place"))
    heads = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.bool_and(F.col("value").isNotNull()).alias("text"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in heads.where("text").orderBy("file").collect():
        names = tuple(next(csv.reader([row["header"]])))
        if {"dataset", "strategy", "sample_idx"} <= set(names):
            found.setdefault(names, []).append(plain(row["file"]))
    return found


def _read_layout(spark: SparkSession, files: list[str], layout: Iterable[str]) -> DataFrame:
    """Files that are all alike: the known columns as text (NULL where missing) and ``source_file``."""
    names: list[str] = []
    for i, name in enumerate(layout):
        names.append(name if name in LOG_TYPES and name not in names else f"_c{i}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(**_CSV, header=True).csv(files)
    repeated = (F.col("dataset") == "dataset") & (F.col("strategy") == "strategy")
    kept = rows.where(~F.coalesce(repeated, F.lit(False)))
    return kept.select(*[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in LOG_TYPES],
                       F.col("_metadata.file_name").alias("source_file"))


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.DoubleType):
        return value.try_cast("double")
    # Whole numbers may have been written as 1.0 by tools that only know floats.
    return F.coalesce(value.try_cast("long"), value.try_cast("double").try_cast("long")).cast(kind)


def read_run_logs(spark: SparkSession, paths: Iterable[str], layout: list[str] | None = None,
                  required: Iterable[str] = ()) -> DataFrame:
    """CSV run logs as one frame, tagged with ``source_file``.

    Logs of any layout and width may be mixed: the header of each file is looked
    up first, and files with the same columns are then read together, each once. Give
    the ``layout`` of logs that are all alike to save that scan. Columns a file lacks
    are NULL. An empty ``generation`` or ``predicted_answer`` is the empty string; empty
    metrics stay NULL. Skipped with a warning that names them: paths that match nothing, compressed
    files that do not unpack to their end, files that Spark fails to read, that are not UTF-8
    text, or that have no header or not the ``required`` columns. A file is read whole or not at all.
    """
    files = readable(spark, _listed(spark, paths))
    if layout is not None:
        groups = {tuple(layout): files} if files else {}
    else:
        files, groups = past_failures(files, lambda left: _layouts(spark, left))
        groups = {names: group for names, group in (groups or {}).items() if set(required) <= set(names)}
        skipped = sorted(set(files) - {f for group in groups.values() for f in group})
        if skipped:
            warnings.warn(f"Skipped {len(skipped)} of {len(files)} files without a run-log header with the required columns: {', '.join(skipped)}")
    if not groups:
        names = T.StructType([T.StructField(n, t) for n, t in LOG_TYPES.items()])
        return spark.createDataFrame([], names.add("source_file", "string"))
    rows = reduce(DataFrame.unionByName, [_read_layout(spark, files, names) for names, files in groups.items()])
    log = rows.select(*[_typed(F.col(n), t).alias(n) for n, t in LOG_TYPES.items()], "source_file")
    return log.withColumns({c: F.coalesce(c, F.lit("")) for c in ("generation", "predicted_answer")})


def export_csv(log: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Write a log as CSV with header; newlines of the generation become blanks."""
    flat = log.withColumn("generation", flatten_newlines(F.col("generation")))
    flat.write.mode(mode).options(**_CSV, header=True, emptyValue="", compression=compression).csv(path)


def log_table(spark: SparkSession, path: str) -> LogTable:
    more = [T.StructField("answer_raw", T.StringType()), T.StructField("bertscore_f1", T.DoubleType()),
            T.StructField("source_file", T.StringType())]
    return LogTable(spark, path, T.StructType([*RUN_LOG.fields, *more]))


def append_log(scored: DataFrame, path: str, job: str | None = None) -> bool:
    """Append scored rows to a log, all of them at once; a ``job`` id that is committed already adds nothing and gives False."""
    table = log_table(scored.sparkSession, path)
    if not table.exists() and any(name.startswith("dataset=") for name in Folder(scored.sparkSession, path).names()):
        raise ValueError(f"{path} is a plain Parquet folder without commits; rescore it into a new log instead.")
    return table.append(scored, job)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a log, or a plain Parquet folder written by ``write_back`` or the streaming sink; NULL where it lacks a column."""
    table = log_table(spark, path)
    return table.read() if table.exists() else spark.read.schema(table.schema).parquet(path)


def rewrite_log(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the rows of a log in place; readers that have begun keep the old version. Gives the number of the new one."""
    return log_table(spark, path).rewrite(change)


def write_back(log: DataFrame, path: str) -> None:
    """Write a rescored log to a new path, as plain Parquet: Spark must not overwrite what it reads."""
    log.write.mode("errorifexists").partitionBy("dataset", "strategy").parquet(path)
