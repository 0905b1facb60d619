"""Later passes over stored logs: missing metrics, failure analysis."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.lookups import MAX_TOKENS_HINT
from gradeloom.operators.failures import failure_rows
from gradeloom.operators.scoring import backfill
from gradeloom.operators.summary import metric_rates
from gradeloom.sources.reports import write_failures
from gradeloom.sources.runlog import read_log, read_run_logs, rewrite_log, write_back


def backfill_logs(spark: SparkSession, paths: Iterable[str], target: str, overwrite: bool = False) -> DataFrame:
    """Score the unscored rows of CSV logs into a new Parquet log; returns its rates per file."""
    write_back(backfill(read_run_logs(spark, paths), overwrite), target)
    return metric_rates(spark.read.parquet(target))


def rescore_log(spark: SparkSession, path: str, overwrite: bool = False) -> DataFrame:
    """Score the unscored rows of a log in place, as a new version of it; returns its rates per file."""
    rewrite_log(spark, path, lambda log: backfill(log, overwrite))
    return metric_rates(read_log(spark, path))


def analyse_failures(spark: SparkSession, paths: Iterable[str], folder: str,
                     max_tokens_hint: int = MAX_TOKENS_HINT) -> DataFrame:
    """Classify the failures of CSV logs, write both reports, return the counts."""
    return write_failures(failure_rows(read_run_logs(spark, paths), max_tokens_hint), folder)
