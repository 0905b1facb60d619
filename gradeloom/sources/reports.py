"""Result files: summaries and failure reports."""

from pyspark.sql import DataFrame

from gradeloom.operators.failures import failure_counts
from gradeloom.operators.summary import CELL
from gradeloom.sources.runlog import export_csv
from gradeloom.sources.scratch import written

_PLAIN = {"header": True, "quote": '"', "escape": '"'}


def write_summary(summary: DataFrame, folder: str) -> None:
    """The summary as one CSV and one JSON-lines file, replacing earlier ones.

    A shuffle to one partition, not coalesce, so that the aggregation itself stays
    parallel; a summary has one row per cell.
    """
    keys = [c for c in ("model", *CELL, "source_file") if c in summary.columns]
    small = written(summary, "summary").repartition(1).sortWithinPartitions(*keys)
    small.write.mode("overwrite").options(**_PLAIN).csv(f"{folder}/summary.csv")
    small.write.mode("overwrite").json(f"{folder}/summary.json")


def write_failures(failures: DataFrame, folder: str, by_model: bool | None = None) -> DataFrame:
    """Failure rows, and their counts per group, as CSV; returns the counts.

    The classified rows are written once to the shared folder; both reports come from there.
    """
    kept = written(failures, "failures")
    export_csv(kept, f"{folder}/errors.csv", mode="overwrite")
    counts = failure_counts(kept, by_model)
    keys = [c for c in ("model", "dataset", "strategy") if c in counts.columns]
    target = f"{folder}/errors_summary.csv"
    counts.repartition(1).sortWithinPartitions(*keys).write.mode("overwrite").options(**_PLAIN).csv(target)
    return counts.sparkSession.read.schema(counts.schema).options(**_PLAIN).csv(target)
