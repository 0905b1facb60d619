"""Resume: skip what a log already holds."""

from pyspark.sql import DataFrame, functions as F

from gradeloom.lookups import LEGACY_CONDITION
from gradeloom.schemas import KEY


def done_keys(log: DataFrame) -> DataFrame:
    """Distinct keys of a log; rows without a condition count as legacy."""
    condition = F.col("condition") if "condition" in log.columns else F.lit(None).cast("string")
    return log.select(
        "dataset", "strategy", F.col("sample_idx").cast("long").alias("sample_idx"),
        F.coalesce(condition, F.lit(LEGACY_CONDITION)).alias("condition")).distinct()


def pending(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Grid rows whose key is not in the log.

    Only keys of the log are read, and they are made distinct before the join, so
    a key that was logged very often weighs no more than any other.
    """
    return grid.join(done_keys(log), KEY, "left_anti")
