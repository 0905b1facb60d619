"""Failure rows and their counts."""

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.conditions import condition_max_tokens, condition_model
from gradeloom.functions.failures import failure_category
from gradeloom.lookups import FAILURE_CATEGORIES, MAX_TOKENS_HINT
from gradeloom.sources.scratch import written


def failure_rows(log: DataFrame, max_tokens_hint: int = MAX_TOKENS_HINT) -> DataFrame:
    """Incorrect or unparsed rows with their category and model."""
    failed = log.where((F.col("is_correct") == 0) | (F.col("parse_failed") == 1))
    tokens = F.col("completion_tokens") if "completion_tokens" in log.columns else F.lit(None).cast("long")
    condition = F.col("condition") if "condition" in log.columns else F.lit(None).cast("string")
    category = failure_category(
        F.coalesce(F.col("generation"), F.lit("")), F.col("gold_answer"), F.col("dataset"), tokens,
        condition_max_tokens(condition, max_tokens_hint))
    return failed.withColumn("category", category).withColumn("model", condition_model(condition))


def failure_counts(failures: DataFrame, by_model: bool | None = None) -> DataFrame:
    """Failures per (dataset, strategy) and category, per model too if there are several.

    Left open, ``by_model`` is decided on the counts themselves (one row per model
    and cell, written for the purpose), so the failures are read once.
    """
    cell = ["dataset", "strategy"]
    counts = (failures.groupBy("model", *cell).pivot("category", FAILURE_CATEGORIES).count()
              .na.fill(0, FAILURE_CATEGORIES))
    if by_model is None:
        counts = written(counts, "failure-counts")
        by_model = counts.select("model").distinct().limit(2).count() > 1
    if by_model:
        return counts
    return counts.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in FAILURE_CATEGORIES])
