"""Aggregates over scored rows.

Every mean is built from integer sums (metrics have four decimals, latencies
two), so the result does not depend on the order in which partitions arrive, and
partial results of several batches can be added up exactly.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.conditions import condition_model, condition_without_model
from gradeloom.functions.prompts import checked_dataset
from gradeloom.functions.text import py_round
from gradeloom.lookups import DATASETS
from gradeloom.operators.scoring import exact_match_rows

CELL = ["dataset", "strategy", "condition"]
MODEL_CELL = ["model", "dataset", "strategy", "condition", "source_file"]

# column -> decimals kept in the log
_SUMMED = {
    "is_correct": 0,
    "parse_failed": 0,
    "substring_match": 0,
    "is_numeric_close": 0,
    "token_f1": 4,
    "rouge_l": 4,
    "prompt_tokens": 0,
    "completion_tokens": 0,
    "total_tokens": 0,
    "latency_s": 2,
}


def _units(column: str, decimals: int) -> Column:
    value = F.col(column)
    return value.cast("long") if decimals == 0 else F.round(value * 10 ** decimals).cast("long")


def summary_partials(scored: DataFrame, by: Iterable[str] = CELL) -> DataFrame:
    """Sums and counts per cell that can be merged with those of other batches."""
    aggregates = [F.count("*").alias("rows"), F.max("latency_s").alias("max_latency_s")]
    for name, decimals in _SUMMED.items():
        present = name in scored.columns
        aggregates.append((F.sum(_units(name, decimals)) if present else F.lit(None).cast("long")).alias(f"sum_{name}"))
        aggregates.append((F.count(name) if present else F.lit(0).cast("long")).alias(f"count_{name}"))
    return scored.groupBy(*by).agg(*aggregates)


def merge_partials(partials: DataFrame, by: Iterable[str] = CELL) -> DataFrame:
    summed = ["rows"] + [f"{kind}_{name}" for name in _SUMMED for kind in ("sum", "count")]
    return partials.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in summed], F.max("max_latency_s").alias("max_latency_s"))


def _mean(name: str) -> Column:
    """Mean over the rows that have the metric; 0.0 if none has."""
    total, count = F.col(f"sum_{name}"), F.col(f"count_{name}")
    return F.when(count > 0, total / (count * 10 ** _SUMMED[name])).otherwise(0.0)


def finish_summary(partials: DataFrame, by: Iterable[str] = CELL, extra: Iterable[str] = ()) -> DataFrame:
    """Rates and means of merged sums."""
    share = lambda name: F.when(
        F.col("rows") > 0, F.col(f"sum_{name}") / F.col("rows") * 100.0).otherwise(0.0)
    return partials.select(
        *by,
        F.col("rows").alias("n"),
        share("is_correct").alias("em"),
        share("parse_failed").alias("parse_failure_rate"),
        py_round(_mean("substring_match") * 100.0, 1).alias("substring_match_rate"),
        py_round(_mean("is_numeric_close") * 100.0, 1).alias("numeric_close_rate"),
        py_round(_mean("token_f1"), 4).alias("avg_token_f1"),
        py_round(_mean("rouge_l"), 4).alias("avg_rouge_l"),
        py_round(_mean("prompt_tokens"), 1).alias("avg_prompt_tokens"),
        py_round(_mean("completion_tokens"), 1).alias("avg_completion_tokens"),
        py_round(_mean("total_tokens"), 1).alias("avg_total_tokens"),
        F.coalesce(F.col("sum_total_tokens"), F.lit(0)).alias("total_tokens_used"),
        py_round(_mean("latency_s"), 2).alias("avg_latency_s"),
        *extra,
    )


def condition_summary(scored: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per (dataset, strategy, condition).

    ``requested`` holds the cells asked for with their ``n_requested``; a cell
    without any row then appears with zeros, and a cell that was only logged has
    a NULL ``n_requested``.
    """
    summary = finish_summary(summary_partials(scored))
    if requested is None:
        return summary
    joined = requested.select(*CELL, "n_requested").join(summary, CELL, "full_outer")
    zeros = {f.name: 0 for f in summary.schema if f.name not in CELL}
    return joined.na.fill(zeros)


def requested_cells(grid: DataFrame) -> DataFrame:
    """How many samples each cell of a grid asks for."""
    return grid.groupBy(*CELL).agg(F.count("*").alias("n_requested"))


def model_summary(scored: DataFrame) -> DataFrame:
    """Summary per model and source file, with the model taken out of the condition."""
    rows = (scored.withColumn("model", condition_model(F.col("condition")))
            .withColumn("condition", condition_without_model(F.col("condition"))))
    return finish_summary(summary_partials(rows, MODEL_CELL), MODEL_CELL, ["max_latency_s"])


def em_pivot(summary: DataFrame, datasets: Iterable[str] = DATASETS) -> DataFrame:
    """Mean exact match with six decimals: strategies down, datasets across."""
    return summary.groupBy("strategy").pivot("dataset", list(datasets)).agg(py_round(F.avg("em"), 6))


def dataset_em(rows: DataFrame) -> DataFrame:
    """Exact match of generations per dataset in percent, 0.0 without rows; names in any case, unknown ones fail."""
    named = exact_match_rows(rows.withColumn("dataset", checked_dataset(F.col("dataset"))))
    name = F.col("dataset")
    counted = named.select("dataset", "is_correct").agg(*[
        F.struct(F.lit(d).alias("dataset"), F.count_if(name == d).alias("n"),
                 F.coalesce(F.avg(F.when(name == d, F.col("is_correct"))) * 100.0, F.lit(0.0)).alias("em"),
                 ).alias(d) for d in DATASETS])
    return counted.select(F.inline(F.array(*DATASETS)))


def metric_rates(log: DataFrame) -> DataFrame:
    """Mean of the four metrics per log file, rates in percent."""
    return summary_partials(log, ["source_file"]).select(
        "source_file",
        F.col("rows").alias("n"),
        py_round(_mean("substring_match") * 100.0, 1).alias("substring_match_rate"),
        py_round(_mean("is_numeric_close") * 100.0, 1).alias("numeric_close_rate"),
        py_round(_mean("token_f1"), 3).alias("avg_token_f1"),
        py_round(_mean("rouge_l"), 3).alias("avg_rouge_l"),
    )


def embedding_rates(log: DataFrame) -> DataFrame:
    """Mean embedding F1 of the newly scored rows of each log file."""
    units = F.round(F.col("bertscore_f1") * 10000).cast("long")
    return (log.where("newly_scored").groupBy("source_file")
            .agg(F.count("bertscore_f1").alias("n"), F.sum(units).alias("_sum"))
            .select("source_file", "n",
                    py_round(F.when(F.col("n") > 0, F.col("_sum") / (F.col("n") * 10000)), 4).alias("avg_bertscore_f1")))
