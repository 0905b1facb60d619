"""Experiment grids: samples times strategies times conditions.

A grid is spelled out inside each task by exploding literal arrays, so it needs
neither a join nor a shuffle, whatever the number of samples.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.conditions import condition_label
from gradeloom.functions.prompts import build_prompt, checked_strategy
from gradeloom.lookups import BASE_CONDITION, DEFAULT_SWEEP, STRATEGIES, SWEEP_VALUES

KNOB_TYPES = {
    "model": "string",
    "k_shot": "int",
    "cot_trigger": "string",
    "persona_variant": "string",
    "structured": "boolean",
    "max_tokens": "int",
    "temperature": "double",
    "self_consistency": "int",
}

def _knob(name: str, value) -> Column:
    return F.lit(value).cast(KNOB_TYPES[name])


def with_condition(df: DataFrame) -> DataFrame:
    """Add the condition label of the eight knob columns."""
    return df.withColumn("condition", condition_label(**{name: F.col(name) for name in KNOB_TYPES}))


def sweep(df: DataFrame, dims: Iterable[str] = DEFAULT_SWEEP, base: dict | None = None) -> DataFrame:
    """Every row once per combination of the active dimensions over a base condition."""
    fixed = {**BASE_CONDITION, **(base or {})}
    active = list(dims)
    for name in KNOB_TYPES:
        if name not in active:
            df = df.withColumn(name, _knob(name, fixed[name]))
    for name in active:
        df = df.withColumn(name, F.explode(F.array(*[_knob(name, v) for v in SWEEP_VALUES[name]])))
    return with_condition(df)


def with_conditions(df: DataFrame, conditions: Iterable[dict] | DataFrame) -> DataFrame:
    """Every row once per condition; knobs left out take the base value.

    Listed conditions are literals of the plan. A table of conditions is numbered, every
    row is exploded over the numbers, and an equi-join fetches the knobs; nothing of it but
    its size comes to the driver.
    """
    if isinstance(conditions, DataFrame):
        knobs = [F.coalesce(F.col(n), _knob(n, BASE_CONDITION[n])).alias(n) if n in conditions.columns
                 and BASE_CONDITION[n] is not None else F.col(n).cast(KNOB_TYPES[n]).alias(n) if n in conditions.columns
                 else _knob(n, BASE_CONDITION[n]).alias(n) for n in KNOB_TYPES]
        cells = conditions.select(*knobs)
        cells = cells.withColumn("_cell", (F.row_number().over(Window.orderBy(*KNOB_TYPES)) - 1).cast("long"))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(max(conditions.count(), 1) - 1).cast("long"))
        return with_condition(df.withColumn("_cell", F.explode(numbers)).join(cells, "_cell").drop("_cell"))
    cells = [{**BASE_CONDITION, **c} for c in conditions]
    if not cells:
        raise ValueError("Expected at least one condition.")
    structs = [F.struct(*[_knob(n, c[n]).alias(n) for n in KNOB_TYPES]) for c in cells]
    exploded = df.withColumn("_cell", F.explode(F.array(*structs)))
    return with_condition(exploded.select(*df.columns, "_cell.*"))


def with_strategies(df: DataFrame, strategies: Iterable[str] = STRATEGIES) -> DataFrame:
    return df.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def with_prompt(grid: DataFrame) -> DataFrame:
    """Add the prompt of each grid row."""
    return grid.withColumn("prompt", build_prompt(
        F.col("dataset"), F.col("strategy"), F.col("question"), k_shot=F.col("k_shot"),
        cot_trigger=F.col("cot_trigger"), persona_variant=F.col("persona_variant"), structured=F.col("structured")))


def template_table(df: DataFrame) -> DataFrame:
    """Every row once per default template, with ``{question}`` left in the prompt."""
    grid = with_strategies(df.withColumn("dataset", F.explode(F.array(F.lit("gsm8k"), F.lit("strategyqa")))))
    return grid.withColumn("template", build_prompt(
        F.col("dataset"), checked_strategy(F.col("strategy")), "{question}", persona_variant="original"))
