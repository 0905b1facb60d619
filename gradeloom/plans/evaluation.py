"""From questions and recorded generations to a scored log."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from gradeloom.lookups import BASE_CONDITION, STRATEGIES
from gradeloom.operators.grid import sweep, with_conditions, with_prompt, with_strategies
from gradeloom.operators.paths import attach_generations, vote_paths
from gradeloom.operators.resume import pending
from gradeloom.operators.samples import first_n
from gradeloom.operators.scoring import score_rows


def _cells(conditions: Iterable[dict] | DataFrame | None, base: dict | None) -> list[dict] | DataFrame:
    """The conditions to run: those listed over the base, the base alone, or a table as it is."""
    if isinstance(conditions, DataFrame):
        return conditions
    return [{**(base or {}), **c} for c in ([{}] if conditions is None else conditions)]


def experiment_grid(samples: DataFrame, conditions: Iterable[dict] | DataFrame | None = None, dims: Iterable[str] | None = None,
                    base: dict | None = None, strategies: Iterable[str] = STRATEGIES,
                    max_samples: int | None = None) -> DataFrame:
    """Samples times strategies times conditions: a list or table of them, or a sweep over dims, from a base."""
    rows = with_strategies(first_n(samples, max_samples), strategies)
    return sweep(rows, dims, base) if dims is not None else with_conditions(rows, _cells(conditions, base))


def most_paths(conditions: Iterable[dict] | DataFrame | None = None, base: dict | None = None, **_) -> int:
    """The largest number of paths a condition of the grid asks for."""
    default, cells = BASE_CONDITION["self_consistency"], _cells(conditions, base)
    if isinstance(cells, DataFrame):
        asked = [cells.agg(F.max("self_consistency")).first()[0] if "self_consistency" in cells.columns else None]
    else:
        asked = [c.get("self_consistency") for c in cells]
    return max([1, *[default if n is None else n for n in asked]])


def pending_prompts(samples: DataFrame, log: DataFrame | None = None, **grid) -> DataFrame:
    """The prompts still to be answered.

    The grid is reduced to keys before the resume join, so question texts are not
    multiplied through its shuffle; they join the remaining keys afterwards.
    """
    if log is None:
        return with_prompt(experiment_grid(samples, **grid))
    keys = pending(experiment_grid(samples.select("dataset", "sample_idx"), **grid), log)
    return with_prompt(keys.join(samples, ["dataset", "sample_idx"]))


def evaluate(samples: DataFrame, generations: DataFrame, log: DataFrame | None = None, **grid) -> DataFrame:
    """Scored rows of every grid cell from the recorded generations."""
    if not isinstance(grid.get("conditions"), (DataFrame, type(None))):
        grid["conditions"] = list(grid["conditions"])  # used twice
    cells = experiment_grid(samples, **grid)
    if log is not None:
        cells = pending(cells, log)
    return score_rows(vote_paths(attach_generations(cells, generations, most_paths(**grid))))
