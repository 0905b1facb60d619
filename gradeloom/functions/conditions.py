"""Condition labels: writing, reading and checking."""

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import as_col, empty_to_null
from gradeloom.lookups import CONTEXT_WINDOW, MAX_TOKENS_HINT, PROMPT_ROOM


def condition_label(model, k_shot, cot_trigger, persona_variant, structured, max_tokens,
                    temperature, self_consistency) -> Column:
    """Compact tag of one cell, e.g. ``model=m,k=def,...,sc=1``."""
    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value.cast("string"))

    return F.concat_ws(
        ",",
        tag("model", F.coalesce(empty_to_null(as_col(model).cast("string")), F.lit("unknown"))),
        tag("k", F.coalesce(as_col(k_shot).cast("string"), F.lit("def"))),
        tag("trig", as_col(cot_trigger)),
        tag("persona", as_col(persona_variant)),
        tag("struct", F.when(as_col(structured), "on").otherwise("off")),
        tag("mt", as_col(max_tokens)),
        tag("T", as_col(temperature).cast("double")),
        tag("sc", as_col(self_consistency)),
    )


def condition_max_tokens(condition: Column, hint: int = MAX_TOKENS_HINT) -> Column:
    found = F.regexp_extract(condition, r"mt=(\d+)", 1)
    return F.coalesce(found.try_cast("long"), F.lit(hint).cast("long"))


def condition_model(condition: Column) -> Column:
    return F.coalesce(empty_to_null(F.regexp_extract(condition, r"model=([^,]+)", 1)), F.lit("unknown"))


def condition_without_model(condition: Column) -> Column:
    return F.regexp_replace(condition, r"^model=[^,]*,", "")


def sampling_paths(self_consistency: Column) -> Column:
    """Number of sampled paths, at least one."""
    return F.greatest(F.lit(1), self_consistency)


def repeats_same_sample(self_consistency: Column, temperature: Column) -> Column:
    """Several paths at temperature zero are copies of one another."""
    return (self_consistency > 1) & (temperature == 0.0)


def leaves_little_prompt_room(max_tokens: Column) -> Column:
    return max_tokens > CONTEXT_WINDOW - PROMPT_ROOM
