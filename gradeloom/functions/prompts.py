"""Prompt construction as string expressions."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import as_col, empty_to_null
from gradeloom.lookups import DATASETS, FEW_SHOT, PERSONAS, STRATEGIES, STRUCTURED_TAILS, TRIGGERS


def _choose(key: Column, make: Callable[[str], Column], names: list[str], what: str) -> Column:
    """The expression made for the name found in ``key``; an error for other names."""
    chosen = F.when(key == names[0], make(names[0]))
    for name in names[1:]:
        chosen = chosen.when(key == name, make(name))
    return chosen.otherwise(F.raise_error(F.concat(F.lit(f"Unknown {what} '"), key, F.lit("'."))))


def checked_dataset(dataset) -> Column:
    """Lower-cased dataset name; the job fails on an unknown one."""
    return _choose(F.lower(as_col(dataset)), F.lit, DATASETS, "dataset")


def checked_strategy(strategy) -> Column:
    return _choose(F.lower(as_col(strategy)), F.lit, STRATEGIES, "strategy")


def default_shots(k_shot: Column, strategy: Column) -> Column:
    return F.coalesce(k_shot, F.when(strategy == "standard_few_shot", 1).otherwise(0))


def few_shot_block(dataset: Column, k_shot: Column) -> Column:
    """First k demonstrations separated by blank lines; '' for k <= 0."""
    def block(name: str) -> Column:
        shots = F.array(*[F.lit(f"Q: {q}\nA: {a}") for q, a in FEW_SHOT[name]])
        return F.array_join(F.slice(shots, F.lit(1), F.greatest(k_shot, F.lit(0))), "\n\n")

    return _choose(dataset, block, DATASETS, "dataset")


def trigger_phrase(cot_trigger: Column) -> Column:
    phrase = F.when(cot_trigger == "careful", TRIGGERS["careful"]).when(cot_trigger == "none", TRIGGERS["none"])
    return phrase.otherwise(TRIGGERS["default"])


def question_block(strategy: Column, question: Column, cot_trigger: Column) -> Column:
    cue = F.concat(F.lit("Q: "), question, F.lit("\nA:"))
    phrase = trigger_phrase(cot_trigger)
    with_trigger = (strategy != "standard_few_shot") & (phrase != "")
    return F.when(with_trigger, F.concat(cue, F.lit(" "), phrase)).otherwise(cue)


def persona_preamble(dataset: Column, persona_variant: Column) -> Column:
    def preamble(name: str) -> Column:
        variants = PERSONAS[name]
        return _choose(persona_variant, lambda v: F.lit(variants[v]), list(variants), "persona")

    return _choose(dataset, preamble, DATASETS, "dataset")


def structured_tail(dataset: Column) -> Column:
    return _choose(dataset, lambda name: F.lit(STRUCTURED_TAILS[name]), DATASETS, "dataset")


def build_prompt(dataset, strategy, question, *, k_shot=None, cot_trigger="default",
                 persona_variant="revised", structured=False) -> Column:
    """One prompt from columns or literals: persona, demonstrations, question, tail."""
    ds, st = checked_dataset(dataset), checked_strategy(strategy)
    shots = default_shots(as_col(k_shot).cast("int"), st)
    persona = F.when(st == "persona_prompting", persona_preamble(ds, as_col(persona_variant)))
    body = F.concat_ws(
        "\n\n",
        persona,
        empty_to_null(few_shot_block(ds, shots)),
        question_block(st, as_col(question), as_col(cot_trigger)),
    )
    return F.concat(body, F.when(as_col(structured), structured_tail(ds)).otherwise(""))


get_prompt = build_prompt
