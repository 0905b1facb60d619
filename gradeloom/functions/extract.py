"""Answer extraction from free text."""

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import bind, empty_to_null, last_match, rstrip, strip
from gradeloom.lookups import (
    ANSWER_LINE, ANSWER_PUNCTUATION, GOLD_MARK, NEAR_KEYWORD, NUMBER, SPACE_CHAR, YES_NO_WORD,
)


def answer_line(text: Column) -> Column:
    """Content of the last ``Answer:`` line without closing punctuation; NULL if absent."""
    line = strip(last_match(text, ANSWER_LINE, 1))
    return strip(F.rtrim(line, F.lit(ANSWER_PUNCTUATION)))


def _number(matched: Column) -> Column:
    return F.replace(matched, F.lit(","), F.lit(""))


def numeric_answer(text: Column) -> Column:
    """Final number: answer line, gold marker, conclusion keyword, anywhere; '' if none."""
    after_mark = F.when(F.contains(text, F.lit(GOLD_MARK)), F.substring_index(text, GOLD_MARK, -1))
    return F.coalesce(
        _number(last_match(answer_line(text), NUMBER)),
        _number(last_match(after_mark, NUMBER)),
        _number(last_match(F.lower(text), NEAR_KEYWORD, 1)),
        _number(last_match(text, NUMBER)),
        F.lit(""),
    )


def boolean_answer(text: Column) -> Column:
    """yes / no: answer line, conclusion phrase, final word, last such word; '' if none."""
    line = F.rtrim(strip(F.lower(answer_line(text))), F.lit(ANSWER_PUNCTUATION))
    first = F.regexp_extract(line, f"^[^{SPACE_CHAR}]+", 0)
    from_line = bind(first, lambda w: F.when(w.isin("yes", "true"), "yes").when(w.isin("no", "false"), "no"))
    return F.coalesce(from_line, bind(F.lower(text), _unmarked_boolean), F.lit(""))


def _unmarked_boolean(lowered: Column) -> Column:
    """yes / no of a lower-cased text without a usable answer line."""
    ending = rstrip(F.rtrim(rstrip(lowered), F.lit(ANSWER_PUNCTUATION)))
    # Four characters show whether the last word is exactly yes or no.
    final = F.regexp_extract(F.substring(ending, -4, 4), f"(?:^|[{SPACE_CHAR}])(yes|no)$", 1)

    def says(word: str) -> Column:
        return (F.contains(lowered, F.lit(f"answer is {word}"))
                | F.contains(lowered, F.lit(f"therefore, {word}")))

    return F.coalesce(
        F.when(says("yes"), "yes").when(says("no"), "no"),
        bind(final, empty_to_null),
        last_match(lowered, YES_NO_WORD, 1),
    )


def extract_answer(text: Column, dataset: Column) -> Column:
    """Number for the numeric set, yes / no for the boolean set."""
    return F.when(F.lower(dataset) == "gsm8k", numeric_answer(text)).otherwise(boolean_answer(text))


def gold_answer(answer_raw: Column, dataset: Column) -> Column:
    """Normalised gold: number of the gold chain, or yes / no from a boolean."""
    label = F.when(F.lower(answer_raw) == "true", "yes").otherwise("no")
    return F.when(F.lower(dataset) == "gsm8k", numeric_answer(answer_raw)).otherwise(label)


def gold_text(answer_raw: Column, gold: Column, dataset: Column) -> Column:
    """Reference text for the overlap metrics: the whole chain, or the label."""
    return F.when(F.lower(dataset) == "gsm8k", answer_raw).otherwise(gold)
