"""Why did a row fail: truncation, extraction or reasoning."""

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import as_col, rstrip, strip, tokens
from gradeloom.lookups import (
    ANSWER_CUE, CLEAN_ENDINGS, GOLD_MARK, LONG_COMPLETION_TOKENS, LONG_TEXT_CHARS, MAX_TOKENS_HINT, NUMBER, WORD_CHAR,
)


def gold_present(generation: Column, gold: Column, dataset: Column) -> Column:
    """Is the gold answer in the text: as a whole word, or as one of its numbers."""
    text = F.lower(generation)
    target = strip(F.lower(gold))

    def boundary(next_to: Column, ahead: str) -> Column:
        inside = next_to.rlike(f"^[{WORD_CHAR}]$")
        return F.when(inside, f"(?{ahead}![{WORD_CHAR}])").otherwise(f"(?{ahead}=[{WORD_CHAR}])")

    quoted = F.concat(F.lit("\\Q"), F.replace(target, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    word = F.concat(boundary(F.left(target, F.lit(1)), "<"), quoted, boundary(F.right(target, F.lit(1)), ""))
    number = F.replace(target, F.lit(","), F.lit(""))
    has_number = F.exists(
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)),
        lambda n: F.replace(n, F.lit(","), F.lit("")) == number)
    # A gold of one word is looked up among the words; only others need a pattern of their own.
    single = target.rlike(f"^[{WORD_CHAR}]+$")
    has_word = F.when(single, F.array_contains(tokens(generation), target)).otherwise(F.rlike(text, word))
    found = F.when(dataset == "strategyqa", has_word).otherwise(has_number)
    return F.coalesce((target != "") & found, F.lit(False))


def looks_truncated(generation: Column, dataset: Column, completion_tokens: Column,
                    max_tokens=MAX_TOKENS_HINT) -> Column:
    """No clean ending, no answer cue, and a spent token budget or a long text."""
    text = rstrip(generation)
    limit = as_col(max_tokens)
    clean = F.right(text, F.lit(1)).isin(*CLEAN_ENDINGS)
    cue = text.rlike(ANSWER_CUE) | ((dataset == "gsm8k") & F.contains(text, F.lit(GOLD_MARK)))
    spent = ((limit != 0) & (completion_tokens >= limit - 4)) | (completion_tokens >= LONG_COMPLETION_TOKENS)
    return (F.when(text == "", False)
            .when(clean | cue, False)
            .when(spent, True)
            .otherwise(F.coalesce(F.length(text) > LONG_TEXT_CHARS, F.lit(False))))


def failure_category(generation: Column, gold: Column, dataset: Column, completion_tokens: Column,
                     max_tokens=MAX_TOKENS_HINT) -> Column:
    return (F.when(looks_truncated(generation, dataset, completion_tokens, max_tokens), "truncation")
            .when(gold_present(generation, gold, dataset), "extraction")
            .otherwise("reasoning"))
