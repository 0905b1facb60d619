"""Self-consistency over the paths of one row, held as an array."""

from pyspark.sql import Column, functions as F

from gradeloom.lookups import PATH_SEPARATOR


def vote(answers: Column) -> Column:
    """Most common non-empty answer, ties to the earliest; '' if all are empty."""
    ranked = F.transform(
        answers,
        lambda a, i: F.struct(
            (F.size(answers) - F.size(F.array_remove(answers, a))).alias("votes"),
            (-i).alias("earlier"),
            a.alias("answer")))
    parsed = F.filter(ranked, lambda r: r["answer"] != "")
    return F.coalesce(F.array_max(parsed)["answer"], F.lit(""))


def join_paths(texts: Column) -> Column:
    return F.array_join(texts, PATH_SEPARATOR)
