"""Columns that are computed once per row."""

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    The optimizer moves filters and projections through plain projections by
    repeating their expressions, which for regular expressions over whole texts
    costs far more than it saves. It does not look inside a generator, so later
    operators see the results as plain columns.
    """
    fields = [value.alias(name) for name, value in columns.items()]
    return rows.select("*", F.inline(F.array(F.struct(*fields))))
