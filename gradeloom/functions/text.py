"""String and rounding helpers with Python's semantics."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from gradeloom.lookups import WORD

# All characters Python's str.strip removes (the highest is U+3000).
PY_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def as_col(value) -> Column:
    """A Column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(PY_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(PY_SPACE))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Last match of a pattern, NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def py_round(value: Column, digits: int) -> Column:
    """Round a double as Python does: to the nearest decimal by the exact binary
    value, exact ties to even.

    SQL round() looks at a scaled or printed value, which differs from Python on
    near ties. Here the half-unit product ``value * 2 * 10^digits`` is split into
    its rounded value and its exact error (Veltkamp/Dekker), so the sign of the
    error tells on which side of a tie the binary value lies.
    """
    unit = float(10 ** digits)
    halves = value * F.lit(2.0 * unit)
    low = F.floor(halves / 2.0).cast("double")
    rest = halves - low * 2.0
    big = value * F.lit(134217729.0)
    head = big - (big - value)
    error = (head * F.lit(2.0 * unit) - halves) + (value - head) * F.lit(2.0 * unit)
    up = (rest > 1.0) | ((rest == 1.0) & ((error > 0.0) | ((error == 0.0) & (low % 2.0 != 0.0))))
    return F.when(up, low + 1.0).otherwise(low) / F.lit(unit)
