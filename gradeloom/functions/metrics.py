"""Row metrics over a prediction and a reference."""

import pandas as pd
from pyspark.sql import Column, functions as F

from gradeloom.functions.text import bind, empty_to_null, strip
from gradeloom.lookups import FLOAT_TEXT, NUMERIC_TOLERANCE

FEW_SHARED = 4  # different tokens in common up to which their order is compared without a search


def exact_match(predicted: Column, gold: Column) -> Column:
    return ((predicted == gold) & (predicted != "")).cast("int")


def parse_failed(predicted: Column) -> Column:
    return (predicted == "").cast("int")


def substring_match(prediction: Column, reference: Column) -> Column:
    """Trimmed, lower-cased reference inside the prediction; empty on either side is 0."""
    p = F.lower(strip(prediction))
    r = F.lower(strip(reference))
    return F.coalesce(((p != "") & (r != "") & F.contains(p, r)).cast("int"), F.lit(0))


def prediction_or_text(predicted: Column, generation: Column) -> Column:
    """The extracted answer, or the raw text where extraction failed."""
    return F.coalesce(empty_to_null(predicted), generation)


def _as_float(text: Column) -> Column:
    plain = strip(F.replace(text, F.lit(","), F.lit("")))
    digits = F.replace(plain, F.lit("_"), F.lit(""))
    return F.when(plain.rlike(FLOAT_TEXT), digits.try_cast("double"))


def numeric_close(prediction: Column, reference: Column, tolerance: float = NUMERIC_TOLERANCE) -> Column:
    """1 where both sides are numbers at most ``tolerance`` apart."""
    near = F.abs(_as_float(prediction) - _as_float(reference)) <= F.lit(tolerance)
    return F.coalesce(near.cast("int"), F.lit(0))


def f1(common: Column, p_size: Column, r_size: Column) -> Column:
    precision = common / p_size
    recall = common / r_size
    return F.when(common > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)


def _merged_hits(p: Column, r: Column) -> Column:
    """One pass over both arrays, merged and sorted: every token of ``r`` takes a not
    yet used equal token of ``p``, which sorts before it."""
    side = lambda tokens, flag: F.transform(
        tokens, lambda t: F.struct(t.alias("token"), F.lit(flag).alias("side")))
    merged = F.sort_array(F.concat(side(p, 0), side(r, 1)))
    start = F.struct(F.lit("").alias("token"), F.lit(0).alias("free"), F.lit(0).alias("hits"))

    def step(state: Column, item: Column) -> Column:
        free = F.when(state["token"] == item["token"], state["free"]).otherwise(0)
        hit = ((item["side"] == 1) & (free > 0)).cast("int")
        gained = (item["side"] == 0).cast("int")
        return F.struct(
            item["token"].alias("token"), (free + gained - hit).alias("free"), (state["hits"] + hit).alias("hits"))

    return F.aggregate(merged, start, step, lambda state: state["hits"])


def common_tokens(p: Column, r: Column) -> Column:
    """Size of the multiset intersection of two token arrays, within the row."""
    def hits(shared: Column) -> Column:
        return (F.when(F.size(shared) == 0, 0)
                .when((F.size(p) == 1) | (F.size(r) == 1), 1)
                # Where one side repeats no token, each shared one counts once.
                .when(F.size(F.array_distinct(r)) == F.size(r), F.size(shared))
                .when(F.size(F.array_distinct(p)) == F.size(p), F.size(shared))
                .otherwise(_merged_hits(p, r)))

    return bind(F.array_intersect(p, r), hits)


def token_f1(p: Column, r: Column) -> Column:
    """Word F1 of two token arrays; 0.0 without overlap.

    The arrays are used more than once: pass columns, not the expressions that
    make them (``operators.scoring.with_overlap`` does so for whole tables).
    """
    return bind(common_tokens(p, r), lambda common: f1(common, F.size(p), F.size(r)))


def _lcs_words(left: Column, right: Column) -> Column:
    """Longest common subsequence of two space-joined token lists.

    Bit-parallel recurrence of Hyyro (2004): one big-integer step per token.
    """
    @F.pandas_udf("int")
    def lcs(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        def length(a, b):
            if a is None or b is None:
                return None
            a, b = a.split(" "), b.split(" ")
            if len(a) < len(b):
                a, b = b, a
            masks = {}
            for i, token in enumerate(b):
                masks[token] = masks.get(token, 0) | (1 << i)
            full = (1 << len(b)) - 1
            row = full
            for token in a:
                mask = masks.get(token)
                if mask:
                    shared = row & mask
                    row = ((row + shared) | (row - shared)) & full
            return len(b) - row.bit_count()

        return pd.Series([length(a, b) for a, b in zip(lefts, rights)], dtype="Int32")

    return lcs(left, right)


def evident_lcs(p: Column, r: Column) -> Column:
    """LCS of two token arrays where it needs no search, else NULL: nothing shared, one token on a side,
    or few shared tokens that stand in the same order on both sides."""
    def length(shared: Column) -> Column:
        kept = lambda side: F.filter(side, lambda t: F.array_contains(shared, t))
        easy = (F.when(F.size(shared) == 0, 0)
                .when((F.size(p) == 1) | (F.size(r) == 1), 1)
                .when(F.size(shared) <= FEW_SHARED, bind(kept(p), lambda left: F.when(left == kept(r), F.size(left)))))
        return F.when(shared.isNotNull(), easy)

    return bind(F.array_intersect(p, r), length)


def lcs_length(p: Column, r: Column, evident: Column | None = None) -> Column:
    """LCS of two token arrays. Python sees only rows whose answer is not evident:
    both sides longer than one token and sharing at least one; where ``evident`` is
    given, a column made by ``evident_lcs``, those that it leaves NULL."""
    if evident is not None:
        hard = evident.isNull() & p.isNotNull() & r.isNotNull()
        return F.coalesce(evident, _lcs_words(F.when(hard, F.array_join(p, " ")), F.when(hard, F.array_join(r, " "))))
    hard = F.arrays_overlap(p, r) & (F.size(p) > 1) & (F.size(r) > 1)
    dynamic = _lcs_words(F.when(hard, F.array_join(p, " ")), F.when(hard, F.array_join(r, " ")))
    return F.coalesce(dynamic, F.arrays_overlap(p, r).cast("int"))


def rouge_l(p: Column, r: Column) -> Column:
    """ROUGE-L F1 of two token arrays; 0.0 without a common subsequence. Pass columns."""
    return f1(lcs_length(p, r), F.size(p), F.size(r))
