"""Similarity of two sets of token vectors held in one row."""

import pandas as pd
from pyspark.sql import Column, functions as F

_BLOCK = 256  # candidate tokens compared at a time


def embedding_f1(candidate: Column, reference: Column, dim: int) -> Column:
    """Greedy-matching F1 of token vectors (the BERTScore formula, Zhang et al. 2020).

    Both sides are flat float arrays of ``tokens x dim`` values. Every token takes
    its best cosine on the other side; precision averages over the candidate,
    recall over the reference. NULL or empty input gives NULL. Memory grows with the
    longer side, not with the product of both.
    """
    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        import numpy as np

        def unit(flat):
            rows = np.asarray(flat, dtype="float64").reshape(-1, dim)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)

        def f1(a, b):
            if a is None or b is None or not len(a) or not len(b):
                return None
            a, b = unit(a), unit(b).T
            best_a, best_b = [], np.full(b.shape[1], -np.inf)
            for i in range(0, len(a), _BLOCK):
                cosine = a[i:i + _BLOCK] @ b
                best_a.append(cosine.max(axis=1))
                np.maximum(best_b, cosine.max(axis=0), out=best_b)
            p, r = np.concatenate(best_a).mean(), best_b.mean()
            return 2 * p * r / (p + r) if p + r else 0.0

        return pd.Series([f1(a, b) for a, b in zip(left, right)], dtype="float64")

    return score(candidate, reference)
