"""Vector expressions over array columns, and the Arrow path for wide ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this dimension on, one NumPy product per Arrow batch beats interpreted lambdas per element.
ARROW_FROM = 128


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_double(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either is null or has no length."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size)


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine similarity of a column to one query vector."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    if len(q) < ARROW_FROM:
        literal = F.array(*[F.lit(float(x)) for x in q])
        size = l2_norm(v) * F.lit(norm)
        return F.when(size > 0, dot(v, literal) / size)

    @F.pandas_udf("double")
    def product(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        known = vectors.notna()
        out = np.full(len(vectors), np.nan)
        if known.any():
            table = np.stack(vectors[known].to_numpy()).astype(np.float64)
            size = np.sqrt((table * table).sum(axis=1)) * norm
            out[known.to_numpy()] = np.where(size > 0, table @ q / np.where(size > 0, size, 1), np.nan)
        return pd.Series(out)

    return F.nanvl(product(v), F.lit(None).cast("double"))


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
