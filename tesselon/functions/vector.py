"""Vector metrics as NumPy kernels over Arrow batches, and scalar and product quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def check(vector, metric: str) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    if v.ndim != 1 or not v.size:
        raise ValueError("a vector is a non-empty list of numbers")
    if not np.isfinite(v).all():
        raise ValueError("a vector has finite numbers only")
    if metric == "cosine" and not v.any():
        raise ValueError("the zero vector has no direction")
    return v


def similarity(column: Column, vector, metric: str = "cosine") -> Column:
    """Scores in [0, 1] for cosine and l2: (cos + 1) / 2, (dot + 1) / 2, 1 / (1 + d^2); null vectors give null, non-finite scores 0."""
    q = check(vector, metric)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        there = vectors.notna().to_numpy()
        if there.any():
            rows = vectors[there]
            if any(len(r) != len(q) for r in rows):
                raise ValueError("vectors differ in length")
            m = np.stack(rows.to_numpy()).astype(np.float64)
            with np.errstate(all="ignore"):
                if metric == "cosine":
                    s = (m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q)) + 1) / 2
                elif metric == "dot_product":
                    s = (m @ q + 1) / 2
                elif metric == "l2":
                    s = 1 / (1 + ((m - q) ** 2).sum(axis=1))
                else:
                    raise ValueError(f"unknown metric {metric!r}")
            out[there] = np.where(np.isfinite(s), s, 0.0)
        return pd.Series(out).where(pd.Series(there), None)

    return score(column)


def reach(column: Column, approximate: Column, vector, metric: str = "cosine") -> Column:
    """The greatest `similarity` that a vector can have by its approximation and its error, the distance between the two: never less than its own."""
    q = check(vector, metric)

    @F.pandas_udf("double")
    def high(vectors: pd.Series, approximations: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        m, a = (np.stack(x.to_numpy()).astype(np.float64) for x in (vectors, approximations))
        with np.errstate(all="ignore"):
            error = np.linalg.norm(m - a, axis=1)
            if metric == "l2":
                s = 1 / (1 + np.maximum(np.linalg.norm(a - q, axis=1) - error, 0) ** 2)
            else:
                s = a @ q + np.linalg.norm(q) * error
                if metric == "cosine":
                    s = s / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
                s = (s + 1) / 2
            s = s + 1e-9 * (1 + np.abs(s))  # for rounding
        return pd.Series(np.where(np.isfinite(s), s, np.inf))

    return high(column, approximate)


def int8_codes(column: Column, low: float, scale: float) -> Column:
    """Bytes 0..255 of (v - low) / scale, all in the JVM."""
    return F.transform(column, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round((v - F.lit(low)) / F.lit(scale)))).cast("smallint"))


def int8_values(codes: Column, low: float, scale: float) -> Column:
    return F.transform(codes, lambda c: (F.lit(low) + c * F.lit(scale)).cast("float"))


def int8_range(vectors, name: str) -> tuple[float, float]:
    """(least value, step) over all vectors of a DataFrame column."""
    r = vectors.agg(F.min(F.array_min(name)).alias("lo"), F.max(F.array_max(name)).alias("hi")).first()
    if r["lo"] is None:
        return 0.0, 1.0
    return float(r["lo"]), (float(r["hi"]) - float(r["lo"])) / 255 or 1.0
