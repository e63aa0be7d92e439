"""Scores as column algebra: BM25, BM25F, field-value modifiers, decays, haversine and random scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
EARTH_METRES = 6_371_000.0


def quantised(length: Column) -> Column:
    """Field length as a one-byte norm keeps it: exact below 16, else its top four bits."""
    e = F.greatest(F.length(F.bin(length.cast("long"))) - 4, F.lit(0))
    low = F.pow(F.lit(2.0), e).cast("long")
    return (F.floor(length / low) * low).cast("long")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    ratio = F.when(average > 0, quantised(length) / average).otherwise(F.lit(1.0))
    return weight * tf / (tf + k1 * (1 - b) + k1 * b * ratio)


def modifier(name: str, v: Column) -> Column:
    """The ten field-value modifiers; where a logarithm or quotient has no value, the result is null and the function counts 0."""
    forms = {
        "none": lambda: v,
        "log": lambda: F.log10(v),
        "log1p": lambda: F.log10(v + 1),
        "log2p": lambda: F.log10(v + 2),
        "ln": lambda: F.log(v),
        "ln1p": lambda: F.log(v + 1),
        "ln2p": lambda: F.log(v + 2),
        "square": lambda: v * v,
        "sqrt": lambda: F.when(v >= 0, F.sqrt(v)),
        "reciprocal": lambda: F.try_divide(F.lit(1.0), v),
    }
    if name not in forms:
        raise ValueError(f"unknown modifier {name!r}")
    return forms[name]()


def decay(kind: str, v: Column, origin: float, scale: float, offset: float = 0.0, decay: float = 0.5) -> Column:
    """1 at the origin, `decay` at scale beyond the offset."""
    decay, scale = decay if 0 < decay < 1 else 0.5, float(scale or 1.0)
    far = F.greatest(F.abs(v - F.lit(float(origin))) - F.lit(float(offset)), F.lit(0.0))
    if kind == "gauss":
        return F.exp(-(far * far) / F.lit(2 * (-(scale**2) / (2 * math.log(decay)))))
    if kind == "exp":
        return F.exp(F.lit(math.log(decay) / scale) * far)
    if kind == "linear":
        span = scale / (1 - decay)
        return F.greatest(F.lit(0.0), (F.lit(span) - far) / F.lit(span))
    raise ValueError(f"unknown decay {kind!r}")


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres to a point."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(F.lit(float(lat0)))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_box(lat: Column, lat0: float, metres: float) -> Column:
    """A cheap condition, prunable by column statistics, that holds for all points within the distance."""
    reach = math.degrees(metres / EARTH_METRES) + 1e-9
    return lat.between(lat0 - reach, lat0 + reach)


def random_score(seed: int):
    """A number in [0, 1) for each doc_id, by the splitmix64 scrambling of seed and id."""

    @F.pandas_udf("double")
    def score(ids: pd.Series) -> pd.Series:
        x = np.uint64(seed % (1 << 64)) ^ ids.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        return pd.Series((x >> np.uint64(11)).astype(np.float64) / float(1 << 53))

    return score
