"""Product quantisation: sub-vectors as numbers of centroids, which Spark's k-means fits for each subspace."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.vector import check, reach, similarity
from tesselon.operators.knn import rerank


def parts_for(dims: int) -> int:
    """The largest of 8, 4, 2 and 1 that divides the dimensions."""
    return next(m for m in (8, 4, 2, 1) if dims % m == 0)


@dataclass(frozen=True)
class Codebook:
    centroids: np.ndarray  # parts, centroids, width; fixed in size, whatever the data's

    def encode(self, column: Column) -> Column:
        """One byte a part."""
        book = self.centroids

        @F.pandas_udf("binary")
        def codes(vectors: pd.Series) -> pd.Series:
            out: list = [None] * len(vectors)
            there = np.flatnonzero(vectors.notna().to_numpy())
            if len(there):
                m = np.stack(vectors.iloc[there].to_numpy()).astype(np.float64).reshape(len(there), len(book), -1)
                near = np.stack([((m[:, p, None] - book[p][None]) ** 2).sum(2).argmin(1) for p in range(len(book))], axis=1).astype(np.uint8)
                for i, row in zip(there, near):
                    out[i] = row.tobytes()
            return pd.Series(out)

        return codes(column)

    def decode(self, codes: Column) -> Column:
        """The vectors that codes stand for."""
        book = self.centroids

        @F.pandas_udf("array<double>")
        def vectors(coded: pd.Series) -> pd.Series:
            c = np.frombuffer(b"".join(coded), np.uint8).reshape(len(coded), len(book))
            return pd.Series(list(book[np.arange(len(book)), c].reshape(len(coded), -1)))

        return vectors(codes)

    def score(self, codes: Column, vector: Sequence[float], metric: str = "l2") -> Column:
        """Similarity of a query to coded vectors by one table of partial results a part."""
        q, book = check(vector, metric).reshape(len(self.centroids), -1), self.centroids
        dots = np.einsum("pw,pcw->pc", q, book)
        squares = ((q[:, None] - book) ** 2).sum(2)
        norms = (book**2).sum(2)
        length = float(np.linalg.norm(q))

        @F.pandas_udf("double")
        def one(coded: pd.Series) -> pd.Series:
            c = np.frombuffer(b"".join(coded), np.uint8).reshape(len(coded), len(book))
            pick = lambda t: t[np.arange(len(book)), c].sum(1)
            if metric == "l2":
                return pd.Series(1 / (1 + pick(squares)))
            dot = pick(dots)
            if metric == "cosine":
                dot = dot / np.maximum(np.sqrt(pick(norms)) * length, 1e-300)
            return pd.Series((dot + 1) / 2)

        return one(codes)


def train(docs: DataFrame, name: str, dims: int, parts: int | None = None, centroids: int = 256, iterations: int = 10, seed: int = 0) -> Codebook:
    parts = parts or parts_for(dims)
    width, rows = dims // parts, docs.where(F.col(name).isNotNull())
    k = max(2, min(centroids, rows.limit(centroids).count()))
    book = np.zeros((parts, centroids, width))
    for p in range(parts):
        sub = rows.select(array_to_vector(F.transform(F.slice(name, p * width + 1, width), lambda v: v.cast("double"))).alias("features"))
        found = np.array(KMeans(k=k, maxIter=iterations, seed=seed + p).fit(sub).clusterCenters())
        book[p] = found[np.arange(centroids) % len(found)]
    return Codebook(book)


def knn_coded(docs: DataFrame, name: str, book: Codebook, vector: Sequence[float], k: int, metric: str = "l2", candidates: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Ranks by codes, then by full vectors all rows that can be among the k; see `rerank`."""
    rough = docs.where(F.col(name).isNotNull()).withColumn("_codes", book.encode(F.col(name)))
    rough = rough.withColumn("_rough", book.score(F.col("_codes"), vector, metric)).withColumn("_reach", reach(F.col(name), book.decode(F.col("_codes")), vector, metric))
    return rerank(rough, name, vector, k, metric, candidates or 8 * k, doc_id).drop("_codes")
