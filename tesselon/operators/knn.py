"""Nearest neighbours by exact scan, filtered and hybrid search, and by codes with an exact second step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.vector import int8_codes, int8_range, int8_values, reach, similarity
from tesselon.sources.scratch import Scratch


def knn(docs: DataFrame, name: str, vector: Sequence[float], k: int, metric: str = "cosine", where=None, doc_id: str = "doc_id") -> DataFrame:
    """The k rows of greatest similarity among those that meet `where`; the scan keeps k rows a task, so nothing but they is shuffled."""
    if k <= 0:
        raise ValueError("k is positive")
    rows = docs.where(F.col(name).isNotNull())
    if where is not None:
        rows = rows.where(where)
    return rows.withColumn("score", similarity(F.col(name), vector, metric)).orderBy(F.desc("score"), F.asc(doc_id)).limit(k)


def knn_quantised(docs: DataFrame, name: str, vector: Sequence[float], k: int, metric: str = "l2", candidates: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Ranks one-byte codes first, then by full vectors all rows that can be among the k; see `rerank`."""
    low, scale = int8_range(docs, name)
    coded = docs.where(F.col(name).isNotNull()).withColumn("_approximate", int8_values(int8_codes(F.col(name), low, scale), low, scale))
    rough = coded.withColumn("_rough", similarity(F.col("_approximate"), vector, metric)).withColumn("_reach", reach(F.col(name), F.col("_approximate"), vector, metric))
    return rerank(rough, name, vector, k, metric, candidates or 4 * k, doc_id).drop("_approximate")


def rerank(rough: DataFrame, name: str, vector: Sequence[float], k: int, metric: str, candidates: int, doc_id: str = "doc_id") -> DataFrame:
    """The exact k of rows with a score by code (_rough) and the greatest score they can have (_reach).

    The k-th exact score of the best `candidates` by code is a score that the k-th of all rows can't be below; all rows
    that can reach it are ranked by their full vectors.
    """
    first = rough.orderBy(F.desc("_rough"), F.asc(doc_id)).limit(max(candidates, k)).select(similarity(F.col(name), vector, metric).alias("score"))
    found = [r["score"] for r in first.orderBy(F.desc("score")).limit(k).collect()]
    rest = rough.where(F.col("_reach") >= found[-1]) if len(found) == k else rough
    return rest.drop("_rough", "_reach").withColumn("score", similarity(F.col(name), vector, metric)).orderBy(F.desc("score"), F.asc(doc_id)).limit(k)


def ranked(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds `rank`, from 1, to a list of hits (k rows)."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(doc_id))))


def fuse(lists: Sequence[DataFrame], k: int, rank_constant: int = 60, doc_id: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of hit lists that were each cut to k: the sum of 1 / (rank_constant + rank)."""
    parts = [ranked(x, doc_id).select(doc_id, (1.0 / (rank_constant + F.col("rank"))).alias("s")) for x in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(doc_id).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), F.asc(doc_id)).limit(k)


#: Rows and bytes of a block of vectors at most, and scores that a task holds at once.
BLOCK_ROWS, BLOCK_BYTES, TILE = 4096, 4 << 20, 1 << 20


def _blocks(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows (id, v) packed in blocks: <prefix>ids and <prefix>vectors, of the vectors' own element type."""
    kind = np.dtype(np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), -1)
            ids = batch.column("id").to_numpy()
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, v[0].nbytes)))
            for at in range(0, len(ids), step):
                yield pa.RecordBatch.from_arrays([pa.array([x[at : at + step].tobytes()], pa.binary()) for x in (ids, v)], names=[f"{prefix}ids", f"{prefix}vectors"])

    return rows.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, f"{prefix}ids binary, {prefix}vectors binary")


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return ((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T + 1) / 2
    if metric == "dot_product":
        return (q @ m.T + 1) / 2
    return 1 / (1 + np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q @ m.T, 0))


_NONE = np.iinfo(np.int64).max


def _nearer(score: np.ndarray, found: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Puts the k nearest of each row of (score, found), its k nearest so far, and of the scores s of ids in their place."""
    k = score.shape[1]
    least = score[:, -1]
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    row, column = np.nonzero(s >= least[:, None])
    if not len(row):
        return
    rows = np.unique(row)
    row = np.concatenate([np.repeat(rows, k), row])
    every, own = np.concatenate([score[rows].ravel(), s[row[len(rows) * k :], column]]), np.concatenate([found[rows].ravel(), ids[column]])
    order = np.lexsort((own, -every, row))
    row, every, own = row[order], every[order], own[order]
    first = np.searchsorted(row, rows)
    pick = first[:, None] + np.arange(k)
    score[rows], found[rows] = every[pick], own[pick]


def _nearest(k: int, metric: str, kinds: tuple[np.dtype, np.dtype]):
    """Of pairs of blocks of queries and of rows, the k nearest of each query in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for query_ids, queries, ids, vectors in zip(*(batch.column(c) for c in ("qids", "qvectors", "ids", "vectors"))):
                name = query_ids.as_py()
                n, ids = len(name) // 8, np.frombuffer(ids.as_buffer(), np.int64)
                q = np.frombuffer(queries.as_buffer(), kinds[0]).reshape(n, -1)
                m = np.frombuffer(vectors.as_buffer(), kinds[1]).reshape(len(ids), -1).astype(np.float64)
                score, found = best.setdefault(name, (np.full((n, k), -np.inf), np.full((n, k), _NONE)))
                step = max(1, TILE // len(ids))
                for at in range(0, n, step):
                    s = _scores(q[at : at + step].astype(np.float64), m, metric)
                    s[np.isnan(s)] = -np.inf  # after all others
                    _nearer(score[at : at + step], found[at : at + step], s, ids)
        for name, (score, found) in best.items():
            there = found.ravel() != _NONE
            s = np.where(np.isneginf(score), np.nan, score).ravel()[there]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(name, np.int64), k)[there]), pa.array(found.ravel()[there]), pa.array(s)], names=["query", "id", "score"])

    return run


def batch_knn(docs: DataFrame, queries: DataFrame, name: str, k: int, metric: str = "cosine", doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score): the k nearest of every query vector; query_ids are distinct.

    Both sides are packed in blocks, and every block of queries meets every block of rows in some task, which holds a tile
    of scores and k rows a query and passes on only these; a second step cuts them to k. No vector passes the driver
    but those of a packed side that Spark finds small enough for a broadcast of its own.
    """
    if k <= 0:
        raise ValueError("k is positive")
    side = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col(name).alias("v"))
    kinds = tuple(np.dtype(np.float32 if df.schema[name].dataType.elementType.simpleString() == "float" else np.float64) for df in (queries, docs))
    asked = Scratch(docs.sparkSession, "queries").write(_blocks(side(queries, query_id), "q"), "blocks")
    pairs = _blocks(side(docs, doc_id), "").crossJoin(asked)
    out = pairs.mapInArrow(_nearest(k, metric, kinds), "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    ranks = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranks.select(F.col("query").alias(query_id), F.col("id").alias(doc_id), "score", "rank")
