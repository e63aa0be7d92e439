"""Aggregations over all matching rows, before any limit. Each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def number(df: DataFrame, name: str) -> Column:
    """A row's number: of several values the least."""
    return F.array_min(name) if _is_array(df, name) else F.col(name)


def _each(df: DataFrame, name: str) -> DataFrame:
    """A row for each distinct value of a row."""
    return df.withColumn(name, F.explode(F.array_distinct(name))) if _is_array(df, name) else df


def key_text(key: Column) -> Column:
    """A number as a bucket's key is written: whole numbers without a point."""
    return F.when((key == F.floor(key)) & (F.abs(key) < 1e18), key.cast("bigint").cast("string")).otherwise(key.cast("string"))


def terms(df: DataFrame, name: str, size: int = 10, by_key: bool = False, metrics: dict[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, doc_count, metrics...) of the most frequent values, or all of them with size <= 0; of each bucket `by` its own."""
    counted = _each(df, name).where(F.col(name).isNotNull()).groupBy(*by, F.col(name).alias("key"))
    counted = counted.agg(F.count("*").alias("doc_count"), *[c.alias(n) for n, c in (metrics or {}).items()])
    order = ["key"] if by_key else [F.desc("doc_count"), F.asc("key")]
    if not by:
        ordered = counted.orderBy(*order)
        return ordered.limit(size) if size > 0 else ordered
    if size <= 0:
        return counted
    return counted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= size).drop("_n")


def within(df: DataFrame, name: str, size: int = 10, key: str = "parent_key", by: Sequence[str] = ()) -> DataFrame:
    """The rows of df in the most frequent buckets of a field, with the bucket's `key` and `<key>_count`; a row of several values is in several.

    Any aggregation with by=(key,), or by more keys after several such steps, is one inside those buckets.
    """
    best = terms(df, name, size, by=by).withColumnRenamed("key", key).withColumnRenamed("doc_count", f"{key}_count")
    rows = _each(df, name).withColumn(key, F.col(name))
    return rows.join(best, [*by, key])


def nested_terms(df: DataFrame, parent: str, child: str, size: int = 10, child_size: int = 10) -> DataFrame:
    """(parent_key, parent_count, key, doc_count): the most frequent children within the most frequent parents, from one grouping of pairs."""
    rows = _each(df, parent).where(F.col(parent).isNotNull())
    parents = terms(df, parent, size).withColumnsRenamed({"key": "parent_key", "doc_count": "parent_count"})
    pairs = terms(rows.withColumn("parent_key", F.col(parent)), child, 0, by=("parent_key",))
    w = Window.partitionBy("parent_key").orderBy(F.desc("doc_count"), "key")
    best = pairs.join(parents, "parent_key").withColumn("_n", F.row_number().over(w))
    return (best.where(F.col("_n") <= child_size) if child_size > 0 else best).select("parent_key", "parent_count", "key", "doc_count")


def histogram(df: DataFrame, name: str, interval: float, offset: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, doc_count) of non-empty buckets; key is the lower bound."""
    interval = interval if interval > 0 else 1.0
    v = number(df, name).cast("double")
    key = F.floor((v - offset) / interval) * F.lit(float(interval)) + F.lit(float(offset))
    return df.where(v.isNotNull()).groupBy(*by, key.alias("key")).agg(F.count("*").alias("doc_count")).orderBy(*by, "key")


def date_histogram(df: DataFrame, name: str, seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Histogram over a timestamp in steps of whole seconds since the epoch; key is the lower bound in seconds."""
    s = F.floor(F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1_000_000 * seconds)) * F.lit(seconds)
    return df.where(F.col(name).isNotNull()).groupBy(*by, s.cast("long").alias("key")).agg(F.count("*").alias("doc_count")).orderBy(*by, "key")


def ranges(df: DataFrame, name: str, bounds: Sequence[tuple[str, float | None, float | None]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, doc_count) of every named [low, high), which may overlap, empty ones included, in one pass."""
    v = number(df, name).cast("double")

    def within_bounds(low, high) -> Column:
        c = v.isNotNull()
        c = c if low is None else c & (v >= low)
        return c if high is None else c & (v < high)

    counted = df.groupBy(*by).agg(*[F.count_if(within_bounds(lo, hi)).alias(f"_{i}") for i, (_, lo, hi) in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(k).alias("key"), F.col(f"_{i}").alias("doc_count")) for i, (k, _, _) in enumerate(bounds)])
    return counted.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").orderBy(*by, "n").drop("n")


def metrics(df: DataFrame, name: str, kinds: Sequence[str] = ("count", "sum", "min", "max", "avg"), by: Sequence[str] = ()) -> DataFrame:
    """One row (of each bucket); without values each is 0."""
    v = number(df, name).cast("double")
    forms = {"count": F.count(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "avg": F.avg(v)}
    return df.groupBy(*by).agg(*[F.coalesce(forms[k].cast("long" if k == "count" else "double"), F.lit(0)).alias(k) for k in kinds])


def cardinality(df: DataFrame, name: str, exact: bool = False, by: Sequence[str] = ()) -> DataFrame:
    rows = _each(df, name).groupBy(*by)
    return rows.agg((F.count_distinct(name) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(name, F.lit(14)))).alias("value"))


def percentiles(df: DataFrame, name: str, points: Sequence[float] = (50.0, 95.0, 99.0), exact: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by..., key, value): interpolated exactly, or from a bounded summary."""
    v, p = number(df, name).cast("double"), F.array(*[F.lit(x / 100) for x in points])
    got = df.groupBy(*by).agg((F.percentile(v, p) if exact else F.percentile_approx(v, p, 10_000)).alias("v"))
    keys = F.array(*[F.lit(f"{x:g}") for x in points])
    return got.select(*by, F.explode(F.arrays_zip(keys.alias("key"), F.col("v").alias("value"))).alias("r")).select(*by, "r.key", "r.value")
