"""Mixing sources to target weights by weighted fair queueing.

Every document of a source queues in the order of a fixed shuffle (md5 of its doc_id). An occurrence finishes at
the virtual time (words of its source up to and with it) / (target of the source); a second pass over a source
continues where the first has ended. All occurrences stand in one global order of virtual finish time, and the mix
takes them up to the total budget. Prefix sums are two-level (range buckets, then within buckets), so no source,
however large, is ordered in one task, and texts are never shuffled: what is taken of a source is a prefix of its
shuffle, so one threshold a source and pass decides each row where it lies.

Defined cases: null text counts 0 words; a null source is a source of its own, ordered last; rows that repeat a
doc_id share its place in the shuffle and are taken together; an empty table gives an empty result; other columns of
the input pass through whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, word_count

PASSES = 2


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(src, source, source_size, target) from rows of (source, size).

    Water filling: with the sources in order of cap * size / weight, the first k are capped and the rest share what is
    left by weight, where k is the least number that leaves none of the rest above its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # one row a source from here on
    everything = Window.partitionBy(F.lit(0))
    numbered = by_source.withColumn("no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    w = numbered.withColumn("weight", weight).withColumn("most", limit)
    order = everything.orderBy(F.col("most") / F.col("weight"), F.col("no")).rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.orderBy(F.col("most") / F.col("weight"), F.col("no")).rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / F.sum("weight").over(rest)
    w = w.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("no"), F.col("level")))).over(everything)
    w = w.withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("first")["level"] * F.col("weight")))
    return w.select(_source_key(F.col("source")).alias("src"), "source", "source_size", target.alias("target"))


def _prefix_sums(rows: DataFrame, digits: int) -> DataFrame:
    """Adds `upto`: words of the source whose key is at most the row's, rows of one key together."""
    keyed = rows.groupBy("src", "key").agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("key", 1, digits))
    buckets = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("src", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("src", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("inside", F.sum("size").over(within)).join(buckets, ["src", "bucket"]).select("src", "key", "size", (F.col("before") + F.col("inside")).alias("upto"))


def plan(sizes: DataFrame, weights: Sequence[int], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """One row a source: (src, source_size, target, last_1, last_2), last_p being the last key of pass p that the mix takes.

    sizes: (key, src, source, size), best on disk, as it is read several times.
    """
    n = sizes.count()
    targets = scratch.write(source_targets(sizes, weights, share, cap), "targets")
    digits = max(2, len(f"{max(n // 2000, 1):x}"))
    queue = _prefix_sums(sizes, digits).join(F.broadcast(targets) if targets.count() <= 100_000 else targets, "src")
    passes = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass")
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    slots = max(2048, n // 2000)
    queue = queue.where("target > 0").select("src", "key", "size", "upto", "source_size", "target", passes).withColumn("finish", finish)
    queue = scratch.write(queue.select("src", "key", "pass", "size", "finish", F.least(F.floor(F.col("finish") * slots), F.lit(8 * slots)).alias("slot")), "queue")
    budget = float(share) * (targets.agg(F.sum("source_size")).first()[0] or 0)
    # `filled` up to each slot; of the slots, the one where the budget ends is searched row by row
    per_slot = queue.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    per_slot = per_slot.withColumn("filled", F.sum("words").over(upto)).where(F.col("filled") > budget)
    edge = per_slot.agg(F.min(F.struct("slot", (F.col("filled") - F.col("words")).alias("before"))).alias("e")).first()["e"]
    taken = queue.select("src", "pass", "key")
    if edge is not None:
        ordered = Window.partitionBy("slot").orderBy("finish", "key", "src", "pass").rowsBetween(Window.unboundedPreceding, 0)
        run = F.lit(edge["before"]) + F.sum("size").over(ordered)
        part = queue.where(F.col("slot") == edge["slot"]).withColumn("run", run).where(F.col("run") <= budget)
        taken = queue.where(F.col("slot") < edge["slot"]).select("src", "pass", "key").unionByName(part.select("src", "pass", "key"))
    last = taken.groupBy("src").agg(*[F.max(F.when(F.col("pass") == p, F.col("key"))).alias(f"last_{p + 1}") for p in range(PASSES)])
    return targets.join(last, "src", "left")


def _sizes(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), shuffle_key(F.col(doc_id)).alias("key"), _source_key(F.col(source)).alias("src"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))


def _copies() -> Column:
    taken = [F.when(F.col("_key") <= F.col(f"last_{p + 1}"), 1).otherwise(0) for p in range(PASSES)]
    return sum(taken[1:], taken[0])


def mix_report(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(_sizes(docs, text, doc_id, source), "sizes")
    chosen = scratch.write(plan(sizes, weights, share, cap, scratch), "plan")
    scratch.drop("queue")
    rows = sizes.withColumnRenamed("key", "_key").join(chosen.drop("source"), "src").withColumn("copies", _copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(_sizes(docs, text, doc_id, source), "sizes")
    chosen = scratch.write(plan(sizes, weights, share, cap, scratch), "plan").select(F.col("src").alias("_src"), *[f"last_{p + 1}" for p in range(PASSES)])
    scratch.drop("queue")
    scratch.drop("sizes")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), shuffle_key(F.col(doc_id)).alias("_key"), _source_key(F.col(source)).alias("_src"))
    taken = packed.join(chosen, "_src").withColumn("_copies", _copies()).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM d GROUP BY source
), w AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(no % 3 + 1 AS INT)] AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
     - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size,
         coalesce(least(most, weight * (SELECT arg_min(level, (most / weight, no)) FROM l WHERE level <= most / weight)), most) AS target
  FROM l
), q AS (
  SELECT d.source, k, sum(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, k
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k) AS upto FROM q
), f AS (
  SELECT source, k, p, size, (p * source_size + upto) / target AS finish FROM c, (VALUES (0), (1)) AS v(p) WHERE target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, k, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END, p ROWS UNBOUNDED PRECEDING) AS run FROM f
), n AS (
  SELECT source, k, count(*) AS copies FROM r WHERE run <= (SELECT 1.5 * sum(source_size) FROM s) GROUP BY source, k
)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * coalesce(n.copies, 0) AS BIGINT) AS taken, CAST(coalesce(n.copies, 0) AS INT) AS copies
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON n.k = d.k AND n.source IS NOT DISTINCT FROM d.source
"""
