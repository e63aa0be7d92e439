"""Connected components of a distributed edge list by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b), undirected, to (id, comp): the smallest id reachable, for each id that has an edge.

    Each round hooks the label of every component's root to the least label next to any of its members, and then
    jumps pointers; the number of rounds grows with the logarithm of the longest path. Nothing but a count reaches
    the driver. Each round is written, so earlier ones aren't recomputed.
    """
    pairs = edges.select("a", "b").where("a <> b").distinct()
    both = scratch.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id")
    labels = scratch.write(labels, f"{name}-0")
    step = 0
    while True:
        step += 1
        # the least label next to each id, then for each label the least one next to its members
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(seen.withColumnRenamed("a", "id"), "id").withColumn("least", F.least("comp", "near"))
        hooks = met.groupBy("comp").agg(F.min("least").alias("least")).where("least < comp")
        hooks = scratch.write(hooks, f"{name}-hooks-{step}")
        if hooks.isEmpty():
            return labels
        jumped = hooks.select("comp", F.col("least").alias("mid")).join(hooks.select(F.col("comp").alias("mid"), F.col("least").alias("end")), "mid", "left").select("comp", F.coalesce("end", "mid").alias("new"))
        labels = scratch.write(labels.join(jumped, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
