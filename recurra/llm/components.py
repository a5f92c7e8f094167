"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c) for every vertex of edges(a, b): c is the smallest vertex reachable from v.

    Each round every vertex takes the smallest label of its neighbours and itself (minima are pre-aggregated before
    the exchange, so a vertex of very many edges is no heavy task), then its label's label, which doubles the reach of
    labels; rounds end when no label changes. Labels of a round are a written table, so nothing is kept in executors.
    """
    both = scratch.save(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).where("v <> w").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")).where("v <> w")).distinct())
    labels = scratch.save(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "c"), "w").select("v", "c")
        least = near.unionByName(labels).groupBy("v").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = scratch.save(least.join(jump, "c").select("v", F.least("c", "cc").alias("c")).join(labels.withColumnRenamed("c", "old"), "v"))
        changed = new.where("c <> old").limit(1).count()
        scratch.drop(labels)
        if not changed:
            scratch.drop(both)
            return new.select("v", "c")
        labels = new.select("v", "c")
        labels._scratch_path = new._scratch_path
