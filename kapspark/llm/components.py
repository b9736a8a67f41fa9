"""Connected components of an edge table, without a driver-side graph.

Alternating large-star and small-star steps: each step is one aggregation by
node (minimum of the neighbours, with map-side partial minima) and one join back.
A hub's edges, two longs each, meet its minimum in one task: the minimum is not stored
first, so Spark cannot split that join. Every round is written to the shared folder, so
lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

MAX_ROUNDS = 60


def _minima(pairs: DataFrame) -> DataFrame:
    """pairs (node, other) with `low`: the smallest of node and all its others."""
    low = pairs.groupBy("node").agg(F.min("other").alias("low"))
    return pairs.join(low.hint("shuffle_merge"), "node").withColumn("low", F.least("low", "node"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    return _minima(both).filter("other > node").select(F.col("other").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _minima(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
    moved = hung.select(F.col("other").alias("u"), F.col("low").alias("v")).unionByName(
        hung.select(F.col("node").alias("u"), F.col("low").alias("v"))
    )
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node with an edge, the smallest node it can reach."""
    current = staged(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        current = staged(_small_star(_large_star(current)), "edges")
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
