"""Connected components of an edge table by alternating star operations.

Every node is led to the smallest node it can reach. Each round regroups edges around
smaller neighbours (large star, small star); the number of rounds grows with the
logarithm of a component's size. Neighbour lists are never gathered: each star is one
pre-aggregated minimum and one join, so a node with millions of neighbours is rows like
any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import forget, keep_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest reachable node.

    Self edges, repeated edges and edges with a null end are harmless; nodes that only
    have such edges are not listed. No edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    pairs, path = keep_at(pairs, "edges")
    state = _state(pairs)
    while state[0]:
        changed, new_path = keep_at(_small_star(_large_star(pairs)), "edges")
        new_state = _state(changed)
        forget(spark, path)
        pairs, path = changed, new_path
        if new_state == state:
            break
        state = new_state
    # At the fixed point every v points at its component's smallest node.
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(
        pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each node, linked to its smallest neighbour (or itself)."""
    both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(
        pairs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    lowest = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"))
    linked = both.where("y > x").join(lowest, "x").select(F.col("y").alias("v"), F.col("low").alias("u"))
    return linked.where("v <> u").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Smaller neighbours of each node and the node itself, linked to the smallest."""
    lowest = pairs.groupBy("v").agg(F.min("u").alias("low"))
    linked = pairs.join(lowest, "v").select(F.col("u").alias("v"), F.col("low").alias("u"))
    return linked.unionAll(lowest.select("v", F.col("low").alias("u"))).where("v <> u").distinct()
