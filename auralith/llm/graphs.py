"""Connected components of an edge table by alternating star contractions.

Each round replaces every node's links by links to the smallest node it has seen (large star, then small star). The
number of rounds grows with the logarithm of the component size, a round is two aggregations and two joins on node
ids, and every round is stored, so no task or driver ever holds a component. Minima are pre-aggregated before the
shuffle and the joins are left to adaptive skew splitting, so a node with very many links is no single-task key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.llm.store import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. ``edges``: (a, b) with a > b. Returns edges of the same form."""
    if large:  # link every larger neighbour to the smallest neighbour (or the node itself)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # link the node and its smaller neighbours to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long; any order, repeats and loops allowed) -> (node, component): component is the smallest
    node id reachable. Nodes without a link to another node are not returned."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:  # contraction is idempotent only on a forest of stars
            break
        seen = state
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
