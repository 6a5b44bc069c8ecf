"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is joins and grouped minima on Spark; each round's edges are written to the shared folder, so no
lineage grows and a lost executor costs one round at most. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import discard, joined_with_hot_keys, materialize


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's greater (large) or smaller (small) neighbours to the least of its neighbourhood. A node of very many neighbours does not meet them in one task."""
    both = edges if not large else edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = joined_with_hot_keys(both, low, "u", "n", 2 * total)
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the least node reachable.

    Self-loops and repeated edges change nothing; an empty table gives an empty table; null ends are dropped.
    """
    edges = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    seen, total = None, edges.count()
    for _ in range(max_rounds):
        large = materialize(_star(edges, True, total).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        after = _star(large, False, total)
        before, edges = edges, materialize(after, "edges")
        discard(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen, total = tuple(now), now[0]
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
