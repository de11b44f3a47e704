"""Connected components of a distributed edge list: big-star and small-star rounds until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Connect each node's neighbours to the least of them; hot nodes are pre-aggregated, and joined by keys AQE can split."""
    if small:  # each node with its smaller neighbours
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:  # each node with its larger neighbours, by the least of all
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = arcs.join(least, "u")
    if small:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    else:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it reaches.

    ``edges`` has two columns of one ordered type.  The number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder; a round that changes nothing ends the work.
    """
    a, b = edges.columns
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), label)
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stored(_star(_star(now, small=False), small=True), label)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
