"""Connected components by alternating large-star and small-star rounds.

Every round is two shuffles of the edges keyed by node, pre-aggregated to the
smallest neighbour, so that a hub is a skewed join side that adaptive execution
can split and never a collected group.  Each round is written to the shared
folder: lineage stays short and lost executors cost one round at most; the
table of the round before is removed.

Nodes may be of any type that has an order, structs included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("k"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).filter("b > m")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node whose component has a smaller node.

    ``component`` is the smallest node reachable.  Nodes that are missing are
    their own component.  Self-loops, repeated edges and edges with a null end
    have no effect.
    """
    a, b = F.col(src), F.col(dst)
    current = materialize(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen or mark[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        before, current = current, materialize(_small_star(_large_star(current)), "edges")
        discard(before)
