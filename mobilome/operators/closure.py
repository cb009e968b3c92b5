"""A split of clusters without similar pairs across its parts: split, search across, merge, and again.

Each round searches only pairs that it has not searched before: a vertex carries the parts it was in so far, and two vertices
are new to each other if they are apart now and were together in all rounds before.  Pairs that violate the rule join their clusters, and only the
labels of clusters that new edges touch are looked at again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.operators.alignment import linking_edges
from mobilome.operators.components import connected_components
from mobilome.operators.datasets import cluster_split
from mobilome.storage import discard, materialize


def new_to_each_other(a: Column, b: Column) -> Column:
    """Whether histories (arrays of parts, one a round) differ for the first time in the last round."""
    before = F.size(a) - 1
    return (F.element_at(a, -1) != F.element_at(b, -1)) & (F.slice(a, F.lit(1), before) == F.slice(b, F.lit(1), before))


def close_edges(
    vertices: DataFrame, edges: DataFrame, split: Callable[[DataFrame], DataFrame], find: Callable[[DataFrame], DataFrame], id_col: str, most: int = 50
) -> DataFrame:
    """``vertices`` with ``component``, ``split`` and ``history``, where no pair that ``find`` reports is apart.

    ``edges`` (src, dst) are the clusters to begin with.  ``split`` gets vertices with ``component`` and adds ``split``, the same for a whole component;
    ``find`` gets (id, history) and gives the violating pairs (src, dst) among those that are ``new_to_each_other``.  Null ids take no part.
    """
    stars = connected_components(edges)
    rows = vertices.filter(F.col(id_col).isNotNull())
    rooted = rows.join(stars, F.col(id_col) == F.col("node"), "left").withColumn("component", F.coalesce("component", F.col(id_col))).drop("node")
    current = materialize(rooted.withColumn("history", F.array().cast("array<string>")), "closure")
    for _ in range(most):
        before, current = current, materialize(split(current).withColumn("history", F.concat("history", F.array(F.col("split").cast("string")))), "closure")
        discard(before)
        bad = materialize(find(current.select(F.col(id_col).alias("id"), "history")).select("src", "dst"), "closure-violations")
        if bad.isEmpty():
            return current
        # Edges between labels: as many as violations, whatever the clusters hold.
        label = current.select(F.col(id_col).alias("_id"), F.col("component").alias("_label"))
        one = bad.join(label, F.col("src") == F.col("_id")).select("dst", F.col("_label").alias("_a"))
        joined = one.join(label, F.col("dst") == F.col("_id")).select(F.col("_a").alias("src"), F.col("_label").alias("dst"))
        moved = connected_components(joined).select(F.col("node").alias("_node"), F.col("component").alias("_to"))
        merged = current.drop("split").join(moved, F.col("component") == F.col("_node"), "left")
        merged = merged.withColumn("component", F.coalesce("_to", "component")).drop("_node", "_to")
        before, current = current, materialize(merged, "closure")
        discard(before)
    raise RuntimeError(f"violations remain after {most} rounds")


def closed_split(
    proteins: DataFrame, id_col: str, sequence: str, stratum: str, edges: DataFrame | None = None, identity: float = 0.30, coverage: float = 0.80, **options
) -> DataFrame:
    """(id, stratum, component, split, history): proteins split by clusters until no two of different parts are alike over both coverages.

    Without ``edges`` clusters begin as single proteins; only what a split parts is searched and merged.
    """
    rows = proteins.select(F.col(id_col).alias("id"), F.col(sequence).alias("_sequence"), F.col(stratum).alias("stratum"))
    text = materialize(rows.select(F.col("id").alias("_i"), "_sequence").filter("_i IS NOT NULL AND _sequence IS NOT NULL"), "closure-texts")
    edges = rows.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0) if edges is None else edges

    def find(found: DataFrame) -> DataFrame:
        own = found.join(text, F.col("id") == F.col("_i")).select(F.struct("id", "history").alias("id"), F.col("_sequence").alias("sequence"))
        apart = (F.col("query.id") < F.col("target.id")) & new_to_each_other(F.col("query.history"), F.col("target.history"))
        bad = (F.col("fident") >= identity) & (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage)
        # Only what violations connect counts, so not all of them are looked for.
        return linking_edges(own, lambda hits: hits.filter(bad), apart=apart, node=lambda c: c["id"], kind=F.col("id.history"), **options)

    split = lambda found: cluster_split(found, "component", "stratum")
    return close_edges(rows.drop("_sequence"), edges, split, find, "id")
