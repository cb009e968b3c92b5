"""The closure loop against starting anew each round, and what it searches."""

import random

import pytest
from pyspark.sql import functions as F

from mobilome.operators import closure, datasets
from tests.test_alignment_search import mutated, protein


def components(n, edges):
    root = list(range(n))
    for a, b in sorted(edges):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def split_of(frame):
    return datasets.cluster_split(frame, "component", "kind")


def plain(spark, n, kinds, edges, violations):
    """Everything anew in every round: all clusters, and all pairs apart."""
    edges, rounds = set(edges), 0
    while True:
        rounds += 1
        root = components(n, edges)
        frame = spark.createDataFrame([(i, kinds[i], root[i]) for i in range(n)], "id long, kind string, component long")
        part = {r.id: r.split for r in split_of(frame).collect()}
        bad = {(a, b) for a, b in violations if part[a] != part[b]}
        if not bad:
            return root, part, rounds
        edges |= bad


@pytest.mark.parametrize("seed", range(2))
def test_the_result_of_starting_anew(spark, seed):
    rng = random.Random(seed)
    n = 60
    kinds = [rng.choice("xy") for _ in range(n)]
    pairs = lambda k: {tuple(sorted(rng.sample(range(n), 2))) for _ in range(k)}
    edges, violations = pairs(12), pairs(25)
    vertices = spark.createDataFrame([*((i, kinds[i]) for i in range(n)), (None, "x")], "id long, kind string")
    known = spark.createDataFrame([*violations], "a long, b long")
    searched = []

    def find(found):
        x, y = (found.select(F.col("id").alias(c), F.col("history").alias(f"h{c}")) for c in "ab")
        met = known.join(x, "a").join(y, "b").filter(closure.new_to_each_other(F.col("ha"), F.col("hb")))
        got = met.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        searched.extend(tuple(r) for r in got.collect())
        return got

    start = spark.createDataFrame([*edges], "src long, dst long")
    got = {r.id: (r.component, r.split) for r in closure.close_edges(vertices, start, split_of, find, "id").collect()}
    root, part, rounds = plain(spark, n, kinds, edges, violations)
    assert got == {i: (root[i], part[i]) for i in range(n)} and rounds > 1
    assert all(part[a] == part[b] for a, b in violations)
    assert len(searched) == len(set(searched))  # no pair is found twice


def test_new_to_each_other(spark):
    cases = [(["a"], ["b"], True), (["a"], ["a"], False), (["a", "b"], ["a", "c"], True), (["a", "b"], ["c", "b"], False), (["a", "b"], ["c", "d"], False)]
    frame = spark.createDataFrame([(x, y, w) for x, y, w in cases], "x array<string>, y array<string>, w boolean")
    assert frame.filter(closure.new_to_each_other(F.col("x"), F.col("y")) != F.col("w")).count() == 0


def test_alike_proteins_end_in_one_part(spark):
    rng = random.Random(3)
    bases = [protein(130, rng) for _ in range(5)]
    rows = [(f"p{i}_{j}", mutated(b, rng, 15, 1), f"k{i % 2}") for i, b in enumerate(bases) for j in range(4)]
    found = closure.closed_split(spark.createDataFrame(rows, "name string, s string, kind string"), "name", "s", "kind").collect()
    assert len(found) == len(rows)
    for i in range(5):
        assert len({r.split for r in found if r.id.startswith(f"p{i}_")}) == 1
    assert len({r.split for r in found}) > 1
