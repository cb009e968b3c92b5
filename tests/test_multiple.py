"""Multiple alignment against the same merges done one after the other, and against known families."""

import random
from itertools import combinations

import numpy as np
import pytest

from mobilome.functions import alignment_kernels as A
from mobilome.operators import multiple
from tests.test_alignment_search import mutated, plain_score, protein


@pytest.mark.parametrize("seed", range(8))
def test_column_paths_are_global_alignments(seed):
    rng = random.Random(seed)
    a = protein(rng.randrange(1, 40), rng)
    b = mutated(a, rng, 4, 2) or "A"
    x, y = A.encoded(a), A.encoded(b)
    scores = A.substitution_matrix()[:21, :21][x][:, y].astype(float)
    at, to, score = A.column_path(scores)
    assert score == plain_score(a, b, False)
    assert np.array_equal(A.column_scores(multiple._single(a), multiple._single(b)), scores)
    assert (np.diff(at) > 0).all() and (np.diff(to) > 0).all()


def test_merged_groups_keep_their_columns():
    rng = random.Random(2)
    a, b = protein(30, rng), protein(25, rng)
    counts, where_a, where_b = multiple.merged(multiple._single(a), multiple._single(b))
    assert (np.diff(where_a) > 0).all() and (np.diff(where_b) > 0).all() and set(where_a) | set(where_b) == set(range(len(counts)))
    assert (counts.sum(1) == 2).all()


def plain(sequences):
    """The same progressive merges with whole rows, pair by pair."""
    groups = [[s] for s in sequences]
    while len(groups) > 1:
        nxt = []
        for i in range(0, len(groups) - 1, 2):
            one, two = groups[i], groups[i + 1]
            sides = []
            for g in (one, two):
                c = np.zeros((len(g[0]), 22))
                for s in g:
                    for j, x in enumerate(s):
                        c[j, 21 if x == "-" else A.RESIDUES.index(x)] += 1
                sides.append(c)
            counts, wa, wb = multiple.merged(*sides)
            rows = []
            for g, w in ((one, wa), (two, wb)):
                for s in g:
                    r = ["-"] * len(counts)
                    for j, x in enumerate(s):
                        r[w[j]] = x
                    rows.append("".join(r))
            nxt.append(rows)
        groups = nxt + ([groups[-1]] if len(groups) % 2 else [])
    return groups[0] if groups else []


def sum_of_pairs(rows):
    scores = A.substitution_matrix()
    total = 0
    for a, b in combinations(rows, 2):
        total += sum(int(scores[A.RESIDUES.index(x), A.RESIDUES.index(y)]) for x, y in zip(a, b) if x != "-" and y != "-")
    return total


def test_the_merges_of_one_machine(spark):
    rng = random.Random(7)
    rows = []
    for f, n in (("a", 7), ("b", 4), ("c", 1), ("d", 2), ("e", 9)):
        base = protein(rng.randrange(40, 80), rng)
        rows += [(f, f"{f}{i}", mutated(base, rng, 8, 2)) for i in range(n)]
    rows += [(None, "x", "ACD"), ("a", None, "ACD"), ("a", "y", None), ("a", "z", ""), rows[0]]
    frame = spark.createDataFrame(rows, "kind string, name string, s string").repartition(4)
    order = sorted((r.family, r.place, r.id, r.sequence) for r in multiple.ordered_members(frame, "kind", "name", "s").collect())
    got = {}
    for r in multiple.align_families(frame, "kind", "name", "s").collect():
        got.setdefault(r.family, []).append((r.id, r.aligned))
    for f in "abcde":
        own = [(i, s) for fam, _, i, s in order if fam == f]
        want = plain([s for _, s in own])
        assert sorted(got[f]) == sorted((i, w) for (i, _), w in zip(own, want))
        # Residues of one ancestor stand in one column: far better than rows set side by side.
        if len(own) > 2:
            width = max(len(s) for _, s in own)
            assert sum_of_pairs(want) > sum_of_pairs([s.ljust(width, "-") for _, s in own])
    assert set(got) == set("abcde") and len(got["a"]) == 8
    for r in multiple.pair_scores(multiple.align_families(frame.filter("kind = 'd'"), "kind", "name", "s")).collect():
        one, two = (x for _, x in sorted(got["d"]))
        assert (r.members, r.columns, r.conserved) == (2, len(one), sum(x == y != "-" for x, y in zip(one, two)))


def test_no_members(spark):
    assert multiple.align_families(spark.createDataFrame([], "f string, i string, s string"), "f", "i", "s").count() == 0
