"""Profile models: paths by enumeration, counts by hand, and planted families found again."""

import random

import numpy as np
import pytest

from mobilome.functions import alignment_kernels as A
from mobilome.functions import profile_kernels as P
from mobilome.operators import profiles
from mobilome.storage import materialize
from tests.test_alignment_search import mutated, protein


def all_paths(model, x):
    """The best score by walking every path."""
    best, size, m = -np.inf, len(model), model.moves
    entry = -np.log2(size)

    def walk(state, j, i, score):
        nonlocal best
        if state == "M":
            best = max(best, score)
        moves = {"M": (("M", P.MM), ("I", P.MI), ("D", P.MD)), "I": (("M", P.IM), ("I", P.II)), "D": (("M", P.DM), ("D", P.DD))}[state]
        for to, move in moves:
            s = score + m[j, move]
            if to == "I" and i < len(x):
                walk("I", j, i + 1, s)
            elif to == "M" and i < len(x) and j + 1 < size:
                walk("M", j + 1, i + 1, s + model.match[j + 1, x[i]])
            elif to == "D" and j + 1 < size:
                walk("D", j + 1, i, s)

    for i in range(len(x)):
        for j in range(size):
            walk("M", j, i + 1, entry + model.match[j, x[i]])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_paths_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros((rng.integers(1, 5), 27))
    counts[:, :20] = rng.integers(0, 4, (len(counts), 20)) * (rng.random((len(counts), 20)) < 0.2)
    counts[:, 20:] = rng.integers(0, 30, (len(counts), 7))
    model = P.estimated(counts)
    proteins = [rng.integers(0, 21, rng.integers(1, 6)).astype(np.uint8) for _ in range(12)]
    bits, start, end = P.best_paths(model, proteins)
    for b, s, e, x in zip(bits, start, end, proteins):
        assert b == pytest.approx(all_paths(model, x), abs=1e-4)
        assert 0 <= s < e <= len(x) and all_paths(model, x[s:e]) == pytest.approx(b, abs=1e-4)
    # The packed form is the model.
    again = P.unpacked(model.packed())
    assert np.array_equal(again.match, model.match) and np.array_equal(again.moves, model.moves)


def test_chances_add_up():
    model = P.estimated(np.zeros((3, 27)))
    assert np.allclose((2.0 ** model.match[:, :20] * A.BACKGROUND).sum(1), 1)
    for own in ((P.MM, P.MI, P.MD), (P.IM, P.II), (P.DM, P.DD)):
        assert np.allclose((2.0 ** model.moves[:, own]).sum(1), 1)


def test_words_by_scoring_all():
    rng = np.random.default_rng(3)
    counts = np.zeros((5, 27))
    counts[np.arange(5), rng.integers(0, 20, 5)] = 9
    model = P.estimated(counts)
    got = set(P.words(model, 2, 4.0, 20))
    want = {
        (j, a + b) for j in range(4) for a in A.RESIDUES[:20] for b in A.RESIDUES[:20]
        if np.float32(model.match[j, A.RESIDUES.index(a)] + model.match[j + 1, A.RESIDUES.index(b)]) >= 4.0
    }
    assert got == want and want


def test_events_of_one_member():
    # Columns 0 1 2 3 4 5 of the centre are kept but for 3; the member skips 1 and has two residues between 4 and 5.
    at, kind = profiles._events(np.array([0, 1, 2, 4, 5]), np.array([0, 2, 4, 5]), np.array([0, 1, 2, 5]), A.encoded("ARNDCQ"))
    found = sorted(zip(at.tolist(), kind.tolist()))
    move = lambda j, m: (j, 20 + m)
    assert found == sorted([(0, 0), (2, 1), (3, 2), (4, 5), move(0, P.MD), move(1, P.DM), move(2, P.MM), move(3, P.MI), move(3, P.II), move(3, P.IM)])


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    bases = {f"IS{i}": protein(rng.randrange(80, 160), rng) for i in range(4)}
    train = [(f"{f}_{j}", f, mutated(b, rng, len(b) // 4, 2)) for f, b in bases.items() for j in range(8)]
    test = [(f"t{f}_{j}", f, protein(rng.randrange(60), rng) + mutated(b, rng, len(b) // 3, 2) + protein(rng.randrange(60), rng)) for f, b in bases.items() for j in range(6)]
    none = [(f"n{i}", None, protein(rng.randrange(50, 250), rng)) for i in range(60)]
    return train, test, none


def test_planted_families_are_found(spark, planted):
    train, test, none = planted
    schema = "name string, kind string, s string"
    rows = [*train, ("few1", "two", "ACDEFGHIKL"), ("few2", "two", "ACDEFGHIKL"), ("z", "IS0", None), (None, "IS0", "ACD"), ("y", None, "ACDEFGH")]
    models = materialize(profiles.profile_models(spark.createDataFrame(rows, schema).repartition(3), "kind", "name", "s"), "test-models")
    found = {r.family: r for r in models.collect()}
    assert set(found) == {"IS0", "IS1", "IS2", "IS3"} and all(r.members == 8 for r in found.values())
    for f, r in found.items():
        base = next(len(s) for n, k, s in train if k == f)
        assert abs(r.length - base) < 0.1 * base
    queries = spark.createDataFrame([*test, *none, ("empty", None, ""), ("null", None, None)], schema).repartition(3)
    best = {r["query"]: r for r in profiles.best_family(profiles.profile_search(queries, models, "name", "s", 1e-2)).collect()}
    right = sum(n in best and best[n].family == f for n, f, _ in test)
    assert right == len(test) and not any(n.startswith("n") for n in best)
    # The filter passes what the whole search finds, with the same scores.
    whole = {(r["query"], r.family): r.bits for r in profiles.profile_search(queries, models, "name", "s", 1e-2, filtered=False).collect()}
    some = {(r["query"], r.family): r.bits for r in profiles.profile_search(queries, models, "name", "s", 1e-2).collect()}
    assert some == pytest.approx(whole)


def test_expected_numbers_hold_for_chance(spark, planted):
    train, _, _ = planted
    rng = random.Random(12)
    models = materialize(profiles.profile_models(spark.createDataFrame(train, "name string, kind string, s string"), "kind", "name", "s"), "test-models")
    strangers = spark.createDataFrame([(f"r{i}", protein(200, rng)) for i in range(300)], "name string, s string")
    n = profiles.profile_search(strangers, models, "name", "s", 3.0, filtered=False).count()
    assert 2 <= n <= 40  # about three a model are expected


def test_rows_and_centres(spark):
    rows = [("a", "f", "ACDEFGHIKLMN"), ("b", "f", "ACDEFGHIKLMN"), ("c", "f", "ACDEGHIKLMN"), ("d", "f", "ACDEFGHWWIKLMN")]
    members = profiles._members(spark.createDataFrame(rows, "id string, family string, sequence string"), "family", "id", "sequence", 3)
    assert profiles.family_centres(members).collect()[0].centre == "ACDEFGHIKLMN"
    got = {r.id: r.row for r in profiles.aligned_rows(profiles.align_to_centres(members)).collect()}
    assert got["a"] == "ACDEFGHIKLMN" and got["c"].replace("-", "") == "ACDEGHIKLMN" and len(got["c"]) == 12 and got["d"].replace("-", "") in ("ACDEFGHIKLMN",)


def test_sub_families(spark):
    rng = random.Random(9)
    a, b = protein(120, rng), protein(120, rng)
    rows = [(f"a{i}", "f", mutated(a, rng, 10, 0)) for i in range(3)] + [(f"b{i}", "f", mutated(b, rng, 10, 0)) for i in range(3)] + [("g", "g", a)]
    got = {r.id: r.sub_family for r in profiles.sub_families(spark.createDataFrame(rows, "id string, kind string, s string"), "kind", "id", "s").collect()}
    assert got["a0"] == got["a1"] == got["a2"] == "f_a0" and got["b0"] == got["b2"] == "f_b0" and got["g"] == "g_g"


def test_a_model_lies_beside_many_proteins(spark):
    """Each protein had a model of its own beside it, so that a batch held thousands of equal models."""
    rows = [(f"p{i}", protein(20 + i % 7, random.Random(i))) for i in range(900)]
    pairs = [(p, f) for f, of in (("a", rows), ("b", rows[:40]), ("c", rows[:1])) for p, _ in of]
    proteins, models = spark.createDataFrame(rows, "query string, sequence string"), spark.createDataFrame([(f, f.encode()) for f in "abc"], "family string, model binary")
    found = profiles.search_rows(materialize(spark.createDataFrame(pairs, "query string, family string"), "t-pairs"), proteins, models).collect()
    assert len(found) <= 6 and max(len(r["query"]) for r in found) < 2 * profiles.ROW_PROTEINS
    known = dict(rows)
    assert all(bytes(r["model"]).decode() == r["family"] and [known[p] for p in r["query"]] == r["sequence"] for r in found)
    assert sorted((p, r["family"]) for r in found for p in r["query"]) == sorted(pairs)


def test_counts_of_many_members(spark):
    """More letters than are held at a time."""
    rng = random.Random(8)
    width, members = 90, 3_000
    texts = [protein(width, rng) for _ in range(members)]
    assert width * members > profiles.LETTERS
    every = list(range(width))
    rows = [("f", str(i), width, every, every, s) for i, s in enumerate(texts)]
    aligned = materialize(spark.createDataFrame(rows, "family string, id string, width int, columns array<int>, places array<int>, sequence string").repartition(1), "t-aligned")
    got = {(r["column"], r["kind"]): r["n"] for r in profiles.profile_counts(aligned).collect()}
    want = {}
    for s in texts:
        for c, k in enumerate(A.encoded(s)):
            want[c, int(k)] = want.get((c, int(k)), 0) + 1
    assert got == want | {(c, 20 + P.MM): members for c in range(width - 1)}


def test_no_proteins(spark):
    none = spark.createDataFrame([], "id string, kind string, s string")
    models = materialize(profiles.profile_models(none, "kind", "id", "s"), "test-models")
    assert models.count() == 0 and profiles.profile_search(none, models, "id", "s").count() == 0
