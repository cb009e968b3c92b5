"""Alignment kernels against plain dynamic programming, and the search against full Smith-Waterman."""

import random

import pytest
from pyspark.sql import functions as F

from mobilome.functions import alignment_kernels as A


def protein(n, rng):
    return "".join(rng.choices(A.RESIDUES[:20], A.BACKGROUND, k=n))


def mutated(s, rng, changes, gaps):
    s = list(s)
    for _ in range(changes):
        s[rng.randrange(len(s))] = rng.choice(A.RESIDUES[:20])
    for _ in range(gaps):
        at = rng.randrange(len(s))
        s[at : at + rng.choice([0, 1, 3])] = rng.choices(A.RESIDUES[:20], k=rng.choice([0, 1, 2]))
    return "".join(s)


def plain_score(a, b, local, opening=A.OPEN, extending=A.EXTEND):
    """Three plain tables."""
    scores, far = A.substitution_matrix(), -(10**9)
    x, y = A.encoded(a), A.encoded(b)
    n, m = len(x), len(y)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    u, l = ([[far] * (m + 1) for _ in range(n + 1)] for _ in range(2))
    best = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            if i:
                u[i][j] = max(h[i - 1][j] - opening, u[i - 1][j] - extending)
            if j:
                l[i][j] = max(h[i][j - 1] - opening, l[i][j - 1] - extending)
            d = h[i - 1][j - 1] + int(scores[x[i - 1], y[j - 1]]) if i and j else far
            h[i][j] = max(d, u[i][j], l[i][j])
            if local:
                h[i][j] = max(0, h[i][j])
                best = max(best, h[i][j])
    return best if local else h[n][m]


def score_of(a, b, found, opening=A.OPEN, extending=A.EXTEND):
    """What an alignment's columns score, counted anew."""
    scores, x, y = A.substitution_matrix(), A.encoded(a), A.encoded(b)
    total, i, j = 0, found.q_start, found.t_start
    for p, q in [*zip(found.q_at, found.t_at), (found.q_end, found.t_end)]:
        for gap in (p - i, q - j):
            total -= opening + (gap - 1) * extending if gap else 0
        if p < found.q_end and q < found.t_end or len(found.q_at) and (p, q) == (found.q_at[-1], found.t_at[-1]):
            total += int(scores[x[p], y[q]])
        i, j = p + 1, q + 1
    return total


@pytest.mark.parametrize("local", [True, False])
def test_scores_are_the_plain_ones(local, monkeypatch):
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        a = protein(rng.randrange(1, 50), rng)
        pairs.append((a, mutated(a, rng, rng.randrange(6), rng.randrange(4)) if rng.random() < 0.7 else protein(rng.randrange(1, 50), rng)))
    pairs = [(a, b) for a, b in pairs if b]
    for cells in (10**7, 3000):
        monkeypatch.setattr(A, "CELLS", cells)
        found = A.align_pairs([A.encoded(a) for a, _ in pairs], [A.encoded(b) for _, b in pairs], local)
        assert [f.score for f in found] == [plain_score(a, b, local) for a, b in pairs]
    for (a, b), f in zip(pairs, found):
        assert score_of(a, b, f) == f.score, (a, b)
        if not local:
            assert (f.q_start, f.q_end, f.t_start, f.t_end) == (0, len(a), 0, len(b))


def test_empty_sequences():
    found = A.align_pairs([A.encoded(""), A.encoded("ARN")], [A.encoded("AR"), A.encoded("")], False)
    assert [f.score for f in found] == [-A.OPEN - A.EXTEND, -A.OPEN - 2 * A.EXTEND]
    assert A.align_pairs([A.encoded("")], [A.encoded("AR")])[0].score == 0


@pytest.mark.parametrize("word", ["WCH", "ARND", "LLX"])
def test_neighbours_by_trying_all_words(word):
    from itertools import product

    scores = A.substitution_matrix()
    own = A.encoded(word)
    want = {"".join(w) for w in product(A.RESIDUES[:20], repeat=len(word)) if sum(int(scores[x, y]) for x, y in zip(own, A.encoded("".join(w)))) >= 11}
    assert set(A.neighbours(word, 11)) == (want | {word} if "X" not in word else {word})


def test_statistics_follow_random_scores():
    rate, k = A.statistics()
    assert 0.15 < rate < 0.5 and 0.001 < k < 1
    rng = random.Random(2)
    pairs = [(A.encoded(protein(200, rng)), A.encoded(protein(200, rng))) for _ in range(200)]
    scores = [f.score for f in A.align_pairs(*map(list, zip(*pairs)))]
    # Of random pairs, about one in twenty has an expected number of 0.05 or less.
    small = sum(200 * 200 * 2 ** -A.bits(s) <= 0.05 for s in scores) / len(scores)
    assert 0.005 < small < 0.15


def families(rng, n_families=6, members=7):
    """{id: sequence} of families with substitutions and gaps, some as a domain in a longer protein, and strangers."""
    out = {}
    for f in range(n_families):
        base = protein(rng.randrange(90, 220), rng)
        for m in range(members):
            s = mutated(base, rng, rng.choice([0, 5, 20, len(base) // 3]), rng.choice([0, 1, 4]))
            out[f"f{f}_{m}"] = s if m % 3 else protein(rng.randrange(40), rng) + s + protein(rng.randrange(150), rng)
    return out | {f"x{i}": protein(rng.randrange(1, 200), rng) for i in range(25)}


def test_search_finds_what_full_alignment_finds(spark):
    from mobilome.operators import alignment

    found = families(random.Random(1))
    rows = [*found.items(), ("f0_0", found["f0_0"]), (None, found["f0_1"]), ("empty", ""), ("null", None)]
    frame = spark.createDataFrame(rows, "id string, sequence string").repartition(3)
    got = {(r["query"], r["target"]): r for r in alignment.search(frame, frame).collect()}
    names = list(found)
    pairs = [(a, b) for a in names for b in names]
    full = A.align_pairs([A.encoded(found[a]) for a, _ in pairs], [A.encoded(found[b]) for _, b in pairs])
    residues = sum(map(len, found.values()))
    want = {}
    for (a, b), f in zip(pairs, full):
        expected = len(found[a]) * residues * 2 ** -A.bits(f.score)
        if expected <= 1e-3:
            want[a, b] = f
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 250
    equal = sum(got[p].score == want[p].score for p in got)
    assert equal >= 0.99 * len(got)
    for p, r in got.items():
        if r.score == want[p].score:
            f = want[p]
            same = sum(found[p[0]][i] == found[p[1]][j] for i, j in zip(f.q_at, f.t_at))
            assert (r.q_start, r.q_end, r.t_start, r.t_end, r.alnlen) == (f.q_start, f.q_end, f.t_start, f.t_end, f.columns) and r.fident == same / f.columns
    assert all(p in got and got[p].fident == 1 for p in ((n, n) for n in names if len(found[n]) > 60))
    # The best hits, by shards and by sorting.
    best = {(r["query"], r["target"]) for r in alignment.best_hits(alignment.search(frame, frame), 2, 5).collect()}
    order = {}
    for (a, b), r in sorted(got.items(), key=lambda x: (x[0][0], -x[1].bits, x[0][1])):
        order.setdefault(a, []).append(b)
    assert best == {(a, b) for a, bs in order.items() for b in bs[:2]}


def test_clusters_by_alignment(spark):
    from mobilome.operators import alignment

    rng = random.Random(4)
    bases = [protein(150, rng) for _ in range(3)]
    rows = [(f"c{i}_{j}", mutated(b, rng, 20, 1)) for i, b in enumerate(bases) for j in range(4)] + [("c0_copy", bases[0]), ("c0_copy2", bases[0].lower()), ("lone", protein(150, rng)), ("no", None)]
    frame = spark.createDataFrame(rows, "name string, s string")
    got = {r.id: r.component for r in alignment.alignment_clusters(frame, "name", "s").collect()}
    assert len(got) == len(rows) and got["lone"] == "lone" and got["no"] == "no"
    for i in range(3):
        assert {got[n] for n in got if n.startswith(f"c{i}")} == {min(n for n in got if n.startswith(f"c{i}"))}
    named = {r.name: (r.cluster_size, r.representative) for r in alignment.named_clusters(frame.filter("s IS NOT NULL"), "name", "s").collect()}
    assert named["c0_0"][0] == 6 and named["lone"] == (1, "lone")


def test_no_sequences(spark):
    from mobilome.operators import alignment

    none, some = spark.createDataFrame([], "id string, sequence string"), spark.createDataFrame([("a", "ACDEFGHIKLMNPQRSTVWY" * 3)], "id string, sequence string")
    assert alignment.search(none, some).count() == alignment.search(some, none).count() == 0
    assert alignment.search(some, some).count() == 1


def test_hits_found_over_any_shift(spark):
    """A hit in a target that is much longer than the query, beyond the first residues, and with a gap."""
    from mobilome.operators import alignment

    rng = random.Random(8)
    base = protein(120, rng)
    target = protein(5000, rng) + base[:60] + protein(5, rng) + base[60:] + protein(3000, rng)
    frame = [spark.createDataFrame([(n, s)], "id string, sequence string") for n, s in (("q", base), ("t", target))]
    r = alignment.search(*frame).collect()[0]
    full = A.align_pairs([A.encoded(base)], [A.encoded(target)])[0]
    assert (r.score, r.t_start, r.t_end, r.q_start, r.q_end) == (full.score, full.t_start, full.t_end, full.q_start, full.q_end) and r.qcov == 1


def test_stretches_of_tiles_are_those_of_all_hits(monkeypatch):
    import random
    from collections import defaultdict

    import numpy as np

    from mobilome.functions import alignment_kernels as kernels

    rng = random.Random(3)
    base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYXBé") for _ in range(150))
    seqs = ["", "ACD", base[:90], base[30:] + base[:50], base[10:140], base[:90], "AAAACCCC" * 5]
    owner = np.array([0, 1, 2, 2, 4, 5, 6])  # the third and fourth are one id
    want = defaultdict(set)
    for i, q in enumerate(seqs):
        for j, t in enumerate(seqs):
            for a in range(len(q) - 3):
                for b in range(len(t) - 3):
                    if q[a : a + 4] == t[b : b + 4] and len(set(q[a : a + 4])) > 2:
                        for v in (a // 40 - 1, a // 40):
                            want[int(owner[i]), int(owner[j]), b - a, v].add(a)
    want = {k + (min(v), max(v), len(v)) for k, v in want.items() if max(v) - min(v) >= 4}
    for most in (1, 200, 10**6):
        monkeypatch.setattr(kernels, "HITS", most)
        got = [tuple(map(int, r)) for x in kernels.stretches(seqs, seqs, 4, 40, None, (owner, owner)) for r in zip(*x)]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_sequences_are_shuffled_for_the_word_search(spark):
    from mobilome.operators import alignment

    p = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY" * 3) for i in range(30)], "id long, sequence string")
    found = alignment.seed_diagonals(p, p, near=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate" not in plan
    assert found.select("query", "target").distinct().count() == 900


@pytest.mark.parametrize("letters", ["ACDEFGHIKLMNPQRSTVWYX", "AX", "WC"])
def test_antidiagonals_give_the_alignments_of_rows(letters):
    """The same spans and columns, ties included, over batches of any size and scores beyond 16 bits."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices(letters, k=n))
    pairs = []
    for _ in range(150):
        a = word(rng.randrange(60))
        b = a[: rng.randrange(61)] + word(rng.randrange(6)) + a[rng.randrange(61) :]
        pairs.append((a, b if rng.random() < 0.8 else word(rng.randrange(80))))
    long = word(1600)
    for some in (pairs, [(long, long[:700] + long[730:])]):
        q, t = ([A.encoded(x) for x in side] for side in zip(*some))
        for x, y in zip(A._align_local(q, t, A.OPEN, A.EXTEND), A._align(q, t, True, A.OPEN, A.EXTEND)):
            assert (x.score, x.q_start, x.q_end, x.t_start, x.t_end) == (y.score, y.q_start, y.q_end, y.t_start, y.t_end)
            assert list(x.q_at) == list(y.q_at) and list(x.t_at) == list(y.t_at)


def test_a_region_is_aligned_once(spark):
    """Hits in the common half of two bands are one region, not two."""
    from mobilome.operators import alignment

    seeds = spark.createDataFrame([(1, 2, 0, 5, 30, 9), (1, 2, 3, 40, 60, 4), (1, 3, 0, 5, 30, 9), (1, 3, 100, 5, 30, 3)], "query int, target int, diagonal int, q_first int, q_last int, hits long")
    got = sorted(tuple(r) for r in alignment.regions(seeds).collect())
    assert got == [(1, 2, 5, 64, 0, 3), (1, 3, 5, 34, 0, 0), (1, 3, 5, 34, 0, 100)]


def test_codes_of_neighbours():
    rng = random.Random(2)
    for k, least in ((4, 17), (3, 11), (5, 22), (4, 40)):
        for _ in range(20):
            w = "".join(rng.choices(A.RESIDUES[:20], k=k))
            got = A.neighbour_codes(w, least).tolist()
            assert len(got) == len(set(got)) and set(got) == {A.word_code(x) for x in A.neighbours(w, least)}


def test_regions_of_a_tile_are_those_of_the_tables(spark):
    import numpy as np

    from mobilome.operators import alignment

    rng = random.Random(4)
    rows = sorted({(rng.randrange(4), rng.randrange(4), rng.randrange(-300, 300), rng.randrange(6) * 20) for _ in range(200)})
    rows = [(q, t, d, f, f + rng.choice((5, 30)), rng.randrange(2, 5)) for q, t, d, f in rows]
    seeds = spark.createDataFrame(rows, "query int, target int, diagonal int, q_first int, q_last int, hits long")
    got = A.pair_regions(*(np.array(c, np.int64) for c in zip(*rows)), 4, 64, 2)
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(tuple(r) for r in alignment.regions(seeds).collect())


def test_linking_edges_connect_what_all_hits_connect(spark):
    """With fewer alignments: alike proteins are linked to one of them, not in all pairs, and nothing else is lost."""
    from mobilome.operators import alignment
    from mobilome.operators.components import connected_components

    rng = random.Random(9)
    bases = [protein(120, rng) for _ in range(3)]
    rows = [(f"p{i}_{j}", mutated(b, rng, 4 if j % 2 else 45, 1)) for i, b in enumerate(bases) for j in range(24)] + [("x", "ACD"), ("y", None), ("z", "W" * 50)]
    frame = spark.createDataFrame(rows, "id string, sequence string")
    apart = F.col("query") < F.col("target")
    hits = alignment.search(frame, frame, apart=apart).select(F.col("query").alias("src"), F.col("target").alias("dst"))
    some = alignment.linking_edges(frame, lambda h: h, apart=apart)
    parts = lambda e: {(r.node, r.component) for r in connected_components(e).collect()}
    assert parts(some) == parts(hits) and some.exceptAll(hits).isEmpty() and some.count() < hits.count() / 2
