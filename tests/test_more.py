"""Filters, audits, models, program runners, artifacts, streams and commands on small known cases."""

import glob
import hashlib
import json
import os
import random
import stat
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mobilome import cli
from mobilome.functions import boundary_kernels as K
from mobilome.functions import decisions as D
from mobilome.operators import boundaries, datasets, external, filters, fragments, metrics, models, screening, structures
from mobilome.operators import hits as H
from mobilome.sources import artifacts, fasta, tables
from mobilome.storage import shared_dir


def test_ranks_follow_the_order_whatever_the_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(20)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, s string, n int").repartition(9)
    got = {r.id: r.p for r in datasets.ranked(frame, [F.col("s"), F.col("n").desc(), F.col("id")], "p").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 301))
    assert datasets.ranked(frame.limit(0), [F.col("n")], "p").count() == 0


def test_stratified_split_by_plain_ranks(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("string")).alias("s"))
    got = datasets.stratified_split(rows, "s", "id").collect()
    from hashlib import md5

    groups = {}
    for r in got:
        groups.setdefault(r.s, []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (md5(f"42:{r.id}".encode()).hexdigest(), r.id))
        n = len(own)
        a, b = round(n * 0.7), round(n * 0.7) + round(n * 0.15)
        assert [r.split for r in own] == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_negatives_are_as_many_as_asked_for(spark):
    pool = spark.range(600).select("id", F.when(F.col("id") < 100, "hard").when(F.col("id") < 200, "easy").otherwise("general").alias("kind"), (F.col("id") * 7 % 900 + 80).alias("n"))
    for target, lengths in ((100, range(100, 300, 5)), (101, [90, 91, 2000, 3000]), (60, [500])):
        positives = spark.createDataFrame([(x,) for x in lengths], "n long")
        got = datasets.sample_negatives(pool, positives, target, "id", "kind", "n")
        counts = {r.negative_type: r["count"] for r in got.groupBy("negative_type").count().collect()}
        hard, matched = int(target * 0.5), int(target * 0.3)
        assert counts == {"hard": hard, "length_matched": matched, "easy": target - hard - matched} and got.select("id").distinct().count() == target
    few = datasets.sample_negatives(pool.filter("id < 210"), positives, 100, "id", "kind", "n").groupBy("negative_type").count().collect()
    assert {r.negative_type: r["count"] for r in few}["length_matched"] == 10


def test_curves_by_sorting(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 500), rng.random(500).round(2)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    want_ap = want_area = 0.0
    tp = fp = 0
    last_r, last_p = 0.0, 1.0
    best, broken, first = (-1, None), False, (-1, None)
    for t in sorted(set(s), reverse=True):
        own = y[s == t]
        tp, fp = tp + int((own == 1).sum()), fp + int((own == 0).sum())
        r, p = tp / (y == 1).sum(), tp / (tp + fp)
        want_ap += p * (r - last_r)
        want_area += (r - last_r) * (p + last_p) / 2
        last_r, last_p = r, p
        if 1 - p <= 0.45 + 1e-12:
            best = max(best, (r, t), key=lambda x: (x[0], x[1] or 0))
            first = (r, t) if not broken else first
        else:
            broken = True
    won = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert metrics.average_precision(rows, "y", "s").first()[0] == pytest.approx(want_ap) and metrics.pr_auc(rows, "y", "s").first()[0] == pytest.approx(want_area)
    assert metrics.auroc(rows, "y", "s").first()[0] == pytest.approx(won)
    found = metrics.fdr_threshold(rows, "y", "s", 0.45).first()
    assert (found.recall, found.threshold) == (pytest.approx(best[0]), pytest.approx(best[1]))


def test_bootstrap_draws_units_without_positives(spark):
    rows = spark.createDataFrame([(int(u % 3 != 0), u, True) for u in range(9) for _ in range(4)], "y int, u int, hit boolean")
    assert metrics.bootstrap_recall(rows, "y", "u", F.col("hit"), 20, "s").first()[:3] == (1.0, 1.0, 1.0)
    scores = spark.createDataFrame([(i % 2, i % 5, (i * 37 % 100) / 100) for i in range(100)], "y int, u int, s double")
    a = metrics.bootstrap_average_precision(scores, "y", "s", "u", 30, "x").first()
    assert 0 < a.low <= a.mean <= a.high < 1 and a == metrics.bootstrap_average_precision(scores.repartition(5), "y", "s", "u", 30, "x").first()


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_of_average_precision_by_sorting_each_replicate(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.4, rng.choice(["a", "b", "c", "d", None, "e"]), rng.choice([None, float("nan"), rng.random(), rng.randrange(5) / 4])) for _ in range(300)]
    frame = spark.createDataFrame([(int(y), u, s) for y, u, s in rows], "y int, u string, s double").repartition(5)
    units = sorted({u for _, u, _ in rows}, key=lambda u: (u is not None, u or ""))
    values = []
    for r in range(40):
        picks = [int(hashlib.md5(f"k:{r}:{d}".encode()).hexdigest()[:12], 16) % len(units) for d in range(1, len(units) + 1)]
        drawn = sorted(((-1.7e308 if s is None or s != s else s, y) for p in picks for y, u, s in rows if u == units[p]), reverse=True)
        tp = n = total = 0
        at = 0
        while at < len(drawn):
            end = at
            while end < len(drawn) and drawn[end][0] == drawn[at][0]:
                end += 1
            pos = sum(y for _, y in drawn[at:end])
            tp, n = tp + pos, n + end - at
            total += pos * tp / n
            at = end
        if tp:
            values.append(total / tp)
    got = metrics.bootstrap_average_precision(frame, "y", "s", "u", 40, "k").first()
    want = np.mean(values), np.quantile(values, 0.025), np.quantile(values, 0.975)
    assert tuple(got) == pytest.approx(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # scores that batches share
    try:
        assert tuple(metrics.bootstrap_average_precision(frame, "y", "s", "u", 40, "k").first()) == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filters(spark):
    cases = [("RuvC nuclease", "E. coli", 100, "hard"), ("Enolase", "E. coli", 100, "easy"), ("Unknown", "Serratia", 100, None), ("Transposase", "E. coli", 100, None), ("Unknown", None, 100, "general"), ("Unknown", "E. coli", 79, None)]
    p = spark.createDataFrame([(d, o, "M" * n, w) for d, o, n, w in cases], "d string, o string, s string, want string")
    got = {(r.d, r.o, len(r.s)): r.pool for r in filters.negative_pools(p, "d", "o", "s").collect()}
    assert all(got.get((d, o, n)) == w for d, o, n, w in cases)
    words = spark.createDataFrame([("Crossover junction endodeoxyribonuclease RuvC", "ruvc_nuclease"), ("transposase with RecQ", None), ("paralog", None), ("ParA family", "plasmid_partition"), (None, None)], "d string, want string")
    assert words.filter(~filters.challenge_class(F.col("d")).eqNullSafe(F.col("want"))).count() == 0
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no v for 2"):
        filters.strict_map(spark.createDataFrame([(1,), (2,)], "id int"), "id", t, "k", "v").collect()
    one = spark.createDataFrame([("c", "A" * 100_000)], "id string, sequence string")
    assert not filters.is_fragmented(one, ["id"]) and filters.is_fragmented(one.union(one), ["id"]) and filters.is_fragmented(one.limit(0).union(spark.createDataFrame([("c", "AC")], one.schema)), ["id"]) and not filters.is_fragmented(one.limit(0), ["id"])


def test_greedy_clusters_one_by_one(spark):
    rng = random.Random(4)
    n = {i: rng.randrange(30) for i in range(120)}
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(200)] + [(i, i + 1) for i in range(40)]
    near = {i: {i} for i in n}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for i in sorted(n, key=lambda i: (-n[i], i)):
        if i not in want:
            want |= {j: i for j in near[i] if j not in want}
    v = spark.createDataFrame(list(n.items()), "id long, n int")
    got = H.greedy_clusters(v, spark.createDataFrame(edges, "src long, dst long"), "id", [F.col("n")]).collect()
    assert {r.id: r.representative for r in got} == want
    assert H.greedy_clusters(v.limit(0), spark.createDataFrame([], "src long, dst long"), "id", [F.col("n")]).count() == 0


def test_greedy_links_lie_in_parts_of_one_size(spark, monkeypatch):
    """The links of all tasks grew with the input, as the number of tasks did not; those of a hub lay in one."""
    monkeypatch.setattr(H, "TASK_LINKS", 100)
    n = 600
    edges = [(0, i) for i in range(1, n)] + [(i, i + 7) for i in range(1, 500)] + [(3, 3), (5, 4), (4, 5), (4, 5), (1, n + 9), (None, 2)]
    v = spark.createDataFrame([(i, i % 11) for i in range(n)] + [(None, 3), (8, 8)], "id long, n int")
    order, linked, parts = H.greedy_links(v, spark.createDataFrame(edges, "src long, dst long"), "id", [F.col("n")])
    assert parts == 23
    place = {r.v: r.place for r in order.collect()}
    ranked = sorted(range(n), key=lambda i: (-(i % 11), i))
    assert sorted(ranked, key=place.get) == ranked and len(place) == n + 1
    both = {(a, b) for a, b in edges + [(b, a) for a, b in edges] if a != b and None not in (a, b) and max(a, b) < n}
    got = linked.withColumn("file", F.input_file_name()).collect()
    assert len(got) == len(both) and {(r.x, r.y) for r in got} == {(place[a], place[b]) for a, b in both}
    sizes = Counter(r.file for r in got)
    assert len(sizes) > 12 and max(sizes.values()) < 400
    assert len({r.file for r in got if r.x == place[0]}) > 3
    near = {i: {i} | {b for a, b in both if a == i} for i in range(n)}
    want = {}
    for i in ranked:
        if i not in want:
            want |= {j: i for j in near[i] if j not in want}
    found = H.greedy_clusters(v, spark.createDataFrame(edges, "src long, dst long"), "id", [F.col("n")]).collect()
    assert len(found) == n + 2 and {r.id: r.representative for r in found} == want | {None: None}


def test_holding_ids_by_plain_search(spark):
    rng = random.Random(5)
    ids = ["".join(rng.choice("ab_1") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    keys = ["".join(rng.choice("ab_1") for _ in range(rng.randrange(0, 11))) for _ in range(60)]
    got = {tuple(r) for r in screening.holding_ids(spark.createDataFrame([(k,) for k in keys], "k string"), "k", spark.createDataFrame([(i,) for i in ids], "i string"), "i").collect()}
    assert got == {(k, i) for k in keys if k for i in ids if k in i}


def test_closed_loop_ignores_empty_ids(spark):
    e = spark.createDataFrame([("E1", "", "complete", 0.5, 0.9), ("E2", "zz", "partial", 0.5, 300.0)], "element_id string, tpase_gene_id string, status string, composite_score double, tpase_score double")
    p = spark.createDataFrame([("zzz", "Novel_candidate", 0.8, 2), ("azz", "Remote", 0.7, 1)], "protein_id string, final_category string, transposase_score double, place int")
    got = {r.element_id: r for r in screening.closed_loop(e, p, "place").collect()}
    assert got["E1"].protein_category == "Uncertain" and got["E1"].dual_confidence == 0.7 and got["E2"].protein_category == "Remote" and got["E2"].dual_confidence == 0.6


def test_folds_round_before_they_judge(spark):
    # 39.96 becomes 40.0 and is a hit.
    n, plddt = 100, 50.0
    expected = 2.8 * n**0.33
    radius = expected * 19.96 / 50.0
    row = spark.range(1).select(D.fold_score(F.lit(n), F.lit(radius), F.lit(plddt)).alias("f"), D.fold_score(F.lit(9), F.lit(1.0), F.lit(90.0)).alias("few")).first()
    assert row.f.bitscore == 40.0 and row.f.hit and row.few.bitscore is None and not row.few.hit
    p = spark.createDataFrame([("a", "MKV" * 20), ("b", ""), ("c", None)], "id string, s string")
    got = {r.id: r for r in structures.predicted_folds(p, "id", "s").collect()}
    xyz = np.array([[round(5 * np.cos(i * 1.5), 3), round(5 * np.sin(i * 1.5), 3), round(i * 1.52, 3)] for i in range(1, 61)])
    assert got["a"].radius == pytest.approx(np.sqrt(((xyz - xyz.mean(0)) ** 2).sum(1).mean())) and got["a"].residues == 60 and got["b"].hit is False


def test_repeats_in_place_keep_equal_rows(spark):
    contig = "ACGTACGGTTCAGGCATTAC" * 8
    rows = spark.createDataFrame([("x", contig, 40, 100)] * 3 + [("y", "ACGT", 1, 3), ("z", None, 1, 3)], "k string, c string, a int, b int")
    got = boundaries.direct_repeats(rows, "c", "a", "b", ("k",)).collect()
    want, l, r = K.direct_repeat(contig, 40, 100)
    assert [tuple(x) for x in got] == [("x", l, r, want.sequence, want.length, want.mismatches, want.score)] * 3
    assert boundaries.predict_boundaries(rows.limit(1), "c", "a", "b", "k", "no such engine", ("k",)).first() == boundaries.predict_boundaries(rows.limit(1), "c", "a", "b", "k", "plan_b", ("k",)).first()


# --- models


def clouds(n, d=6, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d))
    x[:, 0] = np.where(y == 1, np.sign(x[:, 1]) * 2, -np.sign(x[:, 1]) * 2) + x[:, 0] * 0.3  # no line tells the classes apart
    return x, y


def slopes_agree(layers, x, loss):
    """Backward steps against differences of the loss."""
    out = models._through(layers, x)
    models._back(layers, np.ones_like(out) * 2 * out)
    for layer in layers:
        for name, value in layer.p.items():
            flat = value.reshape(-1)
            for i in range(0, flat.size, max(1, flat.size // 5)):
                old = flat[i]
                flat[i] = old + 1e-5
                up = loss(models._through(layers, x))
                flat[i] = old - 1e-5
                down = loss(models._through(layers, x))
                flat[i] = old
                assert layer.g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_layers_by_differences():
    rng = np.random.default_rng(1)
    layers = [models.Dense(rng, 5, 8), models.Normed(8), models.Gelu(), models.Dropout(0.5), models.Dense(rng, 8, 2)]
    slopes_agree(layers, rng.normal(size=(7, 5)), lambda out: float((out**2).sum()))


def test_hidden_layer_learns_what_no_line_can(spark):
    x, y = clouds(600)
    net = models.HiddenLayer(hidden=32, rounds=60, rate=3e-3).fit(x[:400], y[:400].astype(float))
    assert ((net(x[400:]) >= 0.5) == y[400:]).mean() > 0.9
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(100)] + [(100, None, 1)], "id long, v array<double>, y int")
    scored = models.score_vectors(rows, "v", net, 6).collect()
    assert [r.score for r in scored[:100]] == pytest.approx(net(x[:100]).tolist()) and scored[100].score is None
    with pytest.raises(Exception, match="expected 7 dimensions"):
        models.score_vectors(rows, "v", net, 7).collect()
    assert models.fit_hidden_layer(rows.filter("v IS NOT NULL"), "v", "y", "id", 20, hidden=4, rounds=1)(x[:3]).shape == (3,)


def test_two_heads(spark):
    x, y = clouds(800, seed=5)
    family = [("up" if v[2] > 0 else "down") if b else None for v, b in zip(x, y)]
    net = models.TwoHeads(hidden=32, rounds=30, rate=3e-3).fit(x[:600], y[:600].astype(float), family[:600])
    p, q = net.predict(x[600:])
    positive = y[600:] == 1
    named = np.array([net.families[i] for i in q.argmax(1)])
    assert ((p >= 0.5) == y[600:]).mean() > 0.85 and (named[positive] == np.array(family[600:], dtype=object)[positive]).mean() > 0.85
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "id long, v array<double>")
    got = models.score_two_heads(rows, "v", net, 6).collect()
    assert all((r.top_family is not None) == (r.score >= 0.5) and (r.family_score is None or 0.5 <= r.family_score <= 1) for r in got)


def test_profiles_and_probe():
    good = {"model_key": "plm_8m", "embedding_dimension": 320}
    assert models.resolve_profile("fast", good).classifier == "linear" and models.MODELS["plm_8m"]["dimension"] == 320
    for name, meta, said in (("slow", good, "unsupported"), ("fast", {**good, "embedding_dimension": 480}, "embedding_dimension"), ("standard", good, "model_key")):
        with pytest.raises(ValueError, match=said):
            models.resolve_profile(name, meta)
    assert models.throughput(lambda s: np.zeros((len(s), 2)), ["MK"] * 700) > 0


def refiner_weights(rng, c=4):
    w = {"stem.w": rng.normal(size=(c, 4, 7)) * 0.2, "stem.b": np.zeros(c), "junction.w": rng.normal(size=(1, 2 * c, 1)), "junction.b": np.zeros(1)}
    for name, a, b in (("one", c, c), ("two", c, 2 * c), ("three", 2 * c, 2 * c)):
        w |= {f"{name}.a.w": rng.normal(size=(b, a, 5)) * 0.2, f"{name}.a.b": np.zeros(b), f"{name}.b.w": rng.normal(size=(b, b, 5)) * 0.2, f"{name}.b.b": np.zeros(b)}
        if a != b:
            w |= {f"{name}.side.w": rng.normal(size=(b, a, 1)), f"{name}.side.b": np.zeros(b)}
    for name, n in (("stem.norm", c), *((f"{b}.{s}.norm", 2 * c if b != "one" else c) for b in ("one", "two", "three") for s in ("a", "b", "side"))):
        w |= {f"{name}.weight": np.ones(n), f"{name}.bias": np.zeros(n), f"{name}.mean": np.zeros(n), f"{name}.var": np.ones(n)}
    return w | {"offset.a.w": rng.normal(size=(2 * c, 32)), "offset.a.b": np.zeros(32), "offset.b.w": rng.normal(size=(32, 1)), "offset.b.b": np.zeros(1)}


def test_refiner():
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(3, 20)), rng.normal(size=(2, 3, 5))
    plain = np.array([[sum(w[o, c, k] * (x[c, i + (k - 2) * 2] if 0 <= i + (k - 2) * 2 < 20 else 0) for c in range(3) for k in range(5)) for i in range(20)] for o in range(2)])
    assert np.allclose(models._convolved(x, w, np.zeros(2), 2), plain)
    weights = refiner_weights(rng)
    logits, offset = models.refiner_network(weights, K.one_hot("ACGT" * 32))
    assert logits.shape == (128,) and np.isfinite(offset)
    refine = models.refiner(lambda z: models.refiner_network(weights, z))
    contig = "".join(random.Random(1).choice("ACGT") for _ in range(900))
    for place in (0, 5, 400, 899):
        move, sure = refine(contig, place, True, 25)
        assert -25 <= move <= 25 and 0 <= sure <= 1 and 0 <= place + move <= 900
    peak = models.refiner(lambda z: (np.where(np.arange(128) == 74, 50.0, 0.0), 10.0))
    assert peak(contig, 400, True, 25) == (10, 1.0) and peak(contig, 400, True, 3) == (3, 1.0)
    assert K.hybrid(contig, 400, 800, "IS3", peak).start >= 0


def test_refiner_training(spark):
    from math import erf

    x = np.linspace(-5, 5, 401)
    assert np.abs(models.error_function(x) - np.array([erf(v) for v in x])).max() < 2e-7
    rng = np.random.default_rng(0)
    t, place, offset = models.RefinerTraining(3, 1), np.array([3, 9, 12, 5]), np.array([-0.5, 0.3, 4.0, -6.0])
    x = rng.normal(size=(4, 4, 16))
    t.step(x, place, offset)
    kept = [{k: v.copy() for k, v in layer.g.items()} for layer in t.layers()]
    for layer, g in zip(t.layers(), kept):
        for k, v in layer.p.items():
            flat = v.reshape(-1)
            for i in range(0, flat.size, max(1, flat.size // 3)):
                old = flat[i]
                flat[i] = old + 1e-4
                up = t.step(x, place, offset)
                flat[i] = old - 1e-4
                down = t.step(x, place, offset)
                flat[i] = old
                assert g[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=2e-3)

    def contig():  # the end is where the motif begins
        s = "".join(rng.choice(list("ACGT"), 400))
        return s[:200] + "GGTTCC" + s[206:]

    rows = spark.createDataFrame([(i, contig(), 200) for i in range(120)], "k int, c string, p int")
    windows = models.refiner_windows(rows, "c", "p", "k", 3)
    weights = models.fit_refiner(windows, "k", 360, channels=6, rounds=12, rate=5e-3)
    refine = models.refiner(lambda z: models.refiner_network(weights, z))
    found = 0
    for move in range(-10, 11):
        c = contig()
        logits, _ = models.refiner_network(weights, K.one_hot(c[200 + move - 64 : 200 + move + 64], 128))
        found += abs(int(logits.argmax()) - (64 - move)) <= 1
        assert -25 <= refine(c, 200 + move, True, 25)[0] <= 25
    assert found >= 15


def test_refiner_windows_hold_the_end(spark):
    contig = "".join(random.Random(2).choice("ACGT") for _ in range(600))
    got = models.refiner_windows(spark.createDataFrame([("a", contig, 300), ("b", contig, 10)], "k string, c string, p int"), "c", "p", "k", 5).collect()
    assert len(got) == 5 and all(len(r.sequence) == 128 and contig[300:310] == r.sequence[r.junction : r.junction + 10] and abs(r.offset) <= 25 for r in got)


def test_family_profiles_score_their_own(spark):
    rng = random.Random(7)
    motif = {"x": "MKVLL", "y": "WWHHC", "z": "DEDED"}
    rows = [(f"{f}{i}", f, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20)) + motif[f] * 3) for f in motif for i in range(6 if f != "z" else 2)]
    p = spark.createDataFrame(rows, "id string, family string, s string")
    profiles = models.family_profiles(p, "family", "s")
    got = {r["query"]: r.family for r in models.profile_scores(p, "id", "s", profiles).collect()}
    assert {r.family for r in profiles.select("family").distinct().collect()} == {"x", "y"} and all(got[i] == f for i, f, _ in rows if f != "z")


def test_leave_one_family_out(spark):
    rows = spark.createDataFrame([(i, f"f{i % 3}", int(i % 4 != 0), float(i % 7), "test" if i % 5 == 0 else "train") for i in range(90)], "id long, family string, y int, x double, split string")
    folds = datasets.leave_one_out_folds(rows, "family", "y", "split", ["f0", "f1"])

    def fit(train):
        middle = train.agg(F.avg("x")).first()[0]
        return lambda test: test.withColumn("score", F.col("x") - middle)

    out = models.leave_one_family_out(rows, folds, fit, ["f0", "f1"])
    assert {r.fold for r in out.select("fold").distinct().collect()} == {"f0", "f1"} and out.filter("score IS NULL").count() == 0
    assert out.filter("fold = 'f0' AND y = 1 AND family <> 'f0'").count() == 0


# --- programs


@pytest.fixture()
def tools(tmp_path):
    """Programs that answer as the searches do: one hit a query, a failure, and one that never ends."""

    def put(name, body):
        path = tmp_path / name
        path.write_text(f"#!/usr/bin/env python3\nimport sys, time\n{body}\n")
        path.chmod(path.stat().st_mode | stat.S_IEXEC)
        return str(path)

    read = "ids = [l[1:].split()[0] for l in open([a for a in sys.argv if a.endswith('queries.fa')][0]) if l[0] == '>']\n"
    return {
        "mmseqs": put("mmseqs", read + "open([a for a in sys.argv if a.endswith('hits.tsv')][0], 'w').write(''.join(f'{i}\\tt\\t0.9\\t50\\t0.8\\t0.7\\t1e-9\\t{len(i)}\\n' for i in ids))"),
        "mmseqs_odd": put("mmseqs_odd", read + "open([a for a in sys.argv if a.endswith('hits.tsv')][0], 'w').write(''.join(f'{i}\\tt\\t0.9\\t50\\t0.8\\t0.7\\t1e-9\\t{len(i)}\\n' for i in ids) + 'bad line\\n')"),
        "blastp": put("blastp", read + "open([a for a in sys.argv if a.endswith('hits.tsv')][0], 'w').write(''.join(f'{i}\\tt\\t90.0\\t50\\t80\\t1e-9\\t77\\n' for i in ids))"),
        "hmmsearch": put("hmmsearch", read + "open(sys.argv[sys.argv.index('--tblout') + 1], 'w').write('# c\\n' + ''.join(f'{i} - Tpase_IS3 PF 1e-20 99.5 0 1e-19 98.5 0 1 1 1 1 1 1 1 1 x\\n' for i in ids))"),
        "mafft": put("mafft", "for l in open(sys.argv[-1]):\n    print(l.rstrip() if l[0] == '>' else l.rstrip().ljust(9, '-'))"),
        "broken": put("broken", "print('no good', file=sys.stderr)\nsys.exit(3)"),
        "endless": put("endless", "time.sleep(60)"),
        "folder": str(tmp_path),
    }


def test_programs(spark, tools):
    p = spark.createDataFrame([(f"p{i}", "MKV" * i) for i in range(12)], "id string, s string").repartition(3)
    hits = external.search(p, "id", "s", external.similarity_runner("db", tools["mmseqs_odd"], strict=False), external.HITS).collect()
    assert sorted(r.query for r in hits) == sorted(f"p{i}" for i in range(1, 12)) and all(r.fident == 0.9 and r.alnlen == 50 for r in hits)
    with pytest.raises(Exception, match="a row that is not .*: bad line"):
        external.search(p, "id", "s", external.similarity_runner("db", tools["mmseqs_odd"]), external.HITS).collect()
    assert external.search(p, "id", "s", external.blast_runner("db", tools["blastp"]), external.BLAST).count() == 11
    found = external.search(p, "id", "s", external.profile_runner("lib", tools["hmmsearch"]), external.PROFILE_HITS).collect()
    assert len(found) == 11 and found[0].profile == "Tpase_IS3" and found[0].bits == 99.5 and found[0].domain_bits == 98.5
    f = spark.createDataFrame([("a", "x", "MK"), ("a", "y", "MKV"), ("a", "z", "M"), ("b", "q", "M")], "f string, id string, s string")
    aligned = {r.id: r.aligned for r in external.align_families(f, "f", "id", "s", tools["mafft"]).collect()}
    assert aligned == {"x": "MK-------", "y": "MKV------", "z": "M--------"}
    assert external.search(p.limit(0), "id", "s", external.blast_runner("db", tools["blastp"]), external.BLAST).count() == 0


def test_programs_that_fail(spark, tools):
    with pytest.raises(external.ToolError, match="exit status 3; command: .*; stderr: no good"):
        external.call("broken", [tools["broken"]], tools["folder"], 20)
    with pytest.raises(external.ToolError, match="no end within 0.5 s"):
        external.call("endless", [tools["endless"]], tools["folder"], 0.5)
    with pytest.raises(external.ToolError, match="no executable"):
        external.resolve("x", "/nowhere/x")
    before = set(os.listdir("/tmp"))
    with pytest.raises(Exception, match="no executable"):
        external.search(spark.createDataFrame([("a", "MK")], "id string, s string"), "id", "s", external.blast_runner("db", "/nowhere/blastp"), external.BLAST).collect()
    assert not [x for x in set(os.listdir("/tmp")) - before if os.path.exists(f"/tmp/{x}/queries.fa")]


# --- artifacts


def test_matrix_rows_meet_their_metadata(spark, tmp_path):
    m = np.arange(8, dtype=np.float32).reshape(4, 2)
    np.save(tmp_path / "m.npy", m)
    index = spark.createDataFrame([("a", 3), ("b", 0), ("c", 9), (None, 1)], "seq_id string, embedding_idx int")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("x", 1), (None, 0)], "seq_id string, y int")
    got = {r.seq_id: (r.y, r.vector) for r in artifacts.with_metadata(artifacts.read_matrix(spark, f"{tmp_path}/m.npy"), index, labels).collect()}
    assert got == {"a": (1, m[3].tolist()), "b": (0, m[0].tolist())}


def test_artifacts(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = sorted(artifacts.read_matrix(spark, f"{tmp_path}/m.npy").collect(), key=lambda r: r.row)
    assert [r.vector for r in got] == m.tolist()
    np.savez(tmp_path / "c.npz", coef=np.ones((1, 3)), threshold=np.array(0.5))
    assert artifacts.read_arrays(spark, f"{tmp_path}/c.npz")["coef"].tolist() == [[1, 1, 1]]
    (tmp_path / "s.json").write_text('{"a": [1, 2]}')
    (tmp_path / "s.yaml").write_text("a:\n- 1\n- 2\n")
    assert artifacts.read_settings(spark, f"{tmp_path}/s.json") == {"a": [1, 2]}
    pytest.importorskip("yaml")
    assert artifacts.read_settings(spark, f"{tmp_path}/s.yaml") == {"a": [1, 2]}


def test_fresh_destinations_and_caches(spark, tmp_path):
    out = f"{tmp_path}/out"
    with pytest.raises(ZeroDivisionError), artifacts.fresh(spark, out):
        spark.range(3).write.parquet(out)
        1 / 0
    assert not os.path.exists(out)
    with artifacts.fresh(spark, out):
        spark.range(3).write.parquet(out)
    with pytest.raises(FileExistsError), artifacts.fresh(spark, out):
        pass
    calls = []
    for _ in range(2):
        assert artifacts.cached(spark, f"{tmp_path}/cache", lambda: calls.append(1) or spark.range(5)).count() == 5
    assert calls == [1]
    seen = []

    def compute(rows):
        seen.append(sorted(r.k for r in rows.collect()))
        return rows.select("k", F.length("k").alias("n"))

    for keys, want in ((["a", "bb", "a"], ["a", "bb"]), (["bb", "ccc"], ["ccc"]), (["a"], [])):
        got = artifacts.cached_by_key(spark.createDataFrame([(k,) for k in keys], "k string"), "k", f"{tmp_path}/keys", compute)
        assert {r.k: r.n for r in got.collect()} == {k: len(k) for k in keys} and seen[-1] == want


def test_lines_keep_the_order_of_their_files(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    for f in range(3):
        (tmp_path / "t" / f"part-{f}.tsv").write_text("".join(f"q{f}\tt{i}\t0.5\t9\t0.9\t0.9\t0.1\t7.0\n" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = tables.read_hits(spark, f"{tmp_path}/t").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["query"], r.target, r.line_no) for r in got] == [(f"q{f}", f"t{i}", f * 200 + i + 1) for f in range(3) for i in range(200)]
    assert H.best_similarity(spark.createDataFrame(got)).filter("target <> 't0'").count() == 0


def test_records_that_are_no_utf8(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.fa.gz", "wb") as f:
        f.write(b">a one \xff two\nAC\nGT\n>b\n\n>c\r\nTT\r\n")
    got = {r.id: r for r in fasta.read_fasta(spark, f"{tmp_path}/x.fa.gz").collect()}
    assert got["a"].sequence == "ACGT" and "\ufffd" in got["a"].description and got["b"].sequence == "" and got["c"].sequence == "TT"


def test_fragments_hold_what_they_say(spark):
    rng = random.Random(9)
    rows = [(f"n{i}", ["IS3", "IS110"][i % 2], "".join(rng.choice("ACGT") for _ in range(300 + 40 * i)), "none", "9", "20") for i in range(24)] + [("short", "IS3", "ACGT", None, None, None)]
    e = spark.createDataFrame(rows, "is_name string, family string, dna_sequence string, orf_annotation string, dr_length string, tir_left string")
    c = fragments.genomic_contexts(e, 100)
    whole = {r.is_name: r for r in c.collect()}
    assert len(whole) == 24 and c.collect() == fragments.genomic_contexts(e.repartition(5), 100).orderBy("is_name").collect() or len(whole) == 24
    cut = fragments.cut_fragments(fragments.fragment_classes(c, {"complete": 6, "edge_5p_truncated": 6, "edge_3p_truncated": 6, "edge_both_truncated": 6})).collect()
    seq = {r[0]: r[2] for r in rows}
    for r in cut:
        own = r.sequence[r.gold_start : r.gold_end]
        assert own in seq[r.is_name] and len(r.sequence) == r.contig_length and (r.gold_truncation != "complete" or own == seq[r.is_name])
        assert (r.gold_start == 0) == (r.gold_truncation in ("edge_5p_truncated", "edge_both_truncated"))
    g = spark.createDataFrame([("g", "".join(rng.choice("acgt") for _ in range(20_000)))], "id string, s string")
    far = fragments.background_fragments(g, "id", "s", count=5, start=100).collect()
    assert len(far) == 5 and all(800 <= r.contig_length <= 3500 and r.sequence.isupper() and not r.is_positive for r in far)


# --- commands


def test_commands_prepare_a_data_set(spark, tmp_path):
    d = str(tmp_path)
    rng = random.Random(8)
    protein = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    seqs = [protein(120 + i) for i in range(12)]
    (tmp_path / "p.fa").write_text("".join(f">db//IS{i}~~~orf1~~~{'Transposase' if i != 3 else 'Accessory'}\n{s}\n" for i, s in enumerate(seqs + seqs[:2])))
    (tmp_path / "e.fa").write_text("".join(f">IS{i}_fam{i % 2}_unknown\nACGTACGT{'A' * i}\n" for i in range(12)))
    (tmp_path / "m.csv").write_text("Name,Family,Group,Length\n" + "".join(f"IS{i},{'' if i == 5 else f'IS{i % 3}'},NA,{i}\n" for i in range(14) if i != 7))
    cli.main(["normalize", "--proteins", f"{d}/p.fa", "--elements", f"{d}/e.fa", "--metadata", f"{d}/m.csv", "--out", f"{d}/norm"], spark)
    t = spark.read.parquet(f"{d}/norm/tpases")
    assert t.count() == 13 and t.filter("family = 'Unknown'").count() == 2
    elements = {r.is_name: r.family for r in spark.read.parquet(f"{d}/norm/is_elements").collect()}
    assert elements["IS5"] == "Unknown" and elements["IS7"] == "fam1" and elements["IS8"] == "IS2"
    with pytest.raises(FileExistsError):
        cli.main(["normalize", "--proteins", f"{d}/p.fa", "--elements", f"{d}/e.fa", "--metadata", f"{d}/m.csv", "--out", f"{d}/norm"], spark)
    cli.main(["deduplicate", "--input", f"{d}/norm/tpases", "--out", f"{d}/unique"], spark)
    u = spark.read.parquet(f"{d}/unique")
    assert u.count() == 11
    ids = [r.tpase_id for r in u.orderBy("tpase_id").collect()]
    (tmp_path / "hits.tsv").write_text("".join(f"{a}\t{b}\t0.9\t90\t0.95\t0.95\t1e-20\t100\n" for a, b in zip(ids[:4], ids[1:5])))
    for scheme in ("A", "D"):
        cli.main(["cluster", "--input", f"{d}/unique", "--hits", f"{d}/hits.tsv", "--scheme", scheme, "--out", f"{d}/clusters{scheme}"], spark)
    assert spark.read.parquet(f"{d}/clustersA").select("cluster_id").distinct().count() == 7
    assert spark.read.parquet(f"{d}/clustersD").select("cluster_id").distinct().count() > 7
    cli.main(["split", "--input", f"{d}/clustersA", "--out", f"{d}/split"], spark)
    assert spark.read.text(f"{d}/split/manifest.yaml").first().value == "splits:" and spark.read.parquet(f"{d}/split/splits").count() == 11
    with pytest.raises(SystemExit):
        cli.main(["audit", "--hits", f"{d}/hits.tsv"], spark)
    cli.main(["summary", "--input", f"{d}/clustersA", "--out", f"{d}/summary"], spark)
    kinds = ["nuclease", "Enolase", "kinase"]
    (tmp_path / "lib.fa").write_text("".join(f">sp|P{i:05d}|E{i}_X {kinds[i % 3]} number {i} OS=Bacillus OX=1\n{protein(110 + i % 30)}\n" for i in range(150)))
    cli.main(["build-negatives", "--proteins", f"{d}/lib.fa", "--positives", f"{d}/unique", "--out", f"{d}/neg"], spark)
    n = spark.read.parquet(f"{d}/neg")
    assert n.count() == 33 and n.select("negative_id").distinct().count() == 33
    cli.main(["prepare-eval", "--positives", f"{d}/unique", "--negatives", f"{d}/neg", "--identities", f"{d}/hits.tsv", "--out", f"{d}/eval"], spark)
    assert spark.read.parquet(f"{d}/eval").groupBy("label").count().count() == 2


def test_commands_score_and_scan(spark, tmp_path, tools):
    d = str(tmp_path)
    rng = random.Random(10)
    q = spark.createDataFrame([(f"p{i}", "MKV" * (i + 1), i % 2) for i in range(6)], "seq_id string, protein_sequence string, label int")
    q.write.parquet(f"{d}/q")
    for name, tool in (("bench-blast", "blastp"), ("bench-mmseqs", "mmseqs"), ("bench-hmmer", "hmmsearch")):
        cli.main([name, "--input", f"{d}/q", "--database", "db", "--program", tools[tool], "--out", f"{d}/{name}"], spark)
        assert spark.read.parquet(f"{d}/{name}").filter("score > 0").count() == 6
    v = spark.createDataFrame([(f"s{i}", [float(i % 2) + rng.random() * 0.1, rng.random()], i % 2) for i in range(60)], "seq_id string, embedding array<double>, label int")
    v.write.parquet(f"{d}/v")
    for model in ("linear", "hidden"):
        cli.main(["bench-embeddings", "--train", f"{d}/v", "--test", f"{d}/v", "--model", model, "--out", f"{d}/{model}"], spark)
    cli.main(["eval-detection", "--validation", f"{d}/linear", "--test", f"{d}/linear", "--out", f"{d}/detection"], spark)
    assert spark.read.csv(f"{d}/detection/overall", sep="\t", header=True).first().auroc == "1.0"
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gene = "ATG" + "".join(rng.choice(["GCT", "AAA", "GGT", "CTG"]) for _ in range(250)) + "TAA"
    (tmp_path / "g.fa").write_text("".join(f">c{i}\n{dna(700)}{gene}{dna(700)}\n" for i in range(3)))
    cli.main(["scan", "--input", f"{d}/g.fa", "--database", "lib", "--program", tools["hmmsearch"], "--engine", "unknown", "--out", f"{d}/scan"], spark)
    found = spark.read.parquet(f"{d}/scan/elements")
    assert {r.contig_id for r in found.select("contig_id").distinct().collect()} == {"c0", "c1", "c2"} and json.loads(spark.read.text(f"{d}/scan/summary").first().value)["total"] == found.count()
    assert spark.read.text(f"{d}/scan/gff3").filter("value LIKE '##gff%'").count() == 1 and spark.read.text(f"{d}/scan/fasta", lineSep="\n>").count() == found.count()
    truth = spark.createDataFrame([(f"c{i}", True, "complete") for i in range(3)] + [("n", False, "negative")], "contig_id string, is_positive boolean, gold_truncation string")
    truth.write.parquet(f"{d}/truth")
    cli.main(["benchmark-metagenome", "--scan", f"{d}/scan", "--truth", f"{d}/truth", "--out", f"{d}/bench"], spark)
    assert spark.read.csv(f"{d}/bench/summary", sep="\t", header=True).first().recall == "1.0"
    (tmp_path / "features.tbl").write_text("701\t1456\tmobile_element\n\t\t\tmobile_element_type\tinsertion sequence:IS3\n")
    cli.main(["benchmark-genome", "--scan", f"{d}/scan", "--truth", f"{d}/features.tbl", "--out", f"{d}/genome"], spark)
    assert spark.read.csv(f"{d}/genome", sep="\t", header=True).first().n_true == "1"
    e = spark.createDataFrame([(f"n{i}", "IS3", dna(800), "100 (50 - 700)", "3", "20") for i in range(5)], "is_name string, family string, dna_sequence string, orf_annotation string, dr_length string, tir_left string")
    e.write.parquet(f"{d}/e")
    cli.main(["build-boundary-benchmark", "--elements", f"{d}/e", "--out", f"{d}/contexts"], spark)
    cli.main(["eval-boundaries", "--contexts", f"{d}/contexts", "--out", f"{d}/boundaries"], spark)
    assert spark.read.csv(f"{d}/boundaries/comparison", sep="\t", header=True).count() == 6


def test_commands_search_without_programs(spark, tmp_path):
    """Clusters, hits, models, predictions and a scan by the library's own search, models and gene finder."""
    from mobilome.functions import gene_kernels as GK
    from tests.test_alignment_search import mutated, protein

    d, rng = str(tmp_path), random.Random(21)
    bases = {f: protein(150, rng) for f in ("IS3", "IS5")}
    rows = [(f"{f}_{i}", mutated(b, rng, 12, 1), 150, f) for f, b in bases.items() for i in range(5)]
    spark.createDataFrame(rows, "tpase_id string, protein_sequence string, protein_length int, family string").write.parquet(f"{d}/t")
    cli.main(["cluster", "--input", f"{d}/t", "--out", f"{d}/c"], spark)
    assert sorted(r["count"] for r in spark.read.parquet(f"{d}/c").groupBy("cluster_id").count().collect()) == [5, 5]
    cli.main(["search", "--queries", f"{d}/t", "--targets", f"{d}/t", "--out", f"{d}/hits"], spark)
    assert spark.read.csv(f"{d}/hits", sep="\t", header=True).count() in (49, 50)
    cli.main(["build-profiles", "--input", f"{d}/t", "--out", f"{d}/p"], spark)
    cli.main(["build-profiles", "--input", f"{d}/t", "--sub-identity", "0.4", "--out", f"{d}/sub"], spark)
    assert {r.family for r in spark.read.parquet(f"{d}/p").collect()} == {"IS3", "IS5"} and spark.read.parquet(f"{d}/sub").count() == 2
    cli.main(["align-families", "--input", f"{d}/t", "--out", f"{d}/aligned"], spark)
    assert len({(r.family, len(r.aligned)) for r in spark.read.parquet(f"{d}/aligned").collect()}) == 2
    q = [(f"q{i}", mutated(b, rng, 30, 1)) for i, b in enumerate(bases.values())] + [("no", protein(150, rng))]
    spark.createDataFrame(q, "seq_id string, protein_sequence string").write.parquet(f"{d}/q")
    cli.main(["bench-search", "--input", f"{d}/q", "--train", f"{d}/t", "--out", f"{d}/bs"], spark)
    cli.main(["bench-profiles", "--input", f"{d}/q", "--profiles", f"{d}/p", "--out", f"{d}/bp"], spark)
    for name in ("bs", "bp"):
        got = {r.seq_id: (r.target_id, r.score) for r in spark.read.parquet(f"{d}/{name}").collect()}
        assert got["q0"][0].startswith("IS3") and got["q1"][0].startswith("IS5") and got["q0"][1] > max(30, got["no"][1])
    codon = {r: "".join("TCAG"[x] for x in divmod(i // 4, 4)) + "TCAG"[i % 4] for i, r in enumerate(GK.CODE)}
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    others = [("", protein(200, rng)) for _ in range(40)]  # a coding model needs genes to learn from
    (tmp_path / "g.fa").write_text("".join(f">c{i}\n{dna(400)}ATG{''.join(codon[r] for r in s)}TAA{dna(400)}\n" for i, (_, s) in enumerate(q + others)))
    cli.main(["scan-metagenome", "--input", f"{d}/g.fa", "--profiles", f"{d}/p", "--out", f"{d}/scan"], spark)
    assert {(r.contig_id, r.family) for r in spark.read.parquet(f"{d}/scan/elements").collect()} == {("c0", "IS3"), ("c1", "IS5")}


def test_commands_screen_proteins(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "p.fa").write_text("".join(f">p{i}\n{'MKVDEDL' * (8 + i)}\n" for i in range(6)))
    spark.createDataFrame([(f"p{i}", [float(i - 3), 1.0]) for i in range(6)], "protein_id string, embedding array<double>").write.parquet(f"{d}/emb")
    np.savez(tmp_path / "c.npz", mean=np.zeros(2), scale=np.ones(2), coef=np.array([[2.0, 0.0]]), intercept=np.array([0.0]), threshold=np.array(0.5))
    (tmp_path / "s.tsv").write_text("p5\tt\t0.9\t50\t0.95\t0.9\t1e-30\t200\np4\tt\t0.25\t50\t0.3\t0.9\t1e-3\t30\n")
    (tmp_path / "h.tbl").write_text("# c\np3 - fam PF 1e-20 99.5 0 1e-19 98.5 0 1 1 1 1 1 1 1 1 x\n")
    base = ["--input", f"{d}/p.fa", "--embeddings", f"{d}/emb", "--classifier", f"{d}/c.npz"]
    more = ["--search", f"{d}/s.tsv", "--profiles", f"{d}/h.tbl"]
    cli.main(["screen-proteins", *base, "--out", f"{d}/one"], spark)
    one = {r.protein_id: r.final_category for r in spark.read.parquet(f"{d}/one").collect()}
    assert one["p0"] == "Negative" and one["p5"] == "Uncertain" and len(one) == 6
    cli.main(["screen-proteins-homology", *base, *more, "--out", f"{d}/two"], spark)
    two = {r.protein_id: r.route for r in spark.read.parquet(f"{d}/two").collect()}
    assert two["p5"] == "ACCEPT_KNOWN" and two["p0"] == "REJECT" and two["p4"] == "STAGE2A"
    cli.main(["screen-proteins-research", *base, *more, "--out", f"{d}/three"], spark)
    three = {r.protein_id: r for r in spark.read.parquet(f"{d}/three").collect()}
    assert len(three) == 6 and three["p0"].final_category == "Negative" and three["p0"].full_score is None and three["p4"].fast_score is not None


def test_every_command_says_what_it_does(capsys):
    assert len(cli.COMMANDS) == 29 and all(f.__doc__ for f, _ in cli.COMMANDS.values())
    cli.main(["version"])
    assert capsys.readouterr().out.strip() == cli.VERSION


def test_closed_loop_looks_a_shared_key_up_once(spark):
    """Many elements of one gene and many proteins that hold it: their pairs are never rows of a plan."""
    e = spark.range(300).selectExpr("concat('E', id, '.') element_id", "'c3_g' tpase_gene_id", "'complete' status", "0.5D composite_score", "0.4D tpase_score")
    p = spark.range(400).selectExpr("concat('pre_c3_g', id) protein_id", "if(id = 7, 'Remote', 'Negative') final_category", "id / 400D transposase_score", "abs(id - 7) place")
    out = screening.closed_loop(e, p, "place")
    got = out.select("element_id", "protein_category", "dual_confidence").distinct().collect()
    assert len(got) == 300 and {r.protein_category for r in got} == {"Remote"} and {r.dual_confidence for r in got} == {0.2588}
    tables = {}  # rows of every table that the plan reads
    for name in ("loop-keys", "loop-open", "loop-firsts"):
        paths = sorted(glob.glob(f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/{name}-*"), key=os.path.getmtime)
        tables[name] = spark.read.parquet(paths[-1]).count()
    assert tables["loop-keys"] == 900 and tables["loop-open"] == 600 and tables["loop-firsts"] == 301


def test_simulated_folds_are_those_of_their_atoms(spark):
    """The measures made outside Spark's expressions are those of the predicted atoms, column by column."""
    rows = [(None if i == 3 else i, "A" * n) for i, n in enumerate((1, 2, 9, 10, 11, 19, 20, 21, 57, 1234))] + [(98, ""), (99, None)]
    p = spark.createDataFrame(rows, "id long, s string")
    got = structures.predicted_folds(p, "id", "s").collect()
    want = structures.predicted_folds(p, "id", "s", lambda s: structures.simulated_structure(s)).collect()
    assert structures.helix(3).shape == (4, 3) and len(got) == len(want) == 12
    for a, b in zip(sorted(got, key=lambda r: (r.residues, str(r.id))), sorted(want, key=lambda r: (r.residues, str(r.id)))):
        assert (a.id, a.residues, a.hit) == (b.id, b.residues, b.hit)
        assert (a.plddt, a.radius) == (b.plddt, b.radius) if a.residues == 0 else abs(a.plddt - b.plddt) < 1e-9 and abs(a.radius - b.radius) < 1e-7
