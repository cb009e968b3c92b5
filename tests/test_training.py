"""Training in the cluster against one machine that takes the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mobilome.operators import training
from mobilome.operators.models import AdamW, HiddenLayer, TwoHeads


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.4).astype(int)
    family = ["a" if v > 0 else "b" for v in x[:, 2]]
    data = [(i, v.tolist(), int(b), f) for i, (v, b, f) in enumerate(zip(x, y, family))]
    data += [data[3], (None, [0.0] * 5, 1, "a"), (900, None, 1, "a"), (901, [0.0] * 5, None, "a")]
    return spark.createDataFrame(data, "id long, v array<double>, y int, f string").repartition(5)


def alone(rows, loss, rounds, batches, optimiser, shares, families=None):
    found = rows.filter("id IS NOT NULL AND v IS NOT NULL AND y IS NOT NULL").select(F.xxhash64("id").alias("h"), "v", "y", "f")
    step = 0
    for t in range(rounds):
        dealt = found.withColumn("b", F.pmod(F.xxhash64("h", F.lit(t)), F.lit(batches))).toPandas()
        for b in range(batches):
            step += 1
            own = dealt[dealt["b"] == b]
            target = np.array([families.index(f) if families and f in families else 0 for f in own["f"]], int)
            sums, counts = loss.sums(np.array(own["v"].tolist(), float), own["y"].to_numpy(float), target, training.RowDraws(own["h"].to_numpy(np.int64), step))
            training._stepped(loss, optimiser, sums, counts, shares[t])


def test_hidden_layer_has_the_weights_of_one_machine(rows):
    net = training.fit_hidden_layer(rows, "v", "y", "id", rounds=3, batches=4, hidden=16, rate=0.01)
    one = HiddenLayer(16, rate=0.01).empty(5)
    y = rows.filter("id IS NOT NULL AND v IS NOT NULL AND y IS NOT NULL").select("y").toPandas()["y"]
    alone(rows, training._Hidden(one, (len(y) - y.sum()) / (y.sum() + 1e-5)), 3, 4, AdamW(one.layers, 0.01), [1.0] * 3)
    for a, b in zip(net.layers, one.layers):
        for k in a.p:
            assert np.abs(a.p[k] - b.p[k]).max() < 1e-6
    assert np.abs(net.layers[0].p["w"] - HiddenLayer(16).empty(5).layers[0].p["w"]).max() > 1e-3


def test_two_heads_have_the_weights_of_one_machine(rows):
    options = {"hidden": 12, "rounds": 2, "rate": 0.01}
    net = training.fit_two_heads(rows, "v", "y", "f", "id", batches=3, **options)
    assert net.families == ["a", "b"]
    one = TwoHeads(**options)
    one.families = ["a", "b"]
    loss = training._Two(one.empty(5))
    alone(rows, loss, 2, 3, AdamW(loss.layers, 0.01), [0.5 * (1 + np.cos(np.pi * t / 2)) for t in range(2)], one.families)
    for a, b in zip([*net.trunk, *net.heads], loss.layers):
        for k in a.p:
            assert np.abs(a.p[k] - b.p[k]).max() < 1e-6


def test_it_learns(rows):
    net = training.fit_hidden_layer(rows, "v", "y", "id", rounds=12, batches=4, hidden=16, rate=0.02, dropout=0.1)
    some = rows.filter("id < 240").toPandas()
    p = net(np.array(some["v"].tolist(), float))
    assert ((p > 0.5) == (some["y"] == 1)).mean() > 0.93


def test_draws_follow_the_row_alone():
    h = np.array([5, -7, 12], np.int64)
    whole, part = training.RowDraws(h, 3), training.RowDraws(h[1:], 3)
    a, b = whole.random((3, 400)), part.random((2, 400))
    assert np.array_equal(a[1:], b) and abs(a.mean() - 0.5) < 0.03 and not np.array_equal(whole.random((3, 400)), a)


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        training.fit_hidden_layer(spark.createDataFrame([], "id long, v array<double>, y int"), "v", "y", "id")
