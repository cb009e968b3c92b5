"""Networks trained in the cluster: every step sums the gradients of all rows of its batch, wherever they lie.

A round deals the rows to batches by hash, anew each round.  For each batch every task runs its rows forwards and backwards and hands on one
sum of gradients; sums are added up in groups in the cluster, and the driver takes the step from a number of them that grows with
the square root of the tasks.  No row leaves its task.  Dropout is drawn from the row's hash, so the weights are those of one machine that takes
the same batches, up to the order of summation.  Defined results: rows with a null id, vector or label take no part; batches without rows make no step; of
rows that are repeated each counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.operators.models import AdamW, HiddenLayer, TwoHeads, _back, _sigmoid, _softmax, _through
from mobilome.storage import discard, materialize


class RowDraws:
    """Numbers in [0, 1) that follow from a row's hash, the step and the place, in the manner of a random generator."""

    def __init__(self, rows: np.ndarray, step: int):
        self.rows, self.call = rows.astype(np.int64).view(np.uint64), np.uint64(step) << np.uint64(20)

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        self.call += np.uint64(1 << 12)
        x = self.rows[:, None] ^ ((self.call + np.arange(shape[1], dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _flat(layers, of: str) -> np.ndarray:
    return np.concatenate([getattr(layer, of)[k].ravel() for layer in layers for k in sorted(layer.p)] or [np.zeros(0)])


def _unflat(layers, values: np.ndarray, of: str) -> None:
    at = 0
    for layer in layers:
        if layer.p:
            found = {}
            for k in sorted(layer.p):
                size = layer.p[k].size
                found[k] = values[at : at + size].reshape(layer.p[k].shape)
                at += size
            setattr(layer, of, found)


class _Hidden:
    """Sums of the class-balanced cross-entropy's gradients."""

    def __init__(self, net: HiddenLayer, positive: float):
        self.net, self.positive, self.layers = net, positive, net.layers

    def sums(self, x: np.ndarray, y: np.ndarray, target: np.ndarray, draws) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(_through(self.layers, x, draws)[:, 0])
        _back(self.layers, ((p - y) * np.where(y == 1, self.positive, 1.0))[:, None])
        return _flat(self.layers, "g")[None], np.array([len(y)], float)


class _Two:
    """Sums for the chance over all rows, and for the families over the positives."""

    def __init__(self, net: TwoHeads):
        self.net, self.layers = net, [*net.trunk, *net.heads]

    def sums(self, x: np.ndarray, y: np.ndarray, target: np.ndarray, draws) -> tuple[np.ndarray, np.ndarray]:
        net = self.net
        z = _through(net.trunk, x, draws)
        p, q = _sigmoid(net.heads[0].forward(z)[:, 0]), _softmax(net.heads[1].forward(z))
        positive, k = y == 1, q.shape[1]
        wish = np.full((len(y), k), net.smoothing / k)
        wish[np.arange(len(y)), target] += 1 - net.smoothing
        out = []
        for head, slope in ((0, (p - y)[:, None]), (1, (q - wish) * positive[:, None] * net.family_weight)):
            other = net.heads[1 - head]
            other.g = {name: np.zeros_like(v) for name, v in other.p.items()}
            _back(net.trunk, net.heads[head].backward(slope))
            out.append(_flat(self.layers, "g"))
        return np.array(out), np.array([len(y), positive.sum()], float)


def _stepped(loss, optimiser: AdamW, sums: np.ndarray, counts: np.ndarray, share: float) -> None:
    _unflat(loss.layers, (sums / np.maximum(1, counts)[:, None]).sum(0), "g")
    optimiser.step(share)


_SUMS = "task long, sums binary, counts array<double>"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b) for b in pdf["sums"]], 0)
    return pd.DataFrame({"task": pdf["task"].iloc[:1], "sums": [total.tobytes()], "counts": [np.sum(pdf["counts"].tolist(), 0)]})


def _fit(data: DataFrame, loss, rounds: int, batches: int, optimiser: AdamW, shares: Sequence[float]) -> None:
    """Steps over written (h, x, y, target)."""
    context, step = data.sparkSession.sparkContext, 0
    groups = max(1, math.isqrt(data.select(F.spark_partition_id().alias("p")).distinct().count()))
    for t in range(rounds):
        turn = F.pmod(F.xxhash64("h", F.lit(t)), F.lit(batches))
        for b in range(batches):
            step += 1
            shared = context.broadcast(loss)

            def run(parts: Iterator[pd.DataFrame], shared=shared, step=step) -> Iterator[pd.DataFrame]:
                own, sums, counts = shared.value, None, None
                for pdf in parts:
                    if len(pdf):
                        found, n = own.sums(np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(float), pdf["target"].to_numpy(int), RowDraws(pdf["h"].to_numpy(np.int64), step))
                        sums, counts = (found, n) if sums is None else (sums + found, counts + n)
                if sums is not None:
                    yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [sums.ravel().tobytes()], "counts": [counts]})

            found = data.filter(turn == b).mapInPandas(run, _SUMS)
            rows = found.groupBy(F.pmod("task", F.lit(groups))).applyInPandas(_added, _SUMS).collect()
            shared.unpersist()
            if rows:
                counts = np.sum([r["counts"] for r in rows], 0)
                _stepped(loss, optimiser, np.sum([np.frombuffer(r["sums"]) for r in rows], 0).reshape(len(counts), -1), counts, shares[t])


def _data(rows: DataFrame, vector: str, label: str, id_col: str, target=None) -> DataFrame:
    own = rows.select(
        F.xxhash64(id_col).alias("h"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.lit(0) if target is None else target).alias("target")
    )
    return materialize(own.filter(rows[id_col].isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()), "training-rows")


def fit_hidden_layer(rows: DataFrame, vector: str, label: str, id_col: str, rounds: int = 30, batches: int = 8, hidden: int = 256, dropout: float = 0.2, rate: float = 1e-3, seed: int = 42) -> HiddenLayer:
    """A network of one hidden layer fitted to all rows; without rows an error."""
    data = _data(rows, vector, label, id_col)
    n, positives, width = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to fit to")
    net = HiddenLayer(hidden, dropout, rate, rounds, seed=seed).empty(width)
    _fit(data, _Hidden(net, (n - positives) / (positives + 1e-5)), rounds, batches, AdamW(net.layers, rate), [1.0] * rounds)
    discard(data)
    return net


def fit_two_heads(rows: DataFrame, vector: str, label: str, family: str, id_col: str, batches: int = 8, **options) -> TwoHeads:
    """``TwoHeads`` fitted to all rows; families are those of the positives, whose names come to the driver."""
    net = TwoHeads(**options)
    names = rows.filter((F.col(label) == 1) & F.col(family).isNotNull() & (F.col(family) != "")).select(family).distinct()
    net.families = sorted(r[0] for r in names.collect())
    place = F.array_position(F.array(*[F.lit(f) for f in net.families]), F.col(family)) - 1 if net.families else F.lit(0)
    data = _data(rows, vector, label, id_col, F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int"))
    width = data.agg(F.max(F.size("x"))).first()[0]
    if not width:
        raise ValueError("no rows to fit to")
    net.empty(width)
    loss = _Two(net)
    _fit(data, loss, net.rounds, batches, AdamW(loss.layers, net.rate), [0.5 * (1 + np.cos(np.pi * t / net.rounds)) for t in range(net.rounds)])
    discard(data)
    return net
