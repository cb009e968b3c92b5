"""Small networks over embedding columns, model profiles, and profiles of protein families.

Networks are plain numpy: fitted on a bounded sample of labelled rows, whose bound is a parameter, and applied
in the cluster in Arrow batches.  No weights are shipped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.functions import boundary_kernels as K
from mobilome.functions.sequence import kmers

#: Labelled rows of each class that a network is fitted to at most.
PER_CLASS = 20_000


class EmbeddingClassifier(Protocol):
    """A function from a batch of vectors (n, d) to scores (n,)."""

    def __call__(self, vectors: np.ndarray) -> np.ndarray: ...


# --- layers: each keeps what its backward step needs, and its parameters in ``p`` with gradients in ``g``

# The rational approximation of the error function, right to 1.5e-7.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def error_function(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + ERF_SCALE * np.abs(x))
    total = np.zeros_like(t)
    for term in reversed(ERF_TERMS):
        total = (total + term) * t
    return np.sign(x) * (1 - total * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + error_function(x / np.sqrt(2)))


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + error_function(x / np.sqrt(2))) + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


class Dense:
    def __init__(self, rng: np.random.Generator, n: int, m: int):
        bound = 1 / np.sqrt(n)
        self.p = {"w": rng.uniform(-bound, bound, (n, m)), "b": rng.uniform(-bound, bound, m)}

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        self.x = x
        return x @ self.p["w"] + self.p["b"]

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.g = {"w": self.x.T @ d, "b": d.sum(0)}
        return d @ self.p["w"].T


class Normed:
    """Layer normalisation."""

    def __init__(self, n: int):
        self.p = {"s": np.ones(n), "b": np.zeros(n)}

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        self.sd = np.sqrt(x.var(1, keepdims=True) + 1e-5)
        self.z = (x - x.mean(1, keepdims=True)) / self.sd
        return self.z * self.p["s"] + self.p["b"]

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.g = {"s": (d * self.z).sum(0), "b": d.sum(0)}
        d = d * self.p["s"]
        return (d - d.mean(1, keepdims=True) - self.z * (d * self.z).mean(1, keepdims=True)) / self.sd


class Gelu:
    p: dict = {}
    g: dict = {}

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        self.x = x
        return gelu(x)

    def backward(self, d: np.ndarray) -> np.ndarray:
        return d * _gelu_slope(self.x)


class Dropout:
    """Active only where a random generator is given."""

    p: dict = {}
    g: dict = {}

    def __init__(self, share: float):
        self.share = share

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        self.mask = 1.0 if rng is None else (rng.random(x.shape) >= self.share) / (1 - self.share)
        return x * self.mask

    def backward(self, d: np.ndarray) -> np.ndarray:
        return d * self.mask


def _through(layers, x: np.ndarray, rng=None) -> np.ndarray:
    for layer in layers:
        x = layer.forward(x, rng)
    return x


def _back(layers, d: np.ndarray) -> np.ndarray:
    for layer in reversed(layers):
        d = layer.backward(d)
    return d


class AdamW:
    def __init__(self, layers, rate: float = 1e-3, decay: float = 1e-4):
        self.layers, self.rate, self.decay, self.t = layers, rate, decay, 0
        self.m = [{k: np.zeros_like(v) for k, v in layer.p.items()} for layer in layers]
        self.v = [{k: np.zeros_like(v) for k, v in layer.p.items()} for layer in layers]

    def step(self, share: float = 1.0) -> None:
        self.t += 1
        for layer, m, v in zip(self.layers, self.m, self.v):
            for k in layer.p:
                m[k] = 0.9 * m[k] + 0.1 * layer.g[k]
                v[k] = 0.999 * v[k] + 0.001 * layer.g[k] ** 2
                move = (m[k] / (1 - 0.9**self.t)) / (np.sqrt(v[k] / (1 - 0.999**self.t)) + 1e-8)
                layer.p[k] = layer.p[k] - self.rate * share * (move + self.decay * layer.p[k])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def bounded_sample(rows: DataFrame, columns: Sequence[str], label: str, id_col: str, per_class: int) -> pd.DataFrame:
    """At most ``per_class`` rows of each class, those with the smallest hashes of their ids."""
    parts = [rows.filter(F.col(label) == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class).select(*columns, label) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).toPandas()


# --- one hidden layer


class HiddenLayer:
    """Probability by one hidden layer of GELU units, fitted with class-balanced cross-entropy and AdamW."""

    def __init__(self, hidden: int = 256, dropout: float = 0.2, rate: float = 1e-3, rounds: int = 30, batch: int = 64, seed: int = 42):
        self.hidden, self.dropout, self.rate, self.rounds, self.batch, self.seed = hidden, dropout, rate, rounds, batch, seed

    def empty(self, width: int) -> HiddenLayer:
        """The layers before any step."""
        self.rng = rng = np.random.default_rng(self.seed)
        self.layers = [Dense(rng, width, self.hidden), Gelu(), Dropout(self.dropout), Dense(rng, self.hidden, 1)]
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> HiddenLayer:
        rng = self.empty(x.shape[1]).rng
        optimiser, positive = AdamW(self.layers, self.rate), (len(y) - y.sum()) / (y.sum() + 1e-5)
        for _ in range(self.rounds):
            order = rng.permutation(len(x))
            for a in range(0, len(x), self.batch):
                i = order[a : a + self.batch]
                p = _sigmoid(_through(self.layers, x[i], rng)[:, 0])
                _back(self.layers, ((p - y[i]) * np.where(y[i] == 1, positive, 1.0) / len(i))[:, None])
                optimiser.step()
        return self

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return _sigmoid(_through(self.layers, vectors)[:, 0])


def fit_hidden_layer(rows: DataFrame, vector: str, label: str, id_col: str, per_class: int = PER_CLASS, **options) -> HiddenLayer:
    found = bounded_sample(rows, [vector], label, id_col, per_class)
    return HiddenLayer(**options).fit(np.array(found[vector].tolist(), float), found[label].to_numpy(float))


def score_vectors(rows: DataFrame, vector: str, model: EmbeddingClassifier, dimension: int | None = None) -> DataFrame:
    """``rows`` with ``score``; null vectors have none, and a wrong dimension is an error."""

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        some = vectors.notna()
        if dimension is not None and (vectors[some].map(len) != dimension).any():
            raise ValueError(f"expected {dimension} dimensions")
        out = pd.Series(np.nan, index=vectors.index, dtype="Float64")
        out[~some] = pd.NA
        if some.any():
            out[some] = model(np.array(vectors[some].tolist(), float))
        return out

    return rows.withColumn("score", score(F.col(vector)))


# --- shared trunk with two heads


@dataclass
class TwoHeads:
    """Binary probability and family probabilities from one trunk."""

    hidden: int = 256
    dropout: float = 0.2
    rate: float = 1e-3
    rounds: int = 20
    batch: int = 128
    family_weight: float = 1.2
    smoothing: float = 0.05
    seed: int = 42
    families: list[str] = field(default_factory=list)

    def empty(self, width: int) -> TwoHeads:
        """The layers before any step; ``families`` are known."""
        self.rng = rng = np.random.default_rng(self.seed)
        h = self.hidden
        self.trunk = [Dense(rng, width, h), Normed(h), Gelu(), Dropout(self.dropout), Dense(rng, h, h // 2), Normed(h // 2), Gelu(), Dropout(self.dropout)]
        self.heads = Dense(rng, h // 2, 1), Dense(rng, h // 2, max(1, len(self.families)))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, family: Sequence[str | None]) -> TwoHeads:
        """Families are those of the positives; family loss counts positives alone; the rate falls along a cosine."""
        self.families = sorted({f for f, b in zip(family, y) if b == 1 and f})
        k, place = max(1, len(self.families)), {f: i for i, f in enumerate(self.families)}
        target = np.array([place.get(f, 0) for f in family])
        rng = self.empty(x.shape[1]).rng
        optimiser = AdamW([*self.trunk, *self.heads], self.rate)
        for t in range(self.rounds):
            order = rng.permutation(len(x))
            for a in range(0, len(x), self.batch):
                i = order[a : a + self.batch]
                z = _through(self.trunk, x[i], rng)
                p, q = _sigmoid(self.heads[0].forward(z)[:, 0]), _softmax(self.heads[1].forward(z))
                positive = y[i] == 1
                wish = np.full((len(i), k), self.smoothing / k)
                wish[np.arange(len(i)), target[i]] += 1 - self.smoothing
                slope = (q - wish) * positive[:, None] * self.family_weight / max(1, positive.sum())
                d = self.heads[0].backward(((p - y[i]) / len(i))[:, None]) + self.heads[1].backward(slope)
                _back(self.trunk, d)
                optimiser.step(0.5 * (1 + np.cos(np.pi * t / self.rounds)))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _through(self.trunk, x)
        return _sigmoid(self.heads[0].forward(z)[:, 0]), _softmax(self.heads[1].forward(z))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def score_two_heads(rows: DataFrame, vector: str, model: TwoHeads, dimension: int, threshold: float = 0.5) -> DataFrame:
    """``rows`` with ``score``, and ``top_family`` and ``family_score`` where the score reaches the threshold; a wrong dimension is an error."""

    @F.pandas_udf("score double, top_family string, family_score double")
    def run(vectors: pd.Series) -> pd.DataFrame:
        if (vectors.map(len) != dimension).any():
            raise ValueError(f"expected {dimension} dimensions")
        p, q = model.predict(np.array(vectors.tolist(), float).reshape(len(vectors), dimension))
        best = q.argmax(1)
        names = [model.families[i] if s >= threshold and model.families else None for i, s in zip(best, p)]
        return pd.DataFrame({"score": p, "top_family": names, "family_score": [float(x) if n else None for n, x in zip(names, q.max(1))]})

    return rows.withColumn("_m", run(F.col(vector))).select(*rows.columns, "_m.*")


# --- profiles of models


@dataclass(frozen=True)
class ModelProfile:
    name: str
    model_key: str
    classifier: str
    dimension: int


#: Models by key: dimension, layers and the layout of their input.
MODELS = {
    "plm_8m": {"dimension": 320, "layers": 6, "layout": "standard"},
    "plm_35m": {"dimension": 480, "layers": 12, "layout": "standard"},
    "structure_aware_35m": {"dimension": 480, "layers": 12, "layout": "hashed"},
}
PROFILES = {"fast": ModelProfile("fast", "plm_8m", "linear", 320), "standard": ModelProfile("standard", "plm_35m", "two_heads", 480)}


def resolve_profile(name: str, metadata: dict) -> ModelProfile:
    """The profile of a name; metadata of its classifier must name its model and dimension."""
    if name not in PROFILES:
        raise ValueError(f"unsupported screening profile: {name}")
    profile = PROFILES[name]
    for key, want in (("model_key", profile.model_key), ("embedding_dimension", profile.dimension)):
        if metadata.get(key) != want:
            raise ValueError(f"classifier metadata mismatch in {key}: {metadata.get(key)} is not {want}")
    return profile


def throughput(engine: Callable[[list[str]], np.ndarray], sequences: Sequence[str], batch: int = 32, most: int = 500) -> float:
    """Sequences a second of an embedding engine over ``most`` sequences: a probe, not a run."""
    some = list(sequences[:most])
    began = time.perf_counter()
    for a in range(0, len(some), batch):
        engine(some[a : a + batch])
    return len(some) / max(time.perf_counter() - began, 1e-9)


# --- boundary refiner


def _convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int = 1) -> np.ndarray:
    """(channels, n) convolved with (out, channels, k) at the same length."""
    k = w.shape[2]
    pad = (k - 1) * dilation // 2
    x = np.pad(x, ((0, 0), (pad, pad)))
    n = x.shape[1] - (k - 1) * dilation
    return sum(w[:, :, i] @ x[:, i * dilation : i * dilation + n] for i in range(k)) + b[:, None]


def _scaled(x: np.ndarray, weights: dict, name: str) -> np.ndarray:
    """Batch normalisation with the running moments."""
    s = weights[f"{name}.weight"] / np.sqrt(weights[f"{name}.var"] + 1e-5)
    return x * s[:, None] + (weights[f"{name}.bias"] - weights[f"{name}.mean"] * s)[:, None]


def refiner_network(weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(logit of every place, offset) of a one-hot window by a stem and three residual blocks of growing dilation."""
    x = gelu(_scaled(_convolved(x, weights["stem.w"], weights["stem.b"]), weights, "stem.norm"))
    for name, dilation in (("one", 1), ("two", 2), ("three", 4)):
        way = x
        if f"{name}.side.w" in weights:
            way = _scaled(_convolved(x, weights[f"{name}.side.w"], weights[f"{name}.side.b"]), weights, f"{name}.side.norm")
        y = gelu(_scaled(_convolved(x, weights[f"{name}.a.w"], weights[f"{name}.a.b"], dilation), weights, f"{name}.a.norm"))
        x = gelu(_scaled(_convolved(y, weights[f"{name}.b.w"], weights[f"{name}.b.b"], dilation), weights, f"{name}.b.norm") + way)
    logits = _convolved(x, weights["junction.w"], weights["junction.b"])[0]
    hidden = gelu(x.mean(1) @ weights["offset.a.w"] + weights["offset.a.b"])
    return logits, float((hidden @ weights["offset.b.w"] + weights["offset.b.b"])[0])


def refiner(network: Callable[[np.ndarray], tuple[np.ndarray, float]], window: int = 128) -> Callable[[str, int, bool, int], tuple[int, float]]:
    """A refiner for the hybrid engine: (offset, confidence) of an end from a network over the window around it.

    The offset is 0.6 of the peak's and 0.4 of the regression's, held within the reach; the confidence is twice the peak's chance.
    """
    half = window // 2

    def refine(contig: str, place: int, is_left: bool, reach: int) -> tuple[int, float]:
        piece = "N" * max(0, half - place) + contig[max(0, place - half) : min(len(contig), place + half)]
        logits, offset = network(K.one_hot(piece, window))
        chance = _softmax(logits)
        peak = int(chance.argmax())
        move = int(np.clip(round(0.6 * (peak - half) + 0.4 * offset), -reach, reach))
        return max(0, min(len(contig), place + move)) - place, float(np.clip(2 * chance[peak], 0, 1))

    return refine


def refiner_windows(elements: DataFrame, contig: str, place: str, key: str, per_element: int = 2, most: int = 25, window: int = 128, seed: str = "42") -> DataFrame:
    """Training windows around known ends moved by up to ``most`` bases: (key, sequence, junction, offset)."""
    half = window // 2
    turn = F.explode(F.sequence(F.lit(0), F.lit(per_element - 1))).alias("_t")
    u = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("_t").cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    moved = elements.select(key, F.col(contig).alias("_c"), F.col(place).alias("_p"), turn).withColumn("offset", (u % (2 * most + 1) - most).cast("int"))
    centre = F.col("_p") - F.col("offset")
    cut = moved.withColumn("_m", centre).filter((F.col("_m") >= half) & (F.col("_m") + half <= F.length("_c")))
    return cut.select(key, F.substr("_c", F.col("_m") - half + 1, F.lit(window)).alias("sequence"), (F.col("offset") + half).alias("junction"), "offset")


class Convolution:
    """(batch, channels, n) to (batch, out, n)."""

    def __init__(self, rng: np.random.Generator, channels: int, out: int, k: int, dilation: int = 1):
        bound = 1 / np.sqrt(channels * k)
        self.p = {"w": rng.uniform(-bound, bound, (out, channels, k)), "b": rng.uniform(-bound, bound, out)}
        self.k, self.dilation = k, dilation

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        pad, n = (self.k - 1) * self.dilation // 2, x.shape[2]
        wide = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
        self.columns = np.stack([wide[:, :, i * self.dilation : i * self.dilation + n] for i in range(self.k)], axis=2)
        return np.einsum("ock,bckn->bon", self.p["w"], self.columns, optimize=True) + self.p["b"][:, None]

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.g = {"w": np.einsum("bon,bckn->ock", d, self.columns, optimize=True), "b": d.sum((0, 2))}
        back = np.einsum("ock,bon->bckn", self.p["w"], d, optimize=True)
        pad, n = (self.k - 1) * self.dilation // 2, d.shape[2]
        wide = np.zeros((d.shape[0], back.shape[1], n + 2 * pad))
        for i in range(self.k):
            wide[:, :, i * self.dilation : i * self.dilation + n] += back[:, :, i]
        return wide[:, :, pad : pad + n]


class BatchNormed:
    """Normalisation of every channel over batch and places; running moments are kept for use."""

    def __init__(self, channels: int):
        self.p = {"weight": np.ones(channels), "bias": np.zeros(channels)}
        self.mean, self.var = np.zeros(channels), np.ones(channels)

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        mean, var = x.mean((0, 2)), x.var((0, 2))
        self.mean, self.var = 0.9 * self.mean + 0.1 * mean, 0.9 * self.var + 0.1 * var
        self.sd = np.sqrt(var + 1e-5)[:, None]
        self.z = (x - mean[:, None]) / self.sd
        return self.z * self.p["weight"][:, None] + self.p["bias"][:, None]

    def backward(self, d: np.ndarray) -> np.ndarray:
        self.g = {"weight": (d * self.z).sum((0, 2)), "bias": d.sum((0, 2))}
        d = d * self.p["weight"][:, None]
        mean = lambda v: v.mean((0, 2), keepdims=True)[0]
        return (d - mean(d) - self.z * mean(d * self.z)) / self.sd


class Residual:
    """Two convolutions beside a way around them."""

    def __init__(self, rng: np.random.Generator, channels: int, out: int, dilation: int):
        self.main = [Convolution(rng, channels, out, 5, dilation), BatchNormed(out), Gelu(), Convolution(rng, out, out, 5, dilation), BatchNormed(out)]
        self.side = [Convolution(rng, channels, out, 1), BatchNormed(out)] if channels != out else []
        self.end = Gelu()

    def layers(self) -> list:
        return [*self.main, *self.side]

    def forward(self, x: np.ndarray, rng=None) -> np.ndarray:
        return self.end.forward(_through(self.main, x) + _through(self.side, x))

    def backward(self, d: np.ndarray) -> np.ndarray:
        d = self.end.backward(d)
        return _back(self.main, d) + _back(self.side, d)


class RefinerTraining:
    """Fits the weights of ``refiner_network``: cross-entropy of the junction's place and half a Huber loss of the offset."""

    def __init__(self, channels: int = 32, seed: int = 42):
        rng = np.random.default_rng(seed)
        c = channels
        self.stem = [Convolution(rng, 4, c, 7), BatchNormed(c), Gelu()]
        self.blocks = [Residual(rng, c, c, 1), Residual(rng, c, 2 * c, 2), Residual(rng, 2 * c, 2 * c, 4)]
        self.junction = Convolution(rng, 2 * c, 1, 1)
        self.offset = [Dense(rng, 2 * c, 32), Gelu(), Dense(rng, 32, 1)]
        self.rng = rng

    def layers(self) -> list:
        return [*self.stem, *(layer for b in self.blocks for layer in b.layers()), self.junction, *self.offset]

    def step(self, x: np.ndarray, place: np.ndarray, offset: np.ndarray) -> float:
        """The loss of a batch, with gradients left in the layers."""
        z = _through([*self.stem, *self.blocks], x)
        n, rows = z.shape[2], np.arange(len(x))
        q = _softmax(self.junction.forward(z)[:, 0])
        miss = _through(self.offset, z.mean(2))[:, 0] - offset
        d = q.copy()
        d[rows, place] -= 1
        flat = _back(self.offset, (0.5 * np.clip(miss, -1, 1) / len(x))[:, None])
        _back([*self.stem, *self.blocks], self.junction.backward(d[:, None] / len(x)) + np.repeat(flat[:, :, None] / n, n, axis=2))
        huber = np.where(np.abs(miss) <= 1, 0.5 * miss**2, np.abs(miss) - 0.5)
        return float(-np.log(q[rows, place] + 1e-12).mean() + 0.5 * huber.mean())

    def fit(self, x: np.ndarray, place: np.ndarray, offset: np.ndarray, rounds: int = 20, batch: int = 32, rate: float = 1e-3) -> list[float]:
        """Mean loss of every round."""
        optimiser, out = AdamW(self.layers(), rate), []
        for _ in range(rounds):
            order, losses = self.rng.permutation(len(x)), []
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                losses.append(self.step(x[i], place[i], offset[i]))
                optimiser.step()
            out.append(float(np.mean(losses)))
        return out

    def weights(self) -> dict[str, np.ndarray]:
        """What ``refiner_network`` takes."""
        out: dict[str, np.ndarray] = {}

        def put(name: str, convolution: Convolution, norm: BatchNormed | None = None) -> None:
            out.update({f"{name}.w": convolution.p["w"], f"{name}.b": convolution.p["b"]})
            if norm is not None:
                at = "stem" if name == "stem" else name
                out.update({f"{at}.norm.weight": norm.p["weight"], f"{at}.norm.bias": norm.p["bias"], f"{at}.norm.mean": norm.mean, f"{at}.norm.var": norm.var})

        put("stem", self.stem[0], self.stem[1])
        for name, b in zip(("one", "two", "three"), self.blocks):
            put(f"{name}.a", b.main[0], b.main[1])
            put(f"{name}.b", b.main[3], b.main[4])
            if b.side:
                put(f"{name}.side", b.side[0], b.side[1])
        put("junction", self.junction)
        out.update({f"offset.{n}.{k}": layer.p[k] for n, layer in (("a", self.offset[0]), ("b", self.offset[2])) for k in ("w", "b")})
        return out


def fit_refiner(windows: DataFrame, key: str, most: int = 20_000, channels: int = 32, rounds: int = 20, **options) -> dict[str, np.ndarray]:
    """Weights of the refiner fitted to at most ``most`` windows of ``refiner_windows``, those with the smallest hashes."""
    found = windows.orderBy(F.xxhash64(key, "offset"), key, "offset").limit(most).select("sequence", "junction", "offset").toPandas()
    x = np.array([K.one_hot(s, len(s)) for s in found["sequence"]], float)
    training = RefinerTraining(channels)
    training.fit(x, found["junction"].to_numpy(int), found["offset"].to_numpy(float), rounds, **options)
    return training.weights()


# --- profiles of protein families


def family_profiles(proteins: DataFrame, family: str, sequence: str, k: int = 3, least: int = 3) -> DataFrame:
    """(family, word, weight): log2 odds of every word of a family of at least ``least`` members against all proteins, with one added count.

    A stand-in for profiles from alignments, built by aggregation alone.
    """
    big = proteins.groupBy(F.col(family).alias("_f")).agg(F.count(F.lit(1)).alias("_members")).filter(F.col("_members") >= least)
    words = proteins.select(F.col(family).alias("family"), F.explode(kmers(F.upper(F.col(sequence)), k)).alias("word"))
    counts = words.groupBy("family", "word").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy("word").agg(F.sum("n").alias("all"))
    sizes = counts.groupBy("family").agg(F.sum("n").alias("family_n"))
    total = overall.agg(F.sum("all").alias("total"), F.count(F.lit(1)).alias("words"))
    joined = counts.join(big.select("_f"), F.col("family") == F.col("_f"), "left_semi").join(overall, "word").join(sizes, "family").join(F.broadcast(total))
    odds = ((F.col("n") + 1) / (F.col("family_n") + F.col("words"))) / ((F.col("all") + 1) / (F.col("total") + F.col("words")))
    return joined.select("family", "word", F.log2(odds).alias("weight"))


def profile_scores(proteins: DataFrame, id_col: str, sequence: str, profiles: DataFrame, k: int = 3) -> DataFrame:
    """The best family of every protein with its bits: the sum of the weights of its distinct words, where it is above zero."""
    words = proteins.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(kmers(F.upper(F.col(sequence)), k))).alias("word"))
    bits = words.join(profiles, "word").groupBy("query", "family").agg(F.sum("weight").alias("bits")).filter("bits > 0")
    best = Window.partitionBy("query").orderBy(F.round("bits", 9).desc(), "family")
    return bits.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def leave_one_family_out(rows: DataFrame, folds: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], families: Sequence) -> DataFrame:
    """Test rows of every fold with their ``score``: ``fit`` gets a fold's training rows and gives a scorer of rows."""
    out = None
    for f in families:
        fold = folds.filter(F.col("fold") == f)
        scored = fit(fold.filter("role = 'train'"))(fold.filter("role = 'test'"))
        out = scored if out is None else out.unionByName(scored)
    return out


def macro_means(per_family: DataFrame, size: str, columns: Sequence[str], least: int = 30) -> DataFrame:
    """One row: the families of at least ``least`` members, and the plain means of ``columns`` over them."""
    big: Column = F.col(size) >= least
    return per_family.filter(big).agg(F.count(F.lit(1)).alias("families"), F.sum(size).alias("members"), *[F.avg(c).alias(f"macro_{c}") for c in columns])
