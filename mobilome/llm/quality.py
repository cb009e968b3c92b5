"""Line quality by a linear-chain conditional random field.

Every line of a document is labelled good or bad.  Emissions use the line's own
features and those of the lines before and after it; transitions join
neighbouring labels.  The chain is fitted to document labels, given to all
lines.  For a document, the forward-backward marginals of its lines, weighted by
length, give the share of good text, which a logistic curve turns into a score.
It is fitted to a bounded sample, at most PER_CLASS documents and MOST_CHARS characters a class.

Defined results: lines without a word are left out; very long texts are scored whole; null and empty texts have
none and get the score of a document half good; a null id is never held out; a
document with contradicting labels is not learnt from; with no usable label of
either class every score is 0.5; a repeated row is scored alike; an empty table
gives an empty result.  Of documents with equal hashes the smaller id is sampled first, of rows with one id the least text.  Other columns than the id
and the text, whatever their names, are not read; names that clash with those used inside are none of them.
A document of more than a twentieth of the sample's characters is never learnt from, but scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.labelled import held_out, training_sample

FOLD = (4, 2)
#: Labelled documents of each class that are fitted at most.
PER_CLASS = 3_000
SYMBOL = re.compile(r"[^\w\s]")
TAIL = re.compile(r"[^\w\s]{2,}(?=\s|\Z)")
UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿß]")
DIGIT = re.compile(r"\d")
N_OWN = 14


def line_features(lines: list[str]) -> np.ndarray:
    """(lines, N_OWN) own features, each between 0 and about 1."""
    out = np.zeros((len(lines), N_OWN))
    again = Counter(lines)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), len(line)
        distinct = set(words)
        letters = sum(map(len, words))
        symbols = len(SYMBOL.findall(line))
        triples = Counter(zip(words, words[1:], words[2:])) if n > 4 else None
        out[i] = (
            len(UPPER.findall(line)) / max(1, letters),
            symbols / max(1, letters),
            len(DIGIT.findall(line)) / max(1, letters),
            min(1.0, letters / n / 15),
            min(1.0, np.log1p(n) / 6),
            1 - len(distinct) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(triples) / (n - 2) if triples else 0.0,
            min(1.0, 2 * words.count("|") / n),
            len(TAIL.findall(line)) / n,
            again[line] > 1,
            len(distinct & seen) / len(distinct),
            line.rstrip()[-1:] in ".!?",
            min(1.0, size / 80) < 0.5,
        )
        seen |= distinct
    return out


def chain_features(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero beyond the ends), and a constant."""
    none = np.zeros((1, own.shape[1]))
    before = np.concatenate((none, own[:-1])) if len(own) else own
    after = np.concatenate((own[1:], none)) if len(own) else own
    edge = np.zeros((len(own), 2))
    if len(own):
        edge[0, 0] = edge[-1, 1] = 1
    return np.concatenate((own, before, after, edge, np.ones((len(own), 1))), axis=1)


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x and not x.isspace()]


class Chains:
    """Chains of unequal length side by side, longest first, one array per step."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        first = (np.cumsum(lengths) - lengths)[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        live = [int(np.searchsorted(-self.lengths, -t, side="left")) for t in range(steps)]
        #: Per step, the places of the lines of the chains that are that long.
        self.at = [first[:k] + t for t, k in enumerate(live)]

    def marginals(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transitions, and the sum of log partition functions.

        ``emission`` has the score of "good" over "bad"; ``transition`` is 2 x 2.
        """
        n = len(emission)
        e = np.stack((np.zeros(n), emission), axis=1)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        for t, at in enumerate(self.at):
            if t == 0:
                forward[at] = e[at]
            else:
                was = forward[self.at[t - 1][: len(at)]]
                forward[at] = e[at] + np.logaddexp(was[:, :1] + transition[0], was[:, 1:] + transition[1])
        for t in range(len(self.at) - 2, -1, -1):
            nxt = self.at[t + 1]
            here = self.at[t][: len(nxt)]
            x = e[nxt] + backward[nxt]
            backward[here] = np.logaddexp(transition[:, 0] + x[:, :1], transition[:, 1] + x[:, 1:])
        both = forward + backward
        norm = np.logaddexp(both[:, 0], both[:, 1])
        pairs = np.zeros((2, 2))
        for t in range(1, len(self.at)):
            at = self.at[t]
            was = self.at[t - 1][: len(at)]
            x = forward[was][:, :, None] + transition[None] + (e[at] + backward[at])[:, None, :] - norm[at][:, None, None]
            pairs += np.exp(x).sum(0)
        total = float(norm[self.at[0]].sum()) if self.at else 0.0
        return np.exp(both[:, 1] - norm), pairs, total


def fit_chain(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3):
    """(emission weights, transition matrix) by Adam on the likelihood of lines that all carry their document's label.

    ``weight`` is per document and scales its emission gradient.
    """
    chains = Chains(lengths)
    line_y, line_w = np.repeat(y, lengths), np.repeat(weight, lengths)
    n = max(1.0, line_w.sum())
    theta, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    want = np.zeros((2, 2))
    for c in (0, 1):
        want[c, c] = np.maximum(lengths[y == c] - 1, 0).sum()
    m = v = np.zeros(len(theta) + 4)
    for t in range(1, rounds + 1):
        good, pairs, _ = chains.marginals(x @ theta, transition)
        grad = np.append(x.T @ (line_w * (good - line_y)) / n, ((pairs - want) / max(1, want.sum())).ravel())
        grad += ridge * np.append(theta, transition.ravel())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta = theta - step[:-4]
        # Labels never change inside a training document, so the pull together is held in bounds.
        transition = np.clip(transition - step[-4:].reshape(2, 2), -1.0, 1.0)
    return theta, transition


def share_good(good: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document; 0.5 for those without lines."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(owner, size, len(lengths))
    part = np.bincount(owner, good * size, len(lengths))
    return np.where(total > 0, part / np.maximum(total, 1), 0.5)


def _curve(share: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the share's log-odds to the label."""
    x = np.stack((_log_odds(share), np.ones(len(share))), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, x.T @ (weight * (y - p)) - 1e-2 * w), -2, 2)
    return float(w[0]), float(w[1])


def _log_odds(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, y in zip(pdf["text"], pdf["y"]):
            lines = lines_of(text)
            rows.append((int(y), line_features(lines).astype("<f4").tobytes(), np.array([len(x) for x in lines], "<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["y", "own", "size"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(emission weights, transition, slope, offset), or None if a class has no document."""
    sample, sizes = training_sample(docs, labels, "quality", FOLD, per_class)
    found = sample.mapInPandas(_lines, "y int, own binary, size binary").toPandas()
    y = found["y"].to_numpy(np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    size = [np.frombuffer(b, "<f4").astype(float) for b in found["size"]]
    lengths = np.array([len(s) for s in size])
    x = np.concatenate([chain_features(np.frombuffer(b, "<f4").reshape(-1, N_OWN).astype(float)) for b in found["own"]])
    size = np.concatenate(size)
    weight = np.where(y == 1, sizes.get(1, 0) / (y == 1).sum(), sizes.get(0, 0) / (y == 0).sum())
    even = np.where(y == 1, 0.5 / max(1, lengths[y == 1].sum()), 0.5 / max(1, lengths[y == 0].sum())) * lengths.sum()
    theta, transition = fit_chain(x, lengths, y, even)
    good, _, _ = Chains(lengths).marginals(x @ theta, transition)
    return theta, transition, *_curve(share_good(good, size, lengths), y, weight)


def score_texts(model, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores, and per text the chance that each of its lines is good."""
    theta, transition, slope, offset = model
    found = [lines_of(t) for t in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    emission = [chain_features(line_features(x)) @ theta for x in found if x]
    emission = np.concatenate(emission) if emission else np.zeros(0)
    good, _, _ = Chains(lengths).marginals(emission, transition)
    size = np.array([len(x) for lines in found for x in lines], float)
    score = 1 / (1 + np.exp(-np.clip(slope * _log_odds(share_good(good, size, lengths)) + offset, -50, 50)))
    return score, np.split(good, np.cumsum(lengths)[:-1])


def scorer(model):
    """A function of a text column: struct of ``score`` and ``lines``, the chance of each non-blank line of being good."""

    @F.pandas_udf("score double, lines array<double>")
    def score(text: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in text]
        if model is None:
            return pd.DataFrame({"score": np.full(len(texts), 0.5), "lines": [[]] * len(texts)})
        found, lines = score_texts(model, texts)
        return pd.DataFrame({"score": found, "lines": [x.tolist() for x in lines]})

    return score


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, score and ``lines``."""
    score = scorer(train(docs, labels, per_class))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("q"))
    return scored.select("doc_id", "q.score", "q.lines")


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    scored = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), *FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
