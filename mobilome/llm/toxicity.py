"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's chance of being toxic is a
logistic function of its words and their beginnings; a document is toxic if any
sentence is (noisy-or), and the weights are fitted to document labels through
that noisy-or alone.  The same weights then point out the offending sentences.

It is fitted to a bounded sample, at most PER_CLASS documents and MOST_CHARS characters a class.

Defined results: null and empty texts have no sentence and score 0; very long texts are scored whole; a null id is
never held out; a document with contradicting labels is not learnt from; with no
usable label of either class every score is 0; a repeated row is scored alike; an
empty table gives an empty result.  Of documents with equal hashes the smaller id is sampled first, of rows with one id the least
text.  Other columns than the id and the text, whatever their names, are not read.
A document of more than a twentieth of the sample's characters is never learnt from, but scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.llm.labelled import held_out, training_sample

FOLD = (3, 1)
#: Labelled documents of each class that are fitted at most.
PER_CLASS = 5_000
#: A feature is fitted if its log-odds are so many standard errors above zero, over so many toxic documents.
LEAST_Z, LEAST_DOCS = 2.0, 3
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
FLAGGED = 0.5
#: Words whose weight a worker remembers.
REMEMBERED = 500_000


def features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass"))]
    out += [zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) > n]
    return out


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def _occurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each feature once per document, with the document's label."""
    for pdf in batches:
        found, ys = [], []
        for text, y in zip(pdf["text"], pdf["y"]):
            own = {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}
            found += own
            ys += [int(y)] * len(own)
        yield pd.DataFrame({"feature": np.array(found, np.int64), "y": np.array(ys, np.int32)})


def telling_features(sample: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for toxic documents (sorted), and the log-odds of each, counted in the cluster.

    Under noisy-or no word makes a sentence elsewhere in the document cleaner, so
    only evidence for the class is of use.
    """
    counts = sample.mapInPandas(_occurring, "feature long, y int").groupBy("feature").agg(
        F.sum("y").cast("double").alias("in1"), F.sum(1 - F.col("y")).cast("double").alias("in0")
    )
    odds = F.log((F.col("in1") + 0.5) / (n1 + 1)) - F.log((F.col("in0") + 0.5) / (n0 + 1))
    z = odds / F.sqrt(1 / (F.col("in1") + 0.5) + 1 / (F.col("in0") + 0.5))
    told = counts.filter((F.col("in1") >= LEAST_DOCS) & (z >= LEAST_Z)).select("feature", odds.alias("odds")).toPandas()
    order = np.argsort(told["feature"].to_numpy(np.int64))
    return told["feature"].to_numpy(np.int64)[order], told["odds"].to_numpy(float)[order]


def _bags(known: np.ndarray):
    place = {int(f): i for i, f in enumerate(known)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["text"], pdf["y"]):
                found, owner = [], []
                bags = sentences(text or "")
                for i, (_, _, words) in enumerate(bags):
                    hit = [place[f] for w in words for f in features(w) if f in place]
                    found += hit
                    owner += [i] * len(hit)
                rows.append((int(y), len(bags), np.array(found, "<i4").tobytes(), np.array(owner, "<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["y", "n", "features", "sentence"])

    return run


def fit_bags(
    bag: np.ndarray, place: np.ndarray, odds: np.ndarray, doc_of_bag: np.ndarray, y: np.ndarray, weight: np.ndarray,
    rounds: int = 300, rate: float = 0.05, ridge: float = 1e-5,
) -> np.ndarray:
    """Weights of the features, then the bias, by Adam on the noisy-or likelihood.

    ``bag`` and ``place`` have one entry per occurrence of a feature in a sentence;
    ``doc_of_bag`` gives each sentence's document.
    """
    n_bags = len(doc_of_bag)
    theta = np.append(np.clip(odds, -1, 1) * 0.5, -4.0)
    m = v = np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(bag, theta[place], n_bags)
        exposure = np.bincount(doc_of_bag, np.logaddexp(0, z), len(y))
        # d loss / d exposure: 1 for clean documents, -e/(1-e) for toxic ones.
        none = np.exp(-np.maximum(exposure, 1e-9))
        slope = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight / total
        g = slope[doc_of_bag] * np.exp(-np.logaddexp(0, -z))
        grad = np.append(np.bincount(place, g[bag], len(odds)), g.sum())
        grad[:-1] += ridge * theta[:-1] / np.sqrt(len(y))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[int, float], float] | None:
    """Fit the sentence scorer on a bounded sample; None if a class has no document."""
    sample, sizes = training_sample(docs, labels, "toxic", FOLD, per_class)
    n = {int(r["y"]): int(r["count"]) for r in sample.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    known, odds = telling_features(sample, n[1], n[0])
    bags = sample.select("y", "text").mapInPandas(_bags(known), "y int, n int, features binary, sentence binary").toPandas()
    y, per_doc = bags["y"].to_numpy(np.int64), bags["n"].to_numpy(np.int64)
    first = np.cumsum(per_doc) - per_doc
    bag = np.concatenate([np.frombuffer(b, "<i4") + a for b, a in zip(bags["sentence"], first)]).astype(np.int64)
    place = np.concatenate([np.frombuffer(b, "<i4") for b in bags["features"]]).astype(np.int64)
    # The sample holds classes evenly; weights restore their shares.
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    theta = fit_bags(bag, place, odds, np.repeat(np.arange(len(y)), per_doc), y, weight)
    return {int(f): float(w) for f, w in zip(known, theta) if abs(w) > 1e-3}, float(theta[-1])


class Scorer:
    def __init__(self, model: tuple[dict[int, float], float]):
        self.weights, self.bias = model
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        x = self.known.get(w)
        if x is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            x = self.known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's chance, and (start, end, chance) of the sentences that are more likely toxic than not."""
        flagged, clean = [], 0.0
        for a, b, words in sentences(text):
            z = self.bias + sum(map(self.word, words))
            z = min(max(z, -50.0), 50.0)
            p = 1 / (1 + np.exp(-z))
            clean -= np.log1p(np.exp(z))
            if p >= FLAGGED:
                flagged.append((a, b, float(p)))
        return float(-np.expm1(clean)) if clean else 0.0, flagged


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, score and ``sentences``, the offending ones as (start, end, score)."""
    model = train(docs, labels, per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model else None
        for pdf in batches:
            found = [scorer.score(t or "") if scorer else (0.0, []) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "score": [s for s, _ in found],
                    "sentences": [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found],
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), *FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("sentences").alias("n_flagged"),
    )
