"""Scoring and fitting over embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.functions.sequence import sigmoid


def linear_score(vector: Column, mean: Sequence[float], scale: Sequence[float], weights: Sequence[float], bias: float) -> Column:
    """Sigmoid of the standardised vector's product with the weights; a zero scale counts as one; a wrong length is an error."""
    d = len(weights)

    def constant(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    safe = [s if s else 1.0 for s in scale]
    factor = constant([w / s for w, s in zip(weights, safe)])
    shift = bias - sum(w * m / s for w, m, s in zip(weights, mean, safe))
    dot = F.aggregate(F.zip_with(vector.cast("array<double>"), factor, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(vector) == d, sigmoid(dot + F.lit(float(shift)))).otherwise(F.raise_error(F.lit(f"expected {d} dimensions")))


def standardise(rows: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each dimension, as two short lists."""
    e = rows.select(F.posexplode(vector).alias("i", "x"))
    found = e.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return [r["m"] for r in found], [r["s"] for r in found]


def fit_logistic(rows: DataFrame, vector: str, label: str, strength: float = 1.0, rounds: int = 25):
    """(weights, bias) of a class-balanced, L2-regularised logistic regression on standardised vectors.

    Newton steps; each round one job sums gradient and Hessian over all rows, so only
    d x d numbers come to the driver.  ``strength`` is the inverse regularisation.
    """
    mean, scale = standardise(rows, vector)
    mu, sd = np.array(mean), np.array([s or 1.0 for s in scale])
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    n = sum(counts.values())
    balance = {c: n / (len(counts) * k) for c, k in counts.items()}
    d = len(mean)
    w = np.zeros(d + 1)
    for _ in range(rounds):
        now = w.copy()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d + 1, d + 2))
            for pdf in batches:
                x = (np.array(pdf[vector].tolist(), float) - mu) / sd
                x = np.column_stack((x, np.ones(len(x))))
                y = pdf[label].to_numpy(float)
                c = np.array([balance[int(v)] for v in y])
                p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                total[:, :-1] += (x * (c * p * (1 - p))[:, None]).T @ x
                total[:, -1] += x.T @ (c * (y - p))
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        found = rows.select(vector, label).mapInPandas(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("v")).toPandas()
        t = np.zeros((d + 1) * (d + 2))
        t[found["cell"]] = found["v"]
        t = t.reshape(d + 1, d + 2)
        ridge = np.append(np.full(d, 1 / strength), 0.0)
        step = np.linalg.solve(t[:, :-1] + np.diag(ridge + 1e-9), t[:, -1] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (w[:-1].tolist(), float(w[-1])), (mean, scale)


def windowed_mean(vectors: Column, lengths: Column) -> Column:
    """Length-weighted mean of the vectors of a long sequence's windows."""
    weighted = F.zip_with(vectors, lengths, lambda v, n: F.transform(v, lambda x: x * n))
    total = F.aggregate(F.slice(weighted, 2, F.greatest(F.size(weighted) - 1, F.lit(0))), F.element_at(weighted, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    n = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b)
    return F.transform(total, lambda x: x / n)


def top_family(probabilities: Column, families: Sequence[str]) -> Column:
    """struct(family, probability) of the largest of a row's class probabilities; the first of equals."""
    best = F.array_max(probabilities)
    names = F.array(*[F.lit(f) for f in families])
    return F.struct(F.element_at(names, F.array_position(probabilities, best).cast("int")).alias("family"), best.alias("probability"))


def class_metrics(rows: DataFrame, truth: str, predicted: str, top3: Column) -> DataFrame:
    """One row: accuracy, share with the truth among the first three, and macro F1 over classes."""
    both = rows.select(F.col(truth).alias("t"), F.col(predicted).alias("p"), top3.cast("long").alias("in3"))
    sides = both.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), (F.col("t") == F.col("p")).cast("int").alias("ok")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_t"), F.lit(0).alias("ok")))).alias("s"), "in3")
    per = sides.groupBy("s.c").agg(F.sum("s.is_t").alias("n"), F.sum(1 - F.col("s.is_t")).alias("k"), F.sum("s.ok").alias("hit"), F.sum(F.col("in3") * F.col("s.is_t")).alias("in3"))
    return per.agg(
        (F.sum("hit") / F.sum("n")).alias("accuracy"), (F.sum("in3") / F.sum("n")).alias("top3_accuracy"),
        F.avg(2 * F.col("hit") / (F.col("n") + F.col("k"))).alias("macro_f1"),
    )


def embed(rows: DataFrame, column: str, engine: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``rows`` with ``embedding`` from a pluggable model; ``engine`` builds it once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = engine()
        for s in batches:
            yield pd.Series(list(np.asarray(model(s.tolist()), np.float32)))

    return rows.withColumn("embedding", run(F.col(column)))
