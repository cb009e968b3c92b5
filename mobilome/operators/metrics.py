"""Evaluation of scored, labelled rows: thresholds, areas, rates, strata and bootstrap intervals.

Inputs have a label column (0 or 1) and a score column.  Curves are built from
one row per distinct score, dealt by ranges of the score, so that a window never
sees more than one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.operators.datasets import ranked
from mobilome.storage import materialize


def _parts(steps: DataFrame, column: str) -> Column:
    """Which of a bounded number of ranges a value lies in; the bounds are constants, so every use agrees."""
    most = min(1_000, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(steps.stat.approxQuantile(column, [i / most for i in range(1, most)], 0.1 / most))) if most > 1 else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(column)))


def curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, descending: cumulative true and false positives, precision, recall and FDR.

    Distinct scores can be as many as rows, so they are summed by ranges: within a range by a window, and
    over the ranges before by one number each.  The scores' counts are written once, before ranges, sizes and sums read them.
    What several measures share is ``written_curve``.
    """
    steps = rows.groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    )
    steps = materialize(steps, "curve-steps")
    steps = steps.withColumn("_part", _parts(steps, "threshold"))
    sizes = steps.groupBy("_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above, whole = Window.partitionBy(F.lit(0)).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    shift = sizes.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp0"),
        F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"),
    )
    down = Window.partitionBy("_part").orderBy(F.col("threshold").desc())
    out = steps.select("_part", "threshold", "pos", "neg", F.sum("pos").over(down).alias("tp1"), F.sum("neg").over(down).alias("fp1"))
    out = out.join(F.broadcast(shift), F.col("_part") == F.col("_p")).select(
        "threshold", "pos", "neg", (F.col("tp0") + F.col("tp1")).alias("tp"), (F.col("fp0") + F.col("fp1")).alias("fp"), "positives", "negatives"
    )
    n = F.col("tp") + F.col("fp")
    return out.select(
        "*", (F.col("tp") / n).alias("precision"), F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall"), (F.col("fp") / n).alias("fdr")
    )


def written_curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    """``curve``, written, to be handed to the measures below as ``known``."""
    return materialize(curve(rows, label, score), "curve")


def fdr_threshold(rows: DataFrame, label: str, score: str, target: float, variant: str = "max_recall", known: DataFrame | None = None) -> DataFrame:
    """One row (threshold, recall, fdr) at which the false discovery rate is at most ``target``.

    "max_recall" takes the highest threshold of largest recall anywhere on the
    curve and +infinity if there is none; "max_recall_or_top" falls back to the top
    score; "first_break" goes down from the top and stops before the first violation,
    with the top score as fallback.
    """
    c = known if known is not None else curve(rows, label, score)
    ok = F.col("fdr") <= target
    if variant == "first_break":
        broken = c.agg(F.max(F.when(~ok, F.col("threshold"))).alias("broken"))
        c = c.join(F.broadcast(broken)).withColumn("ok", F.coalesce(F.col("threshold") > F.col("broken"), F.lit(True)))
    else:
        c = c.withColumn("ok", ok)
    best = F.max(F.when(F.col("ok"), F.struct("recall", "threshold", "fdr")))
    fallback = F.lit(float("inf")) if variant == "max_recall" else F.max("threshold")
    return c.agg(best.alias("best"), fallback.alias("fallback")).select(
        F.coalesce("best.threshold", "fallback").alias("threshold"),
        F.coalesce("best.recall", F.lit(0.0)).alias("recall"),
        F.coalesce("best.fdr", F.lit(0.0)).alias("fdr"),
    )


def average_precision(rows: DataFrame, label: str, score: str, known: DataFrame | None = None) -> DataFrame:
    """Sum of precision times the gain in recall."""
    c = known if known is not None else curve(rows, label, score)
    return c.agg(F.coalesce(F.sum(F.col("precision") * F.try_divide("pos", "positives")), F.lit(0.0)).alias("average_precision"))


def pr_auc(rows: DataFrame, label: str, score: str, known: DataFrame | None = None) -> DataFrame:
    """Trapezoids under precision over recall, from the point (0, 1); the point before a step is the step less its own counts."""
    c = known if known is not None else curve(rows, label, score)
    tp, n = F.col("tp") - F.col("pos"), F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
    r0, p0 = F.coalesce(F.try_divide(tp, F.col("positives")), F.lit(0.0)), F.coalesce(F.try_divide(tp, n), F.lit(1.0))
    return c.withColumn("area", (F.col("recall") - r0) * (F.col("precision") + p0) / 2).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("pr_auc"))


def auroc(rows: DataFrame, label: str, score: str, known: DataFrame | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties counted half; 0.5 without both classes."""
    c = known if known is not None else curve(rows, label, score)
    won = F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2)
    return c.agg(F.coalesce(F.try_divide(F.sum(won), F.max(F.col("positives") * F.col("negatives"))), F.lit(0.5)).alias("auroc"))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1, FDR, specificity and MCC; 0 where a denominator is 0."""
    def over(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    d = [x.cast("double") for x in (tp, fp, tn, fn)]
    root = F.sqrt((d[0] + d[1]) * (d[0] + d[3]) * (d[2] + d[1]) * (d[2] + d[3]))
    return [
        over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        over(fp, tp + fp).alias("fdr"), over(tn, tn + fp).alias("specificity"),
        F.coalesce(F.try_divide(d[0] * d[2] - d[1] * d[3], root), F.lit(0.0)).alias("mcc"),
    ]


def confusion(rows: DataFrame, label: str, score: str, threshold: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at a threshold, by group."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    counts = rows.groupBy(*by).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn")
    )
    return counts.select("*", *rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def group_recall(rows: DataFrame, label: str, score: str, group: str, threshold: Column) -> DataFrame:
    """Positives, found and recall by group."""
    n, found = F.count(F.lit(1)), F.count_if(F.col(score) >= threshold)
    return rows.filter(F.col(label) == 1).groupBy(group).agg(n.alias("n"), found.alias("found"), (found / n).alias("recall"))


def binned_recall(rows: DataFrame, label: str, score: str, value: str, bins: list[tuple[str, float, float]], threshold: Column) -> DataFrame:
    """Recall of positives by value bins [low, high); bins without rows are kept with recall 0.

    ``bins`` is a short constant list, so it is a broadcast side of known size.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(bins)], "bin_no int, bin string, low double, high double")
    name = None
    for i, (_, low, high) in enumerate(bins):
        inside = (F.col(value) >= low) & (F.col(value) < high)
        name = F.when(inside, i) if name is None else name.when(inside, i)
    counts = (
        rows.filter(F.col(label) == 1).withColumn("b", name).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("found"))
    )
    return table.join(counts, F.col("bin_no") == F.col("b"), "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("found", F.lit(0)).cast("long").alias("found"),
        F.coalesce(F.try_divide("found", "n"), F.lit(0.0)).alias("recall"),
    )


def strata(rows: DataFrame, conditions: dict[str, Column], label: str) -> DataFrame:
    """Each row once per stratum it belongs to (column ``stratum``); negatives belong to every stratum."""
    names = F.array(*[F.when((F.col(label) != 1) | c, F.lit(n)) for n, c in conditions.items()])
    return rows.withColumn("stratum", F.explode(F.array_compact(names)))


def overall_metrics(valid: DataFrame, test: DataFrame, label: str, score: str, targets: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """AUROC and average precision on ``test``, and its recall at thresholds fixed on ``valid``: one row of scalars."""
    on_test, on_valid = written_curve(test, label, score), written_curve(valid, label, score)
    out = auroc(test, label, score, on_test).crossJoin(average_precision(test, label, score, on_test))
    for t in targets:
        name = f"{round(t * 100)}fdr"
        at = fdr_threshold(valid, label, score, t, known=on_valid).select(F.col("threshold").alias(f"threshold_{name}"))
        found = F.sum(F.when(F.col("threshold") >= F.col(f"threshold_{name}"), F.col("pos")))
        seen = on_test.join(F.broadcast(at)).agg(F.coalesce(F.try_divide(found, F.max("positives")), F.lit(0.0)).alias(f"recall_{name}"))
        out = out.crossJoin(at).crossJoin(seen)
    return out


def bootstrap_recall(
    rows: DataFrame, label: str, unit: str, hit: Column, replicates: int, seed: str, other: Column | None = None
) -> DataFrame:
    """Percentile interval (2.5, 97.5) of recall, or of its difference from a second method's, over resampled units.

    All units are drawn from, those without positives too, and a replicate without positives has no value.  Positives are first summed by
    unit.  Draw d of replicate r takes the unit whose rank is an MD5 number of (seed, r, d) modulo the number
    of units, so the result is the same in any engine and on any partitioning.
    """
    gain = hit.cast("long") - (other.cast("long") if other is not None else F.lit(0))
    positive = F.col(label) == 1
    units = rows.groupBy(unit).agg(F.count_if(positive).alias("n"), F.coalesce(F.sum(F.when(positive, gain)), F.lit(0)).alias("g"))
    values = unit_draws(units, unit, replicates, seed).groupBy("r").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return percentile_interval(values.filter("n > 0").select((F.col("g") / F.col("n")).alias("value")))


def unit_draws(units: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """The units' columns once for each draw that takes them, with the replicate ``r``: as many draws as units in each."""
    spark = units.sparkSession
    placed = ranked(units, [F.col(unit)], "_place")
    total = placed.count()
    draws = (
        spark.range(replicates * total).select(F.expr(f"id div {max(1, total)}").alias("r"), (F.col("id") % max(1, total) + 1).alias("d"))
        .withColumn("pick", F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(seed), "r", "d")), F.lit(1), F.lit(12)), 16, 10).cast("long") % max(1, total) + 1)
    )
    counted = draws.groupBy("r", "pick").agg(F.count(F.lit(1)).alias("_times"))
    return counted.join(placed, F.col("pick") == F.col("_place")).withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("pick", "_place", "_times", "_t")


def percentile_interval(values: DataFrame) -> DataFrame:
    """One row (mean, low, high) of the column ``value``."""
    return values.agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high")
    )


def unit_weights(units: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """(unit, weights): how often each of ``replicates`` draws takes the unit, as one array; units that no draw takes are left out."""
    times = unit_draws(units.select(unit), unit, replicates, seed).groupBy(unit, "r").agg(F.count(F.lit(1)).alias("k"))
    # At most one entry a replicate.
    taken = times.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("r", "k"))).alias("_taken"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")), lambda r: F.coalesce(F.try_element_at("_taken", r), F.lit(0)).cast("int"))
    return taken.select(unit, every.alias("weights"))


def bootstrap_average_precision(rows: DataFrame, label: str, score: str, unit: str, replicates: int, seed: str) -> DataFrame:
    """Percentile interval (2.5, 97.5) of the average precision over resampled units, with scores as they are.

    Every cell of a unit and a score carries the unit's weights in all replicates.  The sums of a range of scores, one number a replicate, are what the
    ranges below it start from, so that all replicates are summed in one pass over the ranges, each sorted by itself.  A null score counts as below all others; null units are one unit.
    """
    cells = rows.groupBy(F.col(unit).alias("_unit"), F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), F.lit(-1.7e308)).alias("_score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    weights = unit_weights(rows.groupBy(F.col(unit).alias("_u")).agg(F.lit(1).alias("_one")), "_u", replicates, seed)
    weighted = cells.join(weights, F.col("_unit").eqNullSafe(F.col("_u"))).select("_score", "pos", "neg", "weights")
    weighted = materialize(weighted, "bootstrap-cells")
    weighted = weighted.withColumn("_part", _parts(weighted, "_score"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, scores, weighted positives, weighted negatives) of each batch."""
        for pdf in batches:
            for part, own in pdf.groupby("_part", sort=True):
                w = np.stack(own["weights"].to_numpy()).astype(np.float64)
                yield int(part), own["_score"].to_numpy(float), own["pos"].to_numpy(float)[:, None] * w, own["neg"].to_numpy(float)[:, None] * w

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, pos, neg in blocks(batches):
            yield pd.DataFrame({"part": [part], "pos": [pos.sum(0)], "neg": [neg.sum(0)]})

    sums: dict[int, np.ndarray] = {}
    for r in weighted.mapInPandas(totals, "part int, pos array<double>, neg array<double>").collect():
        sums[r["part"]] = sums.get(r["part"], 0) + np.array([r["pos"], r["neg"]])
    above, total = {}, np.zeros((2, replicates))
    for part in sorted(sums, reverse=True):
        above[part], total = total, total + sums[part]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """By replicate, the sum of precision over the positives; the last score of a batch waits for the next one, which may go on with it."""
        found, reached, waiting, at = np.zeros(replicates), None, None, None

        def add(pos: np.ndarray, neg: np.ndarray) -> None:
            nonlocal found, reached
            tp, n = reached[0] + np.cumsum(pos, 0), reached[1] + np.cumsum(pos + neg, 0)
            found = found + np.where(n > 0, pos * tp / np.maximum(n, 1), 0).sum(0)
            if len(tp):
                reached = tp[-1], n[-1]

        for part, scores, pos, neg in blocks(batches):
            if part != at:
                if waiting is not None:
                    add(waiting[1][None], waiting[2][None])
                at, waiting, reached = part, None, (above[part][0], above[part].sum(0))
            first = np.flatnonzero(np.concatenate(([True], scores[1:] != scores[:-1])))
            pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
            if waiting is not None and waiting[0] == scores[0]:
                pos[0], neg[0] = pos[0] + waiting[1], neg[0] + waiting[2]
            elif waiting is not None:
                add(waiting[1][None], waiting[2][None])
            add(pos[:-1], neg[:-1])
            waiting = scores[-1], pos[-1], neg[-1]
        if waiting is not None:
            add(waiting[1][None], waiting[2][None])
            yield pd.DataFrame({"r": np.arange(replicates), "part_sum": found})

    positives = rows.sparkSession.createDataFrame([(r, float(p)) for r, p in enumerate(total[0]) if p > 0], "r int, positives double")
    ordered = weighted.repartition("_part").sortWithinPartitions("_part", F.col("_score").desc())
    summed = ordered.mapInPandas(parts, "r int, part_sum double").groupBy("r").agg(F.sum("part_sum").alias("s"))
    return percentile_interval(summed.join(F.broadcast(positives), "r").select((F.col("s") / F.col("positives")).alias("value")))
