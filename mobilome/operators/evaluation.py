"""Evaluation of boundaries and scans against known elements, comparison of two methods, and synthetic truth."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.functions.decisions import NON_CANONICAL
from mobilome.functions.sequence import gc_fraction, random_dna
from mobilome.operators.metrics import rates

#: Stands for an error where nothing matched.
NO_MATCH = 999.0


def boundary_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy of predicted ends, by group.

    ``rows`` have start, end, true_start, true_end, family, has_tir, true_tir, has_tsd and true_tsd.  The error
    of an element is the larger of its two ends'.  Repeats found in a family without any are
    hallucinated.
    """
    a, b = F.abs(F.col("start") - F.col("true_start")), F.abs(F.col("end") - F.col("true_end"))
    worst = F.greatest(a, b)
    special = F.col("family").isin(*NON_CANONICAL)

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    def repeat(found: str, true: str) -> list[Column]:
        tp, fp, fn = (F.count_if(~special & x) for x in (F.col(found) & F.col(true), F.col(found) & ~F.col(true), ~F.col(found) & F.col(true)))
        return [F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))]

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(worst == 0).alias("exact"), share(worst <= 3).alias("within_3"), share(worst <= 10).alias("within_10"),
        F.avg((a + b) / 2).alias("mean_error"), F.percentile(worst, F.lit(0.5)).alias("median_error"),
        repeat("has_tir", "true_tir")[0].alias("tir_f1"), repeat("has_tsd", "true_tsd")[0].alias("tsd_f1"),
        F.coalesce(F.try_divide(F.count_if(special & (F.col("has_tir") | F.col("has_tsd"))), F.count_if(special)), F.lit(0.0)).alias("hallucinated"),
    )


def scan_summary(predicted: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for a scan: distinct known elements found, unmatched predictions, rates, and errors of the ends.

    ``matches`` are (pred_id, truth_id) as overlap matching gives them; predictions and truth have (id, start, end).
    """
    p = predicted.select(F.col("id").alias("pid"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    t = truth.select(F.col("id").alias("tid"), F.col("start").alias("ts"), F.col("end").alias("te"))
    ends = matches.join(p, F.col("pred_id") == F.col("pid")).join(t, F.col("truth_id") == F.col("tid"))
    error = F.greatest(F.abs(F.col("ps") - F.col("ts")), F.abs(F.col("pe") - F.col("te")))
    found = ends.agg(
        F.count_distinct("truth_id").alias("tp"), F.count_distinct("pred_id").alias("matched"),
        F.coalesce(F.avg(error), F.lit(NO_MATCH)).alias("mean_error"), F.coalesce(F.percentile(error, F.lit(0.5)), F.lit(NO_MATCH)).alias("median_error"),
    )
    sizes = predicted.agg(F.count(F.lit(1)).alias("n_pred")).crossJoin(truth.agg(F.count(F.lit(1)).alias("n_true")))
    one = found.crossJoin(sizes)
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("matched"), F.col("n_true") - F.col("tp")
    precision, recall, f1, *_ = rates(tp, fp, F.lit(0), fn)
    return one.select("n_pred", "n_true", "tp", fp.alias("fp"), fn.alias("fn"), precision, recall, f1, "mean_error", "median_error")


def fragment_summary(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """One row for a fragment scan: recall over positive contigs, specificity over negative ones, truncation accuracy.

    The best detection of a contig by composite score stands for it; any two edge classes agree.
    """
    best = detected.groupBy("contig_id").agg(F.max_by("truncation", "composite_score").alias("truncation"), F.count(F.lit(1)).alias("found"))
    j = truth.join(best.withColumnRenamed("contig_id", "c"), F.col("contig_id") == F.col("c"), "left")
    hit, agree = F.col("is_positive") & F.col("found").isNotNull(), (F.col("truncation") == F.col("gold_truncation")) | (F.startswith("truncation", F.lit("edge_")) & F.startswith("gold_truncation", F.lit("edge_")))
    return j.agg(
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if("is_positive")), F.lit(0.0)).alias("recall"),
        (1 - F.coalesce(F.try_divide(F.sum(F.when(~F.col("is_positive"), F.coalesce("found", F.lit(0))).otherwise(0)), F.count_if(~F.col("is_positive"))), F.lit(0.0))).alias("specificity"),
        F.coalesce(F.try_divide(F.count_if(hit & agree), F.count_if(hit)), F.lit(0.0)).alias("truncation_accuracy"),
    )


def truncation_confusion(truth: DataFrame, detected: DataFrame, classes: list[str]) -> DataFrame:
    """Known against detected class, with "none" for missed contigs and zeros filled in."""
    best = detected.groupBy(F.col("contig_id").alias("c")).agg(F.max_by("truncation", "composite_score").alias("truncation"))
    j = truth.filter("is_positive").join(best, F.col("contig_id") == F.col("c"), "left").fillna({"truncation": "none"})
    return j.groupBy("gold_truncation").pivot("truncation", [*classes, "none"]).count().fillna(0)


def compare_methods(a: DataFrame, b: DataFrame, metrics: list[str], places: int = 4) -> DataFrame:
    """(metric, value_b, value_a, delta) as text from two one-row tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return df.select(F.explode(pairs).alias("p")).select(f"p.metric", f"p.{name}")

    form = f"%.{places}f"
    joined = long(a, "a").join(long(b, "b"), "metric")
    return joined.select(
        "metric", F.format_string(form, "b").alias("value_b"), F.format_string(form, "a").alias("value_a"), F.format_string(f"%+.{places}f", F.col("a") - F.col("b")).alias("delta")
    )


def synthetic_contigs(elements: DataFrame, key: str, sequence: str, flank: int = 600, repeat: int = 5) -> DataFrame:
    """Elements set into random flanks of their own GC share, their insertion site doubled: contig, true ends and repeat."""
    given = elements.select(key, F.col(sequence).alias("_e"), F.md5(F.col(key).cast("string")).alias("_seed"), gc_fraction(F.col(sequence)).alias("_gc"))
    seed, gc = F.col("_seed"), F.col("_gc")  # computed once a row, not once for every base drawn
    parts = given.select(
        key, "_e", random_dna(F.concat(seed, F.lit("l")), flank, gc).alias("_l"), random_dna(F.concat(seed, F.lit("r")), flank, gc).alias("_r")
    )
    site = F.right("_l", F.lit(repeat))
    start = F.lit(flank)
    return parts.select(
        key, F.concat("_l", "_e", site, "_r").alias("contig"), start.alias("true_start"), (start + F.length("_e")).alias("true_end"), site.alias("true_tsd")
    )
