"""Intervals on contigs: islands of neighbours, greedy overlap resolution, best overlapping match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(
    genes: DataFrame, contig: str, start: str, end: str, same: str, gap, order: Sequence[str] = ()
) -> DataFrame:
    """``genes`` with ``island``: neighbours by start share one if the gap to the previous end is at most ``gap``
    and the ``same`` column equals the previous one's.  Islands are numbered from 1 within the contig.
    """
    w = Window.partitionBy(contig).orderBy(start, *order)
    apart = (F.col(start) - F.lag(end).over(w) > F.lit(gap)) | (F.lag(same).over(w) != F.col(same))
    return genes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def reduce_islands(
    with_islands: DataFrame, contig: str, start: str, end: str, gene: str, score: str, evalue: str,
    first_of: Sequence[str] = (), primary: str = "best", order: Sequence[str] = (),
) -> DataFrame:
    """One row per island: first start, last end, size, best score, least e-value, primary gene.

    The end is that of the last gene, which need not be the largest.  The primary
    gene is the best-scoring one, the first of equals, or the first gene.
    """
    place = F.struct(start, *order)
    lead = F.min_by(gene, F.struct(-F.col(score), place)) if primary == "best" else F.min_by(gene, place)
    return with_islands.groupBy(contig, "island").agg(
        F.min(start).alias("start"), F.max_by(end, place).alias("end"), F.count(F.lit(1)).alias("n_genes"),
        lead.alias("primary_gene"), F.max(score).alias("score"), F.min(evalue).alias("evalue"),
        *[F.min_by(c, place).alias(c) for c in first_of],
    )


def resolve_overlaps(
    elements: DataFrame, contig: str, start: str, end: str, score: str, key: str, share: float = 0.5
) -> DataFrame:
    """Greedy overlap resolution per contig, as rows (contig, start, end, score, key).

    In order of start, an element is compared with the last kept one alone.  If they
    overlap by more than ``share`` of the shorter, the better score stays in that
    place, the earlier one of equals.  Elements on either side of a place that none of them covers never meet, so the
    fold runs over the stretches between such places: a contig's elements pass one sorted window, and are never gathered.
    """
    item = F.struct(
        F.col(start).cast("long").alias("start"), F.col(key).cast("string").alias("key"),
        F.col(end).cast("long").alias("end"), F.col(score).cast("double").alias("score"),
    )
    kind = "array<struct<start:bigint,key:string,end:bigint,score:double>>"

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        shared = F.least(last["end"], x["end"]) - F.greatest(last["start"], x["start"])
        shorter = F.least(last["end"] - last["start"], x["end"] - x["start"])
        clash = (F.size(kept) > 0) & (shared > shorter * F.lit(share))
        swap = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(x))
        return F.when(~clash, F.concat(kept, F.array(x))).when(x["score"] > last["score"], swap).otherwise(kept)

    before = Window.partitionBy(contig).orderBy(F.col("_item.start"), F.col("_item.key")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(contig).orderBy(F.col("_item.start"), F.col("_item.key")).rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("_item.start") >= F.max("_item.end").over(before), F.lit(True)).cast("long")
    stretches = elements.select(contig, item.alias("_item")).withColumn("_apart", apart).withColumn("_stretch", F.sum("_apart").over(upto))
    folded = stretches.groupBy(contig, "_stretch").agg(F.array_sort(F.collect_list("_item")).alias("items")).select(
        contig, F.aggregate("items", F.array().cast(kind), step).alias("kept")
    )
    return folded.select(contig, F.explode("kept").alias("e")).select(contig, "e.start", "e.end", "e.score", "e.key")


def overlap_matches(
    predicted: DataFrame, truth: DataFrame, width: int, least: float = 0.40, on: str = "contig"
) -> DataFrame:
    """The best truth of every prediction: (pred_id, truth_id, overlap), where overlap is the shared length over the
    longer length and at least ``least``; the earlier truth of equals.

    Both sides have (``on``, id, start, end).  They meet in bins of ``width`` so
    that the join is an equality; a pair is counted in the bin where its overlap begins.
    """
    def binned(df: DataFrame, p: str) -> DataFrame:
        last = F.greatest(F.floor((F.col("end") - 1) / width), F.floor(F.col("start") / width))
        return df.select(
            F.col(on).alias(f"{p}_on"), F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"),
            F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("bin"),
        )

    a, b = binned(predicted, "p"), binned(truth, "t").withColumnRenamed("bin", "t_bin")
    pairs = a.join(b, (F.col("p_on") == F.col("t_on")) & (F.col("bin") == F.col("t_bin")) & (F.col("p_start") < F.col("t_end")) & (F.col("t_start") < F.col("p_end")))
    begin = F.greatest("p_start", "t_start")
    pairs = pairs.filter(F.floor(begin / width) == F.col("bin"))
    longer = F.greatest(F.col("p_end") - F.col("p_start"), F.col("t_end") - F.col("t_start"))
    ratio = (F.least("p_end", "t_end") - begin) / longer
    return (
        pairs.withColumn("ratio", ratio)
        .groupBy("p_id")
        .agg(F.max(F.struct("ratio", -F.col("t_start"), -F.col("t_id"))).alias("best"))
        .select(F.col("p_id").alias("pred_id"), (-F.col("best.col3")).alias("truth_id"), F.col("best.ratio").alias("overlap"))
        .filter(F.col("overlap") >= least)
    )
