"""Mix sources to target weights by nested hash-threshold histograms.

Only DataFrame expressions run here.  Sizes and a 60-bit content hash are
written once as a narrow table.  For each source, a histogram of sizes by the
leading hash bits finds the bucket in which the budget ends; only that bucket
is histogrammed again by the next bits, until the single hash value at the
boundary is known.  A document is then taken by comparing its hash with its
source's threshold, so nothing is sorted and no group is collected.

Defined results: a null text has size 0; a very long text is counted whole and taken or left whole; a null source is a source of its own
and orders last; rows that agree in id and text share a hash and are taken
alike; an empty table gives an empty result.  Columns of the input other than
the three named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.storage import materialize

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
#: Parts over which the rows of one source are dealt when they meet its plan.
SALTS = 64


def content_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text, the same in any SQL engine."""
    key = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """One row per source: its size and its water-filled target.

    Sources in code point order take the weights in turn.  The common level is
    the one at which ``min(cap * size, level * weight)`` sums to ``share`` of all
    sizes: with sources ordered by ``cap * size / weight`` it is found from
    running sums, without iterating.  The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.partitionBy(F.lit(1)).orderBy(
        F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))
    ) / F.sum("weight").over(onward)
    level = F.when(level * F.col("weight") <= F.col("ceiling"), level)
    filled = ranked.withColumn("level", level)
    # The first source in fill order that its level does not lift above its ceiling fixes the level.
    fixed = F.first("level", ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return filled.withColumn("level", fixed).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("ceiling"))
        .otherwise(F.least(F.col("ceiling"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    row_col: str | None = None,
) -> DataFrame:
    """Per document: size, its source's size and target, ``copies`` and ``taken`` words; ``row`` too if ``row_col`` is given.

    Every document is taken ``floor(target / source_size)`` times, and those
    below the source's hash threshold once more.  The document at the threshold
    is taken if that brings the source nearer to its target.
    """
    text = F.col(text_col)
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            content_hash(F.col(id_col), text).alias("h"),
            *([F.col(row_col).alias("row")] if row_col else []),
        ),
        "mix-sizes",
    )
    plan = source_targets(sizes, weights, share, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = materialize(
        plan.withColumn("full", full.cast("long")).withColumn(
            "budget", F.col("target") - F.col("full") * F.col("source_size")
        ),
        "mix-plan",
    )
    edge = plan.select(
        F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")
    )
    for depth in range(HASH_BITS // LEVEL_BITS):
        left = HASH_BITS - LEVEL_BITS * depth
        hashed = sizes.select(
            "source", "size", F.shiftright("h", left).alias("at"), F.shiftright("h", left - LEVEL_BITS).alias("bucket")
        )
        own = F.col("source").eqNullSafe(F.col("s"))
        if depth:  # only the boundary bucket is refined; the rows meet it by source and leading hash bits
            inside = hashed.join(edge, own & (F.col("at") == F.col("prefix")))
            histogram = inside.groupBy("s", "budget", "below", "bucket").agg(F.sum("size").alias("mass"))
        else:  # all rows take part: they are summed before they meet their source
            histogram = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("mass")).join(edge, own)
        run = Window.partitionBy("s", "budget", "below").orderBy("bucket")
        cum = histogram.withColumn("upto", F.col("below") + F.sum("mass").over(run))
        edge = (
            cum.filter(F.col("upto") > F.col("budget"))
            .groupBy("s", "budget")
            .agg(F.min("bucket").alias("prefix"), F.min("upto").alias("upto"), F.min_by("mass", "bucket").alias("mass"))
            .select("s", "budget", "prefix", (F.col("upto") - F.col("mass")).alias("below"), "upto")
        )
        if depth + 1 < HASH_BITS // LEVEL_BITS:
            edge = edge.drop("upto")
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    limit = edge.select("s", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("limit"))
    # Rows of one source are dealt over SALTS parts, so that a hot source is not one task.
    plan = plan.join(limit, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "full", F.coalesce("limit", F.lit(0)).alias("limit"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"),
    )
    copies = F.col("full") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    salted = sizes.withColumn("salt", F.pmod("h", F.lit(SALTS).cast("long")))
    return (
        salted.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("part")))
        .withColumn("copies", copies.cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if row_col else []),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS ceiling FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
         / sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER fill AS place
  FROM ranked WINDOW fill AS (ORDER BY ceiling / weight, source NULLS LAST)),
fixed AS (SELECT min_by(level, place) AS level FROM levels WHERE level * weight <= ceiling),
plan AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL THEN ceiling ELSE least(ceiling, f.level * weight) END AS target
  FROM levels CROSS JOIN fixed f),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS n FROM plan),
budgeted AS (SELECT *, target - n * source_size AS budget FROM split),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.n, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS mass
  FROM sized s JOIN budgeted b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (n + CASE WHEN upto <= budget OR (upto - mass <= budget AND upto - budget < budget - (upto - mass)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
