"""Boundary prediction over tables of transposase intervals.

Only the flanks of an interval leave the contig: 620 bases to the left and to the right, cut before any
shuffle or Python call, so a contig of millions of bases is never shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.functions import boundary_kernels as K
from mobilome.operators.portions import portions

#: Bases on either side that any engine looks at, with room for direct repeats.
FLANK = 620

BOUNDARY = (
    "start int, end int, complete boolean, confidence double, "
    "tir struct<left_start:int,left_end:int,right_start:int,right_end:int,length:int,mismatches:int,identity:double,score:double>, "
    "tsd struct<sequence:string,length:int,mismatches:int,score:double>, "
    "structure struct<feature_type:string,motif_left:string,motif_right:string,stability_score:double>"
)


def flanks(contig: Column, start: Column, end: Column, reach: int = FLANK) -> Column:
    """struct(shift, left, right): the flanks, and how far positions move when the middle is cut out."""
    a = F.greatest(F.lit(0), start - reach)
    return F.struct(
        a.alias("shift"), F.substr(contig, a + 1, start - a).alias("left"), F.substr(contig, end + 1, F.lit(reach)).alias("right"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over at least as many partitions as there are cores."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _predict(engine: str, left: str, right: str, shift: int, start: int, end: int, family: str) -> dict:
    # The kernels see the flanks around a gap of the interval's own size and never read inside it.
    inner = "N" * (end - start)
    found = K.ENGINES[engine](left + inner + right, start - shift, end - shift, family).row()
    for name in ("start", "end"):
        found[name] = found[name] + shift
    for name in ("left_start", "left_end", "right_start", "right_end"):
        if found["tir"]:
            found["tir"][name] += shift
    return found


def predict_boundaries(
    genes: DataFrame, contig: str, start: str, end: str, family: str, engine: str = "plan_a", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``keep`` columns and the predicted boundary (columns of BOUNDARY) of every interval; an unknown engine's name means ``plan_b``."""
    engine = engine if engine in K.ENGINES else "plan_b"
    rows = genes.select(*keep, F.col(start).cast("int").alias("_s"), F.col(end).cast("int").alias("_e"), F.col(family).alias("_f"), flanks(F.col(contig), F.col(start), F.col(end)).alias("_x"))
    # The search costs milliseconds a row and a row is two short flanks: spread them over all cores first.
    rows = spread(rows.select(*keep, "_s", "_e", "_f", "_x.*"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches, "left", "right"):
            found = [
                _predict(engine, r.left or "", r.right or "", int(r.shift), int(r.s), int(r.e), r.f or "")
                for r in pdf.rename(columns={"_s": "s", "_e": "e", "_f": "f"}).itertuples()
            ]
            out = pd.DataFrame(found, columns=["start", "end", "complete", "confidence", "tir", "tsd", "structure"])
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {BOUNDARY}" if keep else BOUNDARY)


def direct_repeats(rows: DataFrame, contig: str, left: str, right: str, keep: tuple[str, ...], least: int = 2, most: int = 14, shift: int = 3) -> DataFrame:
    """The best direct repeat of every row where one scores: ``keep`` columns, refined ends, repeat, length, mismatches and score.

    Only the two windows that the ends can move in leave the contig; a row is answered in place, so equal rows stay
    apart and nothing is shuffled.
    """
    l, r = F.col(left), F.col(right)
    a, b = F.greatest(F.lit(0), l - shift - most), F.greatest(F.lit(0), r - shift)
    cut = rows.select(
        *keep, l.cast("int").alias("_l"), r.cast("int").alias("_r"), F.length(contig).alias("_n"),
        F.substr(F.col(contig), a + 1, F.greatest(l + shift - a, F.lit(0))).alias("_a"),
        F.substr(F.col(contig), b + 1, F.greatest(r + shift + most - b, F.lit(0))).alias("_b"),
    )
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in keep), '`left` int', '`right` int', "repeat string", "length int", "mismatches int", "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, found = [], []
            for i, (x, y, n, before, after) in enumerate(zip(pdf["_l"], pdf["_r"], pdf["_n"], pdf["_a"], pdf["_b"])):
                hit, x, y = K.direct_repeat_in_windows(before, after, int(n), int(x), int(y), least, most, True, shift)
                if hit:
                    places.append(i)
                    found.append((x, y, hit.sequence, hit.length, hit.mismatches, hit.score))
            out = pd.DataFrame(found, columns=["left", "right", "repeat", "length", "mismatches", "score"])
            yield pd.concat([pdf[list(keep)].iloc[places].reset_index(drop=True), out], axis=1)

    return spread(cut.filter("_l IS NOT NULL AND _r IS NOT NULL AND _n IS NOT NULL")).mapInPandas(run, kinds)
