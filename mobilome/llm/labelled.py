"""Bounded samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.storage import materialize


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


#: Characters of a class that are learnt from at most, each line counting as so many more; a document with more than a twentieth of them is not learnt from.
MOST_CHARS, PER_LINE = 20_000_000, 50


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: int, most_chars: int = MOST_CHARS
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` documents and about ``most_chars`` characters a class, and how many each class has.

    Only rows outside the held-out fold are learnt from; of those, the ones with
    the smallest hashes are taken, while their texts together stay within ``most_chars``.  The ids are
    at most 2 x per_class rows, so they may be broadcast.  Of rows with one id the least text counts, so
    that an id is one document however often it is repeated.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), *fold))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .filter("y = top")
        .drop("top")
    )
    sizes = {int(r["y"]): int(r["count"]) for r in usable.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    parts = [usable.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    chosen = materialize(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), f"{label}-sample")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    length = F.coalesce(F.length("text") + PER_LINE * lines, F.lit(0)).alias("length")
    # At most 2 x per_class rows of four numbers come to the driver.
    found = chosen.select("doc_id", "y", order.alias("order"), length).filter(F.col("length") <= most_chars // 20).toPandas()
    found = found.sort_values(["order", "doc_id"])
    inside = found[found.groupby("y")["length"].cumsum() <= most_chars]["doc_id"]
    few = docs.sparkSession.createDataFrame([(int(i),) for i in inside], "doc_id long")
    return chosen.join(F.broadcast(few), "doc_id", "left_semi"), sizes
