"""Exact dedup: counting quotient filters find repeats, bytes decide.

Each partition builds counting quotient filters in a ladder of doubling sizes and
deals the last one out by fingerprint shard; a shard's filters merge losslessly, so a text
that a third of all rows share is one entry per partition.  Texts whose fingerprint counts above
one, and only those, are compared whole: the repeated fingerprints are broadcast if their
measured number allows, else a bitmap of fixed size that they are hashed to is;
what it lets through by chance is a group of one and goes.  The texts that pass are
aggregated by their whole normalised text within each partition before any shuffle.

Defined results: a null text is empty; empty texts are equal to each other; very long texts are compared whole; a
null id loses every tie and can be ``keep_id`` only if all ids of the group are
null; rows repeated with one id share their verdict; an empty table gives an
empty result.  Of texts with equally many code points the smallest id stays.  Other columns than the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.llm import quotient_filter as cqf
from mobilome.llm import tables
from mobilome.operators.joins import join_answers
from mobilome.storage import materialize

#: The characters of the class [\x20\x09-\x0D], which normalisation deletes.
WHITE = " \t\n\x0b\x0c\r"
#: Repeated fingerprints that are broadcast at most (8 MB), and bits of the bitmap used beyond that (8 MB).
LISTED, BITS = 1_000_000, 1 << 26


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def repeated_fingerprints(fingerprints: DataFrame, shards: int) -> DataFrame:
    """The values of the long column ``fp`` that occur more than once, each once."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ladder = cqf.Ladder()
        for pdf in batches:
            ladder.add(cqf.build(pdf["fp"].to_numpy(np.int64).view(np.uint64)))
        held = ladder.whole()
        if not cqf.size(held):
            return
        fps, counts = cqf.entries(held)
        shard = (fps % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [
            (s, cqf.build(fps[order[a:b]], counts[order[a:b]]))
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
            if b > a
        ]
        yield pd.DataFrame(rows, columns=["shard", "filter"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts = cqf.entries(cqf.merge(list(pdf["filter"])))
        return pd.DataFrame({"fp": fps[counts > 1].view(np.int64)})

    return (
        fingerprints.select("fp")
        .mapInPandas(partial, "shard long, filter binary")
        .groupBy("shard")
        .applyInPandas(final, "fp long")
    )


def _possible(texts: DataFrame, repeats: DataFrame, listed: int, bits: int) -> DataFrame:
    """The rows of ``texts`` whose ``fp`` is, or by the bitmap may be, among the distinct ``repeats``; no row is moved."""
    if repeats.count() <= listed:
        return texts.join(F.broadcast(repeats), "fp", "left_semi")
    word, bit = F.expr(f"cast(pmod(fp, {bits}L) >> 6 as int)"), F.expr(f"shiftleft(1L, cast(pmod(fp, {bits}L) & 63 as int))")
    words = repeats.groupBy(word.cast("long").alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = repeats.sparkSession.range(bits // 64).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bitmap = every.agg(F.transform(ordered, lambda w: w["bits"])).scalar()
    return texts.filter(F.get(bitmap, word).bitwiseAND(bit) != 0)


def _rank(length: Column, doc_id: Column) -> Column:
    """A decimal that orders by length, then by smaller id, null ids last; hash-aggregable."""
    low = F.coalesce(F.expr("cast(9223372036854775808 as decimal(20,0))") - doc_id.cast("decimal(20,0)"), F.lit(0))
    return length.cast("decimal(10,0)") * F.expr("cast(36893488147419103232 as decimal(20,0))") + low


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.

    Up to ``listed`` repeated fingerprints are broadcast; beyond it a bitmap of ``bits`` bits stands for them.
    """
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.col(text_col)
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(raw), F.lit(0)).alias("length"),
        normalised(raw).alias("norm"),
    ).withColumn("fp", F.xxhash64("norm"))
    rows = materialize(
        texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "exact-rows"
    )
    repeats = materialize(repeated_fingerprints(rows, shards), "exact-repeats")
    groups = (
        _possible(texts, repeats, listed, bits)
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best"))
        .filter("group_size > 1")
    )
    low = F.expr("best % cast(36893488147419103232 as decimal(20,0))")
    keep = F.when(low > 0, (F.expr("cast(9223372036854775808 as decimal(20,0))") - low).cast("long"))
    groups = groups.select(F.sha2("norm", 256).alias("text_sha256"), keep.alias("keep"), "group_size")
    joined = join_answers(rows, materialize(groups, "exact-groups").withColumn("grouped", F.lit(True)), "text_sha256", "group_size", "left")
    keep_id = F.when(F.col("grouped").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(tables.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
