"""Incremental twins of batch operators: the same function over micro-batches of whole contigs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(
    spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    fmt: str = "parquet", files_per_trigger: int = 1, pattern: str | None = None, options: dict | None = None,
):
    """Apply ``work`` to new files as they come, a few at a time, and append to ``target``.

    Right for any operator that never looks beyond one contig, if a contig is
    never divided between files: then the appended rows equal the batch result.  A
    batch is written under its own number, so a retried batch replaces itself.
    Returns the query, which ends when the files at hand are done.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    reader = reader.options(**(options or {}))

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(
    spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], order: Sequence[str], template: str, target: str, checkpoint: str,
    fmt: str = "parquet", files_per_trigger: int = 1,
):
    """``incremental`` with running ``element_id``s across batches: a batch goes on where the ones before it ended.

    The state is one number a batch, written beside the result under the batch's own number, so a retried
    batch numbers its rows as before.  Within a batch the ids follow ``order``.
    """
    from mobilome.operators.datasets import ranked

    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = 0
        if number:
            counts = session.read.schema("n long, batch int").parquet(f"{target}/counts")
            before = counts.filter(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        placed = ranked(work(batch), [F.col(c) for c in order], "_place")
        rows = placed.withColumn("element_id", F.format_string(template, F.col("_place") + before)).drop("_place")
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        placed.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/counts/batch={number}")

    return reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pools(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 1, least: int = 80, most: int = 1500):
    """Records of FASTA files, gzipped or not, as the files come: those fit for negatives, with accession, description, organism, sequence and ``pool``.

    A file is never whole in memory; a batch is some files, and its rows are dealt over all cores after reading, because gzip files cannot be split; of a batch
    that may have a file for every core they stay where they were read.
    """
    from mobilome.operators.boundaries import spread
    from mobilome.operators.filters import negative_pools
    from mobilome.sources.fasta import records, uniprot_header

    def work(batch: DataFrame) -> DataFrame:
        raw = batch.select(F.regexp_replace(F.make_valid_utf8("value"), r"^>", "").alias("r"))
        raw = raw if files_per_trigger >= spark.sparkContext.defaultParallelism else spread(raw)
        found = records(raw, F.col("r")).withColumn("h", uniprot_header(F.col("description")))
        named = found.select("h.accession", "h.description", "h.organism", "sequence")
        return negative_pools(named, "description", "organism", "sequence", least, most)

    return incremental(spark, source, "value string", work, target, checkpoint, "text", files_per_trigger, options={"lineSep": "\n>"})
