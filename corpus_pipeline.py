"""The corpus pipeline: score, dedup, near-dedup, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and hands the table on.  All stages
but the last return the columns of ``documents``.  Stages that decide between
rows number them first and decide by row, so that of several rows with one id,
null or not, each has its own verdict; of equal rows one is kept.

Defined results: null and empty texts are scored like others and are copies of each other; very long texts are read whole; ties go to the
smaller id, null ids last; an empty table gives empty results; columns of ``documents`` other than its five are dropped by
the first stage, so names that clash with those used inside have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome.llm.bpe import encode_documents
from mobilome.llm.exact_dedup import exact_duplicates
from mobilome.llm.mixing import mix_sources
from mobilome.llm.quality import scorer, train
from mobilome.llm.simhash import near_duplicates
from mobilome.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents scored below this are rejected.
QUALITY = 0.7


def _numbered(docs: DataFrame, label: str, ordered: bool = True) -> DataFrame:
    """``docs`` with a distinct number ``row`` for each row, if ``ordered`` in the order of the ids, null ids last.

    Distinct ids are their own numbers, at the price of counting them.  Else the rows are numbered and
    written with their numbers, so that they are the same in every use; the hash spreads rows of one id over the ranges.
    """
    rows = docs.select(COLUMNS)
    n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == distinct:
        return rows.withColumn("row", F.col("doc_id").cast("long"))
    if ordered:
        rows = rows.sort(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), label)


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number is among the distinct ``kept``."""
    kept = kept.select(F.col("doc_id").alias("kept_row"))
    return rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi").select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; nothing where a class has no label to fit one."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs.select(COLUMNS)
    return docs.select(COLUMNS).filter(scorer(model)("text")["score"] >= QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts."""
    rows = _numbered(docs, "exact-numbered")
    return _only(rows, exact_duplicates(rows, id_col="row").filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    rows = _numbered(docs, "near-numbered")
    return _only(rows, near_duplicates(rows, id_col="row").filter(F.col("doc_id") == F.col("component_id")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; what it does not take goes."""
    rows = _numbered(docs, "mixing-numbered", ordered=False)
    copies = mix_sources(rows, row_col="row").filter("copies > 0").select(F.col("row").alias("taken_row"), "copies")
    taken = rows.join(copies, F.col("row") == F.col("taken_row"))
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, what they decode to, and how many there are."""
    return encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Trained models, fuzzy hashing and BPE have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
