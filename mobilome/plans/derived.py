"""Domain inputs derived from the general tables by closed-form rules, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome.storage import deal_small

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2
RESIDUES = ("ACDEFGHIKLMNPQRSTVWY" * 2)[:26] * 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that costs much more than reading them."""
    return deal_small(table(spark, sf_dir, "documents"))


def letters(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")


def dna(text: Column) -> Column:
    """Each letter stands for a base."""
    return F.translate(letters(text), ALPHABET, BASES)


def protein(text: Column) -> Column:
    """Each letter stands for a residue."""
    return F.translate(letters(text), ALPHABET, RESIDUES)


SQL_LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')"
SQL_DNA = f"translate({SQL_LETTERS}, '{ALPHABET}', '{BASES}')"
SQL_PROTEIN = f"translate({SQL_LETTERS}, '{ALPHABET}', '{RESIDUES}')"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, n, ts, te): a document's DNA with a gene over its middle 40 percent."""
    d = texts(spark, sf_dir).select("doc_id", dna(F.col("text")).alias("seq"), F.lit("IS3").alias("family"))
    n = F.length("seq")
    return d.select("doc_id", "seq", n.alias("n"), F.floor(n * 3 / 10).cast("int").alias("ts"), F.floor(n * 7 / 10).cast("int").alias("te"), "family")


SQL_CONTIGS = f"""contigs AS (
  SELECT doc_id, seq, n, CAST(floor(n * 3 / 10) AS INT) AS ts, CAST(floor(n * 7 / 10) AS INT) AS te
  FROM (SELECT doc_id, seq, length(seq) AS n FROM (SELECT doc_id, {SQL_DNA} AS seq FROM documents)))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, score, n_chars, lang): labelled documents with a closed-form score."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 997 / 997.0).alias("score"), "n_chars", "lang", "toxic"
    )


SQL_SCORED = """scored AS (
  SELECT d.doc_id, l.quality AS y, ((d.n_chars * 37 + d.doc_id * 11) % 997) / 997.0::DOUBLE AS score, d.n_chars, d.lang, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits: lineitem's parts as queries, suppliers as targets."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("target"),
        (F.col("l_discount") * 10.0).alias("fident"), (F.col("l_quantity") / 50.0).alias("qcov"), (F.lit(1.0) - F.col("l_tax")).alias("tcov"),
        (F.col("l_tax") / 10.0).alias("evalue"), F.col("l_extendedprice").alias("bits"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
    )


SQL_HITS = """hits AS (
  SELECT l_partkey AS query, l_suppkey AS target, l_discount * 10.0::DOUBLE AS fident, l_quantity / 50.0::DOUBLE AS qcov, 1.0::DOUBLE - l_tax AS tcov,
         l_tax / 10.0::DOUBLE AS evalue, l_extendedprice AS bits, l_orderkey * 10 + l_linenumber AS line_no FROM lineitem)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, p, fast, sim, full, ident, cov, ev, hev, any_hit): evidence in its ranges, from orders."""
    k = F.col("o_orderkey")
    u = lambda a, m: ((k * a) % m) / F.lit(float(m))
    o = table(spark, sf_dir, "orders").select(
        k.alias("okey"), u(37, 101).alias("p"), u(53, 97).alias("fast0"), u(29, 89).alias("sim0"), u(71, 83).alias("full0"),
        (u(41, 103) * 100.0).alias("ident0"), (u(43, 107) * 100.0).alias("cov0"), F.when(k % 3 == 0, 1e-8).otherwise(0.01).alias("ev0"), F.when(k % 7 == 0, 1e-9).otherwise(0.5).alias("hev0"),
    )
    hit, prof = F.col("okey") % 2 == 0, F.col("okey") % 5 == 0
    return o.select(
        "okey", "p", F.when(F.col("okey") % 4 != 0, F.col("fast0")).alias("fast"), F.col("sim0").alias("sim"), F.when(F.col("okey") % 6 == 1, F.col("full0")).alias("full"),
        F.when(hit, F.col("ident0")).alias("ident"), F.when(hit, F.col("cov0")).alias("cov"), F.when(hit, F.col("ev0")).alias("ev"), F.when(prof, F.col("hev0")).alias("hev"), (hit | prof).alias("any_hit"),
    )


SQL_EVIDENCE = """evidence AS (
  SELECT k AS okey, ((k * 37) % 101) / 101.0::DOUBLE AS p, CASE WHEN k % 4 <> 0 THEN ((k * 53) % 97) / 97.0::DOUBLE END AS fast, ((k * 29) % 89) / 89.0::DOUBLE AS sim,
         CASE WHEN k % 6 = 1 THEN ((k * 71) % 83) / 83.0::DOUBLE END AS "full", CASE WHEN k % 2 = 0 THEN ((k * 41) % 103) / 103.0::DOUBLE * 100.0::DOUBLE END AS ident,
         CASE WHEN k % 2 = 0 THEN ((k * 43) % 107) / 107.0::DOUBLE * 100.0::DOUBLE END AS cov, CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 3 = 0 THEN 1e-8 ELSE 0.01::DOUBLE END) END AS ev,
         CASE WHEN k % 5 = 0 THEN (CASE WHEN k % 7 = 0 THEN 1e-9 ELSE 0.5::DOUBLE END) END AS hev, (k % 2 = 0 OR k % 5 = 0) AS any_hit
  FROM (SELECT o_orderkey AS k FROM orders)),
strong AS (
  SELECT *, coalesce(ev <= 1e-5 AND ident >= 30 AND cov >= 80, false) OR coalesce(hev <= 1e-5, false) AS strong FROM evidence)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, start, end, score): events as intervals in minutes of the month."""
    minute = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", minute.alias("start"), (minute + 30 + (F.col("event_id") * 17) % 600).alias("end"), (((F.col("event_id") * 31) % 997) / 997.0).alias("score")
    )


SQL_INTERVALS = """iv AS (
  SELECT user_id, event_id, event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS "start", CAST(floor(epoch(ts) / 60) AS BIGINT) + 30 + (event_id * 17) % 600 AS "end",
         ((event_id * 31) % 997) / 997.0::DOUBLE AS score FROM events)"""
