"""FASTA, FASTQ-free: reading, quality of names, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome.operators.boundaries import spread


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of every record; gzip files are read as they are; bytes that are no UTF-8 are replaced.

    Records are split by the reader itself, so a large file is read by many
    tasks; gzip files cannot be split and are spread over all cores after reading.
    """
    raw = raw_records(spark, path)
    if any(name.endswith((".gz", ".gzip")) for name in raw.inputFiles()):
        raw = spread(raw)
    return records(raw, F.col("r"))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of files as text ``r`` without their leading ">"."""
    return spark.read.text(path, lineSep="\n>").select(F.regexp_replace(F.make_valid_utf8("value"), r"^>", "").alias("r"))


def records(raw: DataFrame, record: Column, *keep: str) -> DataFrame:
    """Split records without their leading ">" into id, description and sequence, with the ``keep`` columns."""
    lines = F.regexp_replace(record, r"\r", "")
    description = F.trim(F.substring_index(lines, "\n", 1))
    sequence = F.regexp_replace(F.substr(lines, F.length(F.substring_index(lines, "\n", 1)) + 1), r"\s+", "")
    return raw.filter(F.length(F.trim(record)) > 0).select(
        F.regexp_extract(description, r"^(\S*)", 1).alias("id"), description.alias("description"), sequence.alias("sequence"), *keep
    )


def protein_header(header: Column) -> Column:
    """struct(name, orf, role) of a header of parts joined by ~~~; the name follows its last //."""
    parts = F.split(header, "~~~")
    return F.struct(
        F.substring_index(F.try_element_at(parts, F.lit(1)), "//", -1).alias("name"),
        F.try_element_at(parts, F.lit(2)).alias("orf"), F.try_element_at(parts, F.lit(3)).alias("role"),
    )


def dna_header(header: Column) -> Column:
    """struct(name, family, group) of a header of parts joined by underscores; an unknown group is null."""
    parts = F.split(header, "_")
    group = F.try_element_at(parts, F.lit(3))
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("name"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("Unknown")).alias("family"),
        F.when(F.lower(group) != "unknown", group).alias("group"),
    )


def uniprot_header(description: Column) -> Column:
    """struct(accession, entry, description, organism, taxonomy, gene); parts absent are null."""
    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(description, pattern, 1), F.lit(""))

    bars = F.split(description, r"\|")
    return F.struct(
        F.coalesce(part(r"^\w+\|([^|]+)\|"), F.try_element_at(bars, F.lit(2))).alias("accession"),
        F.coalesce(part(r"^\w+\|[^|]+\|(\S+)"), F.try_element_at(bars, F.lit(3))).alias("entry"),
        part(r"^\S+\s+(.*?)(?=\sOS=|$)").alias("description"), part(r"OS=(.*?)(?=\s(?:OX|GN|PE|SV)=|$)").alias("organism"),
        part(r"OX=(\d+)").alias("taxonomy"), part(r"GN=(\S+)").alias("gene"),
    )


def fasta_lines(frame: DataFrame, id_col: str, sequence: str, header: Column | None = None, width: int = 0) -> DataFrame:
    """One text row per record: ">header", then the sequence, wrapped at ``width`` if given."""
    body = F.col(sequence) if not width else F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?!$)", "$1\n")
    return frame.select(F.concat(F.lit(">"), header if header is not None else F.col(id_col), F.lit("\n"), body).alias("value"))


def write_fasta(frame: DataFrame, path: str, id_col: str, sequence: str, header: Column | None = None, width: int = 0) -> None:
    """Write records; an existing destination is an error."""
    fasta_lines(frame, id_col, sequence, header, width).write.mode("errorifexists").text(path)
