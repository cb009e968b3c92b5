"""Readers and writers of the tables that search tools, annotation files and reports use."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilome.operators.datasets import ranked
from mobilome.sources.fasta import write_fasta

HIT_SCHEMA = "query string, target string, fident double, alnlen int, qcov double, tcov double, evalue double, bits double"
BLAST_SCHEMA = "query string, target string, pident double, alnlen int, qcovs double, evalue double, bits double"


def in_file_order(rows: DataFrame, name: str = "line_no") -> DataFrame:
    """Rows just read from files with their place in the files, from 1, files in the order of their names.

    A task may read parts of files in any order, so places come from file, offset of the part, and place in the task.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return ranked(at, [F.col("_f"), F.col("_b"), F.col("_i")], name).drop("_f", "_b", "_i")


def read_hits(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Eight tab-separated columns without a header; strict fails on a bad line, lax skips it."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return in_file_order(spark.read.csv(path, sep="\t", schema=HIT_SCHEMA, mode=mode))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return in_file_order(spark.read.csv(path, sep="\t", schema=BLAST_SCHEMA, mode="DROPMALFORMED"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned element metadata of a CSV file with a header; the last row of a name wins."""
    return element_metadata(in_file_order(spark.read.csv(path, header=True, inferSchema=False), "row_no"))


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Insertion sequences of annotation feature tables; every file is a source of its own."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return feature_table(at.select("source", F.struct("_b", "_i").alias("pos"), "value"))


def read_profile_hits(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Profile search table: columns split by white space, # lines are comments; strict wants 19 columns."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"\s+", 19)
    if strict:
        p = F.when(F.size(p) == 19, p).otherwise(F.raise_error(F.lit("profile table: expected 19 columns")))
    rows = rows.select(p.alias("p"))

    def column(i: int, kind: str = "string") -> Column:
        return F.try_element_at("p", F.lit(i + 1)).try_cast(kind)

    return rows.select(
        column(0).alias("query"), column(2).alias("profile"), column(4, "double").alias("evalue"), column(5, "double").alias("bits"),
        column(7, "double").alias("domain_evalue"), column(8, "double").alias("domain_bits"),
    )


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="representative string, member_id string")


def write_lines_of(frame: DataFrame, path: str) -> None:
    """Tab-separated rows without a header."""
    frame.write.mode("errorifexists").csv(path, sep="\t", header=False)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def element_metadata(raw: DataFrame) -> DataFrame:
    """Cleaned element metadata of (Name, Family, Group, Length, ..., row_no): the last row of a name wins."""
    trimmed = raw.select("row_no", *[F.trim(c).alias(c) for c in raw.columns if c != "row_no"])
    cleaned = trimmed.withColumns(
        {
            "Family": F.coalesce(F.nullif("Family", F.lit("")), F.lit("Unknown")),
            "Group": F.when(~F.coalesce("Group", F.lit("")).isin("NA", "", "None", "unknown"), F.col("Group")),
            "Length": F.when(F.col("Length").rlike(r"^\d+$"), F.col("Length").try_cast("int")),
        }
    )
    others = [c for c in cleaned.columns if c not in ("Name", "row_no")]
    return cleaned.groupBy("Name").agg(F.max_by(F.struct(*others), "row_no").alias("m")).select("Name", "m.*")


def feature_table(lines: DataFrame) -> DataFrame:
    """Insertion sequences of an annotation feature table, given as (source, pos, value) lines.

    A line of two numbers and a type opens a feature; the qualifier lines after it belong
    to it.  Kept are mobile elements whose type mentions insertion sequences; equal coordinates
    count once.
    """
    p = F.split("value", "\t")
    opens = F.col("value").rlike(r"^[<>]?\d+\t[<>]?\d+\t\S+")
    w = Window.partitionBy("source").orderBy("pos")
    rows = lines.select("source", "pos", p.alias("p"), opens.alias("opens")).withColumn("feature", F.sum(F.col("opens").cast("long")).over(w))

    def number(i: int) -> Column:
        return F.regexp_replace(F.try_element_at("p", F.lit(i)), "[<>]", "").try_cast("int")

    qualifier = F.when(~F.col("opens") & (F.element_at("p", -2) == "mobile_element_type"), F.element_at("p", -1))
    features = rows.filter("feature > 0").groupBy("source", "feature").agg(
        F.max(F.when(F.col("opens"), F.struct(number(1).alias("a"), number(2).alias("b"), F.try_element_at("p", F.lit(3)).alias("kind")))).alias("f"),
        F.max(qualifier).alias("type"),
    )
    kept = features.filter((F.col("f.kind") == "mobile_element") & (F.contains(F.lower("type"), F.lit("insertion sequence")) | F.contains(F.lower("type"), F.lit("is"))))
    spans = kept.select(
        "source", "feature", (F.least("f.a", "f.b") - 1).alias("start"), F.greatest("f.a", "f.b").alias("end"),
        F.when(F.col("f.a") <= F.col("f.b"), "+").otherwise("-").alias("strand"), "type",
    )
    return spans.groupBy("source", "start", "end").agg(F.min_by(F.struct("strand", "type"), "feature").alias("x")).select("source", "start", "end", "x.*")


def third_party_elements(rows: DataFrame) -> DataFrame:
    """Elements of another tool's table (seqID, family, isBegin, isEnd, strand, type): 0-based, type c is complete; bad rows go."""
    out = rows.select(
        F.col("seqID").alias("contig_id"), "family", (F.col("isBegin").try_cast("int") - 1).alias("start"), F.col("isEnd").try_cast("int").alias("end"),
        "strand", F.when(F.col("type") == "c", "complete").otherwise("partial").alias("status"),
    )
    return out.filter("start IS NOT NULL AND end IS NOT NULL AND end > start")


def profile_records(spark: SparkSession, path: str, include: str, exclude: str) -> DataFrame:
    """Records of a profile library, ended by //, whose name or description matches ``include`` and not ``exclude``."""
    rows = spark.read.text(path, lineSep="//\n").filter(F.trim("value") != "")
    rows = rows.select(F.regexp_extract("value", r"(?m)^NAME\s+(.*)$", 1).alias("name"), F.regexp_extract("value", r"(?m)^DESC\s+(.*)$", 1).alias("description"), "value")
    text = F.lower(F.concat_ws(" ", "name", "description"))
    return rows.filter(text.rlike(include) & ~text.rlike(exclude))


def alpha_carbons(lines: DataFrame, value: str = "value") -> DataFrame:
    """Coordinates and confidence of the CA atoms of a structure file's fixed-width lines."""
    line = F.col(value)

    def cut(a: int, b: int, kind: str) -> Column:
        return F.trim(F.substring(line, a + 1, b - a)).try_cast(kind)

    return lines.filter(line.startswith("ATOM") & (F.trim(F.substring(line, 13, 4)) == "CA")).select(
        cut(22, 26, "int").alias("residue"), cut(30, 38, "double").alias("x"), cut(38, 46, "double").alias("y"), cut(46, 54, "double").alias("z"), cut(60, 66, "double").alias("plddt")
    )


def gff3_lines(elements: DataFrame, source: str = "mobilome") -> DataFrame:
    """(seq, value): GFF3 rows of elements, 1-based, to be written in order after the version line."""
    attributes = F.concat_ws(
        ";",
        F.concat(F.lit("ID="), F.col("element_id")), F.concat(F.lit("Family="), F.col("family")), F.concat(F.lit("Status="), F.col("status")),
        F.concat(F.lit("Score="), F.format_string("%.4f", F.col("composite_score").cast("double"))),
        F.when(F.col("tir_length").isNotNull(), F.concat(F.lit("TIR_len="), F.col("tir_length").cast("string"))),
        F.when(F.col("tsd_sequence").isNotNull(), F.concat(F.lit("TSD="), F.col("tsd_sequence"))),
        F.when(F.col("structure_type").isNotNull(), F.concat(F.lit("Structure="), F.col("structure_type"))),
    )
    body = F.concat_ws(
        "\t", F.col("contig_id"), F.lit(source), F.lit("mobile_genetic_element"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"),
        F.format_string("%.2f", F.col("composite_score").cast("double")), F.col("strand"), F.lit("."), attributes,
    )
    head = elements.sparkSession.createDataFrame([("", -1, "##gff-version 3")], "contig_id string, start long, value string")
    rows = elements.select("contig_id", F.col("start").cast("long").alias("start"), body.alias("value"))
    return head.unionByName(rows)


def write_elements(elements: DataFrame, contigs: DataFrame, path: str) -> None:
    """Elements as FASTA wrapped at 80 with rich headers: id, place, family, status and score."""
    s = contigs.select(F.col("contig_id").alias("_c"), F.col("sequence").alias("_s"))
    cut = elements.join(s, F.col("contig_id") == F.col("_c")).withColumn("_e", F.substr("_s", F.col("start") + 1, F.col("end") - F.col("start")))
    write_fasta(cut, path, "element_id", "_e", element_header(), 80)


def element_header() -> Column:
    return F.concat(
        F.col("element_id"), F.lit(" "), F.col("contig_id"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"),
        F.lit(" family="), F.col("family"), F.lit(" status="), F.col("status"), F.lit(" score="), F.format_string("%.4f", F.col("composite_score").cast("double")),
    )


def write_gff3(elements: DataFrame, path: str) -> None:
    gff3_lines(elements).orderBy("contig_id", "start", "value").select("value").write.mode("errorifexists").text(path)


def write_parquet(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).parquet(path)


def write_tsv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).csv(path, sep="\t", header=True)


def summary_json(frame: DataFrame, groups: dict[str, tuple[str, list[str]]]) -> str:
    """Counts as JSON: the total, and per name the counts of a column with zeros for its listed values; one job."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for name, (column, values) in groups.items():
        aggs += [F.count_if(F.col(column) == v).alias(f"{name}\x1f{v}") for v in values]
    row = frame.agg(*aggs).first().asDict()
    out: dict = {"total": row.pop("total")}
    for key, n in row.items():
        name, value = key.split("\x1f")
        out.setdefault(name, {})[value] = n
    return json.dumps(out, sort_keys=True)
