"""Test contigs with known elements: whole genomic contexts, and fragments cut as in a draft assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.functions.decisions import NON_CANONICAL
from mobilome.functions.sequence import direct_repeat_length, gc_fraction, inverted_repeat_length, primary_orf, random_dna

# Lengths of direct repeats by family where the annotation gives none.
DEFAULT_REPEAT = {
    "IS1": 9, "IS3": 3, "IS4": 9, "IS5": 4, "IS6": 8, "IS21": 4, "IS30": 2, "IS66": 8, "IS256": 8, "IS481": 6, "IS630": 2, "IS701": 5, "IS982": 8,
    "IS1182": 8, "IS1380": 4, "IS1595": 8,
}
OTHER_REPEAT = 4
#: Elements of other lengths are no test cases.
LEAST_ELEMENT, MOST_ELEMENT = 200, 10_000
#: Fragments of each class by default.
CLASSES = {"complete": 50, "edge_5p_truncated": 30, "edge_3p_truncated": 30, "edge_both_truncated": 10}


def family_repeat_length(note: Column, family: Column) -> Column:
    """Length of the direct repeat in a note, else the family's, else 4; null in a family without any."""
    entries = [x for k, v in DEFAULT_REPEAT.items() for x in (F.lit(k), F.lit(v))]
    usual = F.coalesce(F.try_element_at(F.create_map(*entries), family), F.lit(OTHER_REPEAT))
    return F.when(~family.isin(*NON_CANONICAL), direct_repeat_length(note, usual))


def draw(seed: Column, low: Column, high: Column) -> Column:
    """A whole number from low to high, both included, from the MD5 of a seed; low if the range is empty."""
    u = F.conv(F.substr(F.md5(seed), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return (low + u % F.greatest(high - low + 1, F.lit(1))).cast("int")


def genomic_contexts(elements: DataFrame, flank: int = 600, seed: str = "42") -> DataFrame:
    """Elements (is_name, family, dna_sequence, orf_annotation, dr_length, tir_left) in random flanks of their own GC share.

    In families with repeats the direct repeat stands on both sides.  Everything drawn comes from the MD5 of
    name and seed.  Lengths outside LEAST_ELEMENT to MOST_ELEMENT are left out: such elements are no test cases.
    """
    s = F.upper(F.trim(F.col("dna_sequence")))
    base = elements.select("is_name", "family", s.alias("_s"), "orf_annotation", "dr_length", "tir_left").filter(F.length("_s").between(LEAST_ELEMENT, MOST_ELEMENT))
    repeat = family_repeat_length(F.col("dr_length"), F.col("family"))
    base = base.select("*", F.md5(F.concat_ws("_", "is_name", F.lit(seed))).alias("_root"), gc_fraction(F.col("_s")).alias("_gc"))
    root, gc = F.col("_root"), F.col("_gc")  # computed once a row, not once for every base drawn
    parts = base.select(
        "*", F.length("_s").alias("_n"), primary_orf(F.col("orf_annotation"), F.length("_s")).alias("_orf"), repeat.alias("annotated_tsd_len"),
        F.when(~F.col("family").isin(*NON_CANONICAL), inverted_repeat_length(F.col("tir_left"))).alias("annotated_tir_len"),
        random_dna(F.concat(root, F.lit("u")), flank, gc).alias("_u"), random_dna(F.concat(root, F.lit("d")), flank, gc).alias("_d"), random_dna(F.concat(root, F.lit("t")), 20, gc).alias("_t"),
    )
    site = F.when(F.col("annotated_tsd_len").isNotNull(), F.substr("_t", F.lit(1), F.col("annotated_tsd_len")))
    parts = parts.withColumn("true_tsd_seq", site).withColumn("true_start", F.lit(flank) + F.coalesce("annotated_tsd_len", F.lit(0)))
    gap = F.coalesce("true_tsd_seq", F.lit(""))
    return parts.select(
        "is_name", "family", (~F.col("family").isin(*NON_CANONICAL)).alias("is_canonical"), F.concat("_u", gap, "_s", gap, "_d").alias("contig_sequence"), "true_start",
        (F.col("true_start") + F.col("_n")).alias("true_end"), F.col("_n").alias("true_length"), (F.col("true_start") + F.col("_orf.start")).alias("tpase_start"),
        (F.col("true_start") + F.col("_orf.end")).alias("tpase_end"), F.col("_orf.strand").alias("tpase_strand"), "annotated_tir_len", "annotated_tsd_len",
        F.when(F.col("annotated_tir_len").isNotNull(), F.substr("_s", F.lit(1), F.col("annotated_tir_len"))).alias("true_tir_seq"), "true_tsd_seq",
    ).withColumn("contig_length", F.length("contig_sequence"))


def fragment_classes(contexts: DataFrame, counts: dict[str, int] | None = None, seed: str = "42") -> DataFrame:
    """``contexts`` dealt to the classes in MD5 order of their names: the first ones complete, then cut on the left, the right, and both sides.

    Contexts beyond the sum of ``counts`` are not used: this is a sampling operator.
    """
    counts = CLASSES if counts is None else counts
    order = F.md5(F.concat_ws(":", F.lit(seed), "is_name"))
    # As many names as the counts ask for, which are parameters, in their order; the contexts stay where they are.
    names = contexts.select(F.col("is_name").alias("_name"), order.alias("_order")).orderBy("_order", "_name").limit(sum(counts.values()))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order", "_name"))
    upto, kind = 0, None
    for name, n in counts.items():
        upto += n
        kind = F.when(F.col("_place") <= upto, name) if kind is None else kind.when(F.col("_place") <= upto, name)
    chosen = names.withColumn("_place", place).select("_name", kind.alias("gold_truncation"))
    return contexts.join(F.broadcast(chosen), F.col("is_name") == F.col("_name")).drop("_name")


def cut_fragments(classed: DataFrame, seed: str = "42") -> DataFrame:
    """Contigs cut by class, with where the element lies in them: contig_id, sequence, gold_start, gold_end, is_positive.

    A left cut falls 20 to 250 bases inside the element (a third of it at most), a right cut likewise, a double cut 40 to 150 bases
    inside on either side.
    """
    c = F.col
    n, kind = F.length("contig_sequence"), c("gold_truncation")

    def number(tag: str, low, high) -> Column:
        return draw(F.concat_ws(":", F.lit(seed), "is_name", F.lit(tag)), F.lit(low), high if isinstance(high, Column) else F.lit(high))

    inside = number("cut", 20, F.least(F.lit(250), F.floor(c("true_length") / 3).cast("int")))
    both = c("true_start") + number("left", 40, 150)
    left = F.when(kind == "edge_5p_truncated", c("true_start") + inside).when(kind == "edge_3p_truncated", F.greatest(F.lit(0), c("true_start") - number("flank", 150, 400)))
    left = left.when(kind == "edge_both_truncated", both).otherwise(0)
    right = F.when(kind == "edge_5p_truncated", F.least(n, left + F.greatest(F.lit(650), c("true_length") - inside + 300))).when(kind == "edge_3p_truncated", c("true_end") - inside)
    right = F.least(n, right.when(kind == "edge_both_truncated", F.greatest(both + 550, c("true_end") - number("right", 40, 150))).otherwise(n))
    cut = classed.select("*", left.alias("_l"), right.alias("_r"))
    size = c("_r") - c("_l")
    return cut.select(
        F.concat_ws("_", F.lit("fragment"), kind, "is_name").alias("contig_id"), F.substr("contig_sequence", c("_l") + 1, size).alias("sequence"), size.alias("contig_length"),
        "is_name", "family", F.greatest(c("true_start") - c("_l"), F.lit(0)).alias("gold_start"), F.least(c("true_end") - c("_l"), size).alias("gold_end"), "gold_truncation", F.lit(True).alias("is_positive"),
    )


def background_fragments(genomes: DataFrame, id_col: str, sequence: str, count: int = 50, start: int = 2_100_000, least: int = 800, most: int = 3500, gap: int = 500, seed: str = "42") -> DataFrame:
    """``count`` contigs without an element from each genome, one after the other from ``start`` on, ``gap`` apart."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: draw(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), i.cast("string")), F.lit(least), F.lit(most)))
    begun = F.aggregate(
        F.col("_n"), F.struct(F.lit(start).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n + gap).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), n.alias("n")))).alias("out")),
        lambda acc: acc["out"],
    )
    cut = genomes.select(F.col(id_col).alias("_id"), F.col(sequence).alias("_s"), steps.alias("_n")).select("_id", "_s", F.posexplode(begun).alias("_i", "_c"))
    piece = F.upper(F.substr("_s", F.col("_c.at") + 1, F.col("_c.n")))
    return cut.select(
        F.concat_ws("_", F.lit("fragment_negative"), F.col("_id").cast("string"), F.format_string("%03d", "_i")).alias("contig_id"), piece.alias("sequence"), F.length(piece).alias("contig_length"),
        F.lit("none").alias("is_name"), F.lit("none").alias("family"), F.lit(-1).alias("gold_start"), F.lit(-1).alias("gold_end"), F.lit("negative").alias("gold_truncation"), F.lit(False).alias("is_positive"),
    ).filter("contig_length > 0")
