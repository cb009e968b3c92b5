"""From contigs to elements: reading frames, profile hits, islands, boundaries, scores, overlap resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.functions import boundary_kernels as K
from mobilome.functions import decisions as D
from mobilome.functions import gene_kernels as G
from mobilome.operators.boundaries import predict_boundaries
from mobilome.operators.intervals import islands, reduce_islands, resolve_overlaps
from mobilome.operators.portions import portions
from mobilome.storage import deal_small, materialize

def reading_frames(dna: str, least: int = 90) -> list[tuple[int, int, str, bool, bool, str]]:
    """(start, end, strand, open on the left, open on the right, protein) of the longest frame before each stop, in six frames."""
    n, out = len(dna), []
    codes = G.base_codes(dna)
    for strand, own in (("+", codes), ("-", G.reversed_codes(codes))):
        codon = G.codons(own)
        for a, b, left, right in G.longest_frames(codon, n, least):
            protein = G.protein_of(codon, a, b)
            out.append((a, b, "+", left, right, protein) if strand == "+" else (n - b, n - a, "-", right, left, protein))
    return sorted(out)


ORFS = "contig_id string, gene_id string, start int, end int, strand string, partial_left boolean, partial_right boolean, protein string"


def find_genes(contigs: DataFrame, least: int = 90) -> DataFrame:
    """Open reading frames of (contig_id, sequence); ``genes.predict_genes`` finds genes with a trained model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches, "sequence"):
            rows = [
                (c, f"{c}_{i + 1}", *g) for c, s in zip(pdf["contig_id"], pdf["sequence"]) for i, g in enumerate(reading_frames((s or "").upper(), least))
            ]
            yield pd.DataFrame(rows, columns=["contig_id", "gene_id", "start", "end", "strand", "partial_left", "partial_right", "protein"])

    return deal_small(contigs.select("contig_id", "sequence")).mapInPandas(run, ORFS)


def annotate(contigs: DataFrame, genes: DataFrame, hits: DataFrame, engine: str = "plan_a", primary: str = "best", least_bits: float = 10.6, gap: int = 250, edges: bool = False) -> DataFrame:
    """Elements of (contig_id, sequence) from genes and their best profile hits (gene_id, family, bits, evalue).

    With ``edges``, elements are classed by truncation at contig ends as well.  An unknown engine's name means
    ``plan_a`` then, and ``plan_b`` else.
    """
    engine = engine if engine in K.ENGINES else "plan_a" if edges else "plan_b"
    strong = hits.filter(F.col("bits") >= least_bits).groupBy("gene_id").agg(F.max_by(F.struct("family", "bits", "evalue"), F.struct(F.col("bits"), -F.col("evalue"), "family")).alias("h"))
    found = genes.join(strong, "gene_id").select("contig_id", "gene_id", "start", "end", "strand", "partial_left", "partial_right", "h.*")
    grouped = materialize(islands(found, "contig_id", "start", "end", "family", gap, ("end", "gene_id")), "islands")
    flags = grouped.groupBy(F.col("contig_id").alias("fc"), F.col("island").alias("fi")).agg(F.max("partial_left").alias("partial_left"), F.max("partial_right").alias("partial_right"))
    parts = reduce_islands(grouped, "contig_id", "start", "end", "gene_id", "bits", "evalue", ("family", "strand"), primary, ("end", "gene_id"))
    parts = parts.join(flags, (F.col("contig_id") == F.col("fc")) & (F.col("island") == F.col("fi"))).drop("fc", "fi")
    located = parts.withColumnsRenamed({"start": "orf_start", "end": "orf_end"}).join(contigs.select("contig_id", "sequence"), "contig_id")
    located = located.withColumn("contig_length", F.length("sequence"))
    keep = ("contig_id", "island", "orf_start", "orf_end", "strand", "family", "primary_gene", "n_genes", "score", "evalue", "partial_left", "partial_right", "contig_length")
    bounded = predict_boundaries(located, "sequence", "orf_start", "orf_end", "family", engine, keep)
    end = F.col("contig_length")
    start_at = F.greatest(F.lit(0), F.least(end - 1, F.col("start")))
    bounded = bounded.withColumn("start", start_at).withColumn("end", F.greatest(F.col("start") + 1, F.least(end, F.col("end"))))
    truncation = F.when(F.col("complete"), "complete").otherwise("internal_partial")
    if edges:
        touch = D.touches_edges(F.col("orf_start"), F.col("orf_end"), end, F.col("partial_left"), F.col("partial_right"))
        supported = F.coalesce(F.col("tir.length") >= 8, F.lit(False)) | F.col("structure").isNotNull()
        up = D.lookup(F.col("family"), K.DISTANCES, 0, K.DEFAULT_DISTANCES[0])
        down = D.lookup(F.col("family"), K.DISTANCES, 2, K.DEFAULT_DISTANCES[2])
        truncation = D.truncation_class(touch["left"], touch["right"], F.col("orf_start"), F.col("orf_end"), F.col("start"), F.col("end"), end, up, down, supported, F.col("complete"))
    bounded = bounded.withColumn("truncation", truncation)
    if edges:  # a reading frame that reaches both ends is the whole contig, whatever the search says
        whole = touch["left"] & touch["right"]
        bounded = bounded.withColumn("confidence", F.when(whole, 0.45).otherwise(F.col("confidence"))).withColumn("complete", F.col("complete") & ~whole)
    bounded = bounded.withColumn("start", F.when(F.col("truncation").isin("edge_both_truncated", "edge_5p_truncated"), 0).otherwise(F.col("start")))
    bounded = bounded.withColumn("end", F.when(F.col("truncation").isin("edge_both_truncated", "edge_3p_truncated"), end).otherwise(F.col("end")))
    scores = D.element_scores(
        F.col("family"), F.col("end") - F.col("start"), F.col("orf_end") - F.col("orf_start"), D.hit_score(F.col("score")),
        F.col("tir.length"), F.col("tir.identity"), F.col("tsd.score"), F.col("structure.stability_score"), F.col("complete"),
    )
    scored = bounded.withColumn("s", scores).select("*", "s.composite_score", F.col("s.status").alias("composite_status"))
    scored = scored.withColumn("status", D.final_status(F.col("truncation"), F.col("composite_status"), F.col("score")) if edges else F.col("composite_status"))
    # Written once: the boundary search is dear, and the overlap resolution reads its result twice.
    scored = materialize(scored.withColumn("key", F.concat_ws(":", "contig_id", "island")).drop("s"), "elements")
    kept = resolve_overlaps(scored, "contig_id", "start", "end", "composite_score", "key").select(F.col("key").alias("kept_key"))
    return scored.join(kept, F.col("key") == F.col("kept_key"), "left_semi").select(
        F.col("key").alias("element_id"), "contig_id", "start", "end", (F.col("end") - F.col("start")).alias("length"), "contig_length", "strand", "family",
        F.col("primary_gene").alias("tpase_gene_id"), F.col("score").alias("tpase_score"), F.col("evalue").alias("tpase_evalue"), "n_genes",
        "composite_score", "status", "truncation", "confidence", F.col("tir.length").alias("tir_length"), F.col("tsd.sequence").alias("tsd_sequence"), F.col("structure.feature_type").alias("structure_type"),
    )
