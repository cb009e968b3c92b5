"""Gene finding with a coding model that is trained on the contigs themselves.

Codon pairs inside long reading frames, and anywhere, are counted in the cluster; their log odds score every frame of every contig,
and dynamic programming over a contig's frames takes the set of genes that scores most.  The genes found give new counts, and so a new model,
for a number of rounds.  The model is 4,096 odds and three of start codons, whatever the contigs.

Defined results: null and empty sequences have no genes; letters are taken in upper case, and codons with other letters neither speak for nor against a gene; contigs
shorter than a gene have none; a frame may begin or end beyond the contig; repeated rows are found genes in alike; an empty table gives an empty result; other columns are not read.
A contig is one row and is searched by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.functions import gene_kernels as G

#: Bases of the frames that a first model learns from, of the shortest gene, what a gene costs, and rounds of training.
LONG, LEAST, COST, ROUNDS = 300, 90, 6.0, 2
#: Chances of the three start codons before any gene is known.
FIRST_STARTS = np.array([0.78, 0.14, 0.08])
_BACKGROUND, _CODING, _STARTS = 0, 1, 2

GENES = "contig_id string, gene_id string, start int, end int, strand string, partial_left boolean, partial_right boolean, protein string"


def strands(dna: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(strand, bases, codons) of both strands."""
    codes = G.base_codes(dna.upper())
    return [(s, c, G.codons(c)) for s, c in (("+", codes), ("-", G.reversed_codes(codes)))]


def best_genes(dna: str, model: tuple[np.ndarray, np.ndarray], cost: float = COST, least: int = LEAST) -> list[tuple[int, int, str, bool, bool, float]]:
    """(start, end, strand, open on the left, open on the right, score) of the genes of a sequence, from left to right."""
    n, found = len(dna), []
    for strand, _, codon in strands(dna):
        for a, z, opened, ends_open, score in G.scored_frames(codon, n, *model, cost, least):
            found.append((a, z, "+", opened, ends_open, score) if strand == "+" else (n - z, n - a, "-", ends_open, opened, score))
    return sorted(found[i] for i in G.chosen([f[:2] for f in found], [f[5] for f in found]))


def _counts(model: tuple[np.ndarray, np.ndarray] | None, long: int, cost: float, least: int):
    """Counts (kind, item, n) of codon pairs in genes, or in long frames without a model, of those anywhere, and of start codons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs, anywhere, starts = np.zeros(G.HEXAMERS, np.int64), np.zeros(G.HEXAMERS, np.int64), np.zeros(3, np.int64)
            for dna in pdf["sequence"]:
                n = len(dna)
                genes = best_genes(dna, model, cost, least) if model is not None else None
                for strand, _, codon in strands(dna):
                    if genes is None:
                        own = [f[:2] for f in G.longest_frames(codon, n, long)]
                    else:
                        mine = [g for g in genes if g[2] == strand]
                        own = [(g[0], g[1]) if strand == "+" else (n - g[1], n - g[0]) for g in mine]
                        whole = [a for (a, _), g in zip(own, mine) if not (g[3] if strand == "+" else g[4])]
                        starts += np.bincount(G._START[codon[whole]], minlength=3) if whole else 0
                    pairs += G.hexamer_counts(codon, own)
                    anywhere += G.hexamer_counts(codon, None)
            rows = [(kind, i, x) for kind, a in ((_CODING, pairs), (_BACKGROUND, anywhere), (_STARTS, starts)) for i, x in enumerate(a.tolist()) if x]
            yield pd.DataFrame(rows, columns=["kind", "item", "n"])

    return run


def train(contigs: DataFrame, rounds: int = ROUNDS, long: int = LONG, cost: float = COST, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of codon pairs, log odds of start codons) of (contig_id, sequence)."""
    model = None
    for _ in range(rounds + 1):
        rows = contigs.filter("sequence IS NOT NULL").select("sequence")
        # At most 2 x 4,096 + 3 rows.
        found = rows.mapInPandas(_counts(model, long, cost, least), "kind int, item int, n long").groupBy("kind", "item").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros((3, G.HEXAMERS))
        for r in found:
            counts[r["kind"], r["item"]] = r["n"]
        chance = (counts[:2] + 1) / (counts[:2].sum(1, keepdims=True) + G.HEXAMERS)
        starts = counts[_STARTS, :3] + 10 * FIRST_STARTS
        model = np.log(chance[_CODING] / chance[_BACKGROUND]), np.log(starts / starts.sum() * 3)
    return model


def predict_genes(contigs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, cost: float = COST, least: int = LEAST) -> DataFrame:
    """Genes of (contig_id, sequence) with their proteins, numbered along each contig; without a model one is trained on the contigs."""
    model = train(contigs, cost=cost, least=least) if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, dna in zip(pdf["contig_id"], pdf["sequence"]):
                dna = dna or ""
                n, codon = len(dna), {s: c for s, _, c in strands(dna)}
                for i, (a, z, strand, left, right, _) in enumerate(best_genes(dna, model, cost, least), 1):
                    protein = G.protein_of(codon["+"], a, z) if strand == "+" else G.protein_of(codon["-"], n - z, n - a)
                    rows.append((name, f"{name}_{i}", a, z, strand, left, right, protein))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GENES.split(", ")])

    return contigs.select(F.col("contig_id").cast("string").alias("contig_id"), "sequence").mapInPandas(run, GENES)
