"""Profile models of protein families, built and searched in the cluster.

A family's members are aligned to its centre, the member whose words most others share, pair by pair; columns, residues and moves
are counted by aggregation, and a model is made of at most 27 counts a column.  A search joins words that score well under a model to the words of
the proteins; only proteins with two hits on one diagonal are run through the model, in batches.  A family is never one group: its
members meet only as counts.

Defined results: null families, ids and sequences take no part; letters are taken in upper case; families of fewer than ``least`` members have no
model; ties of the centre go to the smaller id; repeated rows count as often as they occur; empty inputs give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.functions import alignment_kernels as A
from mobilome.functions import profile_kernels as P
from mobilome.functions.sequence import kmers
from mobilome.operators.alignment import search, two_hits
from mobilome.operators.components import connected_components
from mobilome.operators.joins import join_answers
from mobilome.operators.portions import portions
from mobilome.storage import materialize

#: Letters of the words by which a family's centre is chosen, and of those that a search meets by; bits that the latter score at least.
CENTRE_WORD, WORD, NEAR = 3, 4, 9.0
#: Pairs that one task aligns, and proteins that one runs through models, on average.
TASK_PAIRS, TASK_PROTEINS = 2_000, 2_000
#: Proteins, on average, that lie in one row with the model they are run through, and letters whose alignments or counts are held at a time.
ROW_PROTEINS, LETTERS = 250, 250_000


def _members(proteins: DataFrame, family: str, id_col: str, sequence: str, least: int) -> DataFrame:
    rows = proteins.select(F.col(family).cast("string").alias("family"), F.col(id_col).cast("string").alias("id"), F.upper(F.col(sequence)).alias("sequence"))
    rows = rows.filter("family IS NOT NULL AND id IS NOT NULL AND sequence <> ''")
    large = rows.groupBy("family").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return rows.join(large.select("family"), "family", "left_semi")


def family_centres(members: DataFrame, k: int = CENTRE_WORD) -> DataFrame:
    """(family, centre): of each family the sequence whose distinct words, on average, most members hold."""
    own = members.select("family", "id", F.explode(F.array_distinct(kmers(F.col("sequence"), k))).alias("word"))
    shared = own.groupBy("family", "word").agg(F.count(F.lit(1)).alias("n"))
    worth = own.join(shared, ["family", "word"]).groupBy("family", "id").agg((F.sum("n") / F.count(F.lit(1))).alias("worth"))
    best = members.join(worth, ["family", "id"], "left")
    chosen = F.max_by("sequence", F.struct(F.coalesce(F.round("worth", 9), F.lit(0.0)), F.length("sequence"), "sequence"))
    return best.groupBy("family").agg(chosen.alias("centre"))


def align_to_centres(members: DataFrame) -> DataFrame:
    """(family, id, width, columns, places, sequence): where the residues at ``places`` of each member stand in the ``width`` columns of its family's centre."""
    pairs = members.join(family_centres(members), "family")
    pairs = pairs.repartition(1 + members.count() // TASK_PAIRS, F.xxhash64("family", "id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches, "centre", "sequence", most=LETTERS):
            found = A.align_pairs([A.encoded(s) for s in pdf["centre"]], [A.encoded(s) for s in pdf["sequence"]], local=False)
            yield pd.DataFrame(
                {
                    "family": pdf["family"], "id": pdf["id"], "width": pdf["centre"].map(len), "columns": [f.q_at for f in found],
                    "places": [f.t_at for f in found], "sequence": pdf["sequence"],
                }
            )

    return pairs.mapInPandas(run, "family string, id string, width int, columns array<int>, places array<int>, sequence string")


def aligned_rows(aligned: DataFrame) -> DataFrame:
    """(family, id, row): each member as letters and gaps over its family's columns; what it has between them is left out of the row."""

    @F.pandas_udf("string")
    def row(width: pd.Series, columns: pd.Series, places: pd.Series, sequence: pd.Series) -> pd.Series:
        out = []
        for w, c, p, s in zip(width, columns, places, sequence):
            letters = ["-"] * w
            for i, j in zip(c, p):
                letters[i] = s[j]
            out.append("".join(letters))
        return pd.Series(out)

    return aligned.select("family", "id", row("width", "columns", "places", "sequence").alias("row"))


def _events(kept: np.ndarray, columns: np.ndarray, places: np.ndarray, residues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, kind) of what one member adds to its family's counts: its residues, and the moves between its first and last match."""
    inside = np.isin(columns, kept)
    at, place = np.searchsorted(kept, columns[inside]), places[inside]
    code = residues[place]
    known = code < 20
    out = [(at[known], code[known].astype(int))]
    if len(at) > 1:
        step, between = np.diff(at), np.diff(place) - 1
        one, here = step == 1, at[:-1]
        out.append((here[one & (between == 0)], np.full((one & (between == 0)).sum(), 20 + P.MM)))
        grows = one & (between > 0)
        for kind, times in ((P.MI, 1), (P.IM, 1), (P.II, between[grows] - 1)):
            where = np.repeat(here[grows], times)
            out.append((where, np.full(len(where), 20 + kind)))
        skips = ~one
        out.append((here[skips], np.full(skips.sum(), 20 + P.MD)))
        out.append((at[1:][skips] - 1, np.full(skips.sum(), 20 + P.DM)))
        length = step[skips] - 2
        where = np.repeat(here[skips] + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
        out.append((where, np.full(len(where), 20 + P.DD)))
    return tuple(np.concatenate(x) for x in zip(*out))


def profile_counts(aligned: DataFrame) -> DataFrame:
    """(family, column, kind, n): counts of residues (kind 0 to 19) and moves (from 20 on) in the columns that half of a family's members fill."""
    sizes = aligned.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    filled = aligned.select("family", F.explode("columns").alias("column")).groupBy("family", "column").agg(F.count(F.lit(1)).alias("n"))
    kept = filled.join(sizes, "family").filter(F.col("n") * 2 >= F.col("members"))
    # As many entries a family as its centre has residues.
    kept = materialize(kept.groupBy("family").agg(F.array_sort(F.collect_list("column")).alias("kept"), F.max("members").alias("members")), "profile-kept")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby("family"):
                columns = np.array(own["kept"].iloc[0])
                n = np.zeros(27 * len(columns), np.int64)
                for some in portions([own], "sequence", most=LETTERS):
                    found = [_events(columns, np.array(r.columns), np.array(r.places), A.encoded(r.sequence)) for r in some.itertuples(index=False)]
                    n += np.bincount(np.concatenate([c * 27 + k for c, k in found]).astype(np.int64), minlength=len(n))
                key = np.flatnonzero(n)
                yield pd.DataFrame({"family": name, "column": key // 27, "kind": key % 27, "n": n[key]})

    events = join_answers(aligned, kept, "family", "members").select("family", "kept", "columns", "places", "sequence").mapInPandas(run, "family string, column int, kind int, n long")
    return events.groupBy("family", "column", "kind").agg(F.sum("n").alias("n"))


def profile_models(proteins: DataFrame, family: str, id_col: str, sequence: str, least: int = 3) -> DataFrame:
    """(family, members, length, model): a fitted model of every family of at least ``least`` members."""
    members = materialize(_members(proteins, family, id_col, sequence, least), "profile-members")
    aligned = materialize(align_to_centres(members), "profile-aligned")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"))

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((int(pdf["column"].max()) + 1, 27))
        counts[pdf["column"], pdf["kind"]] = pdf["n"]
        model = P.fitted(P.estimated(counts))
        return pd.DataFrame({"family": [pdf["family"].iloc[0]], "length": [len(model)], "model": [model.packed()]})

    # A family's group has at most 27 rows a column.
    models = profile_counts(aligned).groupBy("family").applyInPandas(made, "family string, length int, model binary")
    return models.join(sizes, "family").select("family", "members", "length", "model")


def sub_families(proteins: DataFrame, family: str, id_col: str, sequence: str, identity: float = 0.4, coverage: float = 0.8) -> DataFrame:
    """``proteins`` with ``sub_family``: within its family, the proteins connected by hits of at least ``identity`` over both coverages."""
    rows = proteins.select(F.col(family).cast("string").alias("family"), F.col(id_col).cast("string").alias("id"), F.col(sequence).alias("sequence"))
    hits = search(rows, rows, "id", "sequence", apart=F.col("query") < F.col("target"))
    kind = rows.select("id", "family").distinct()
    near = hits.filter((F.col("fident") >= identity) & (F.least("qcov", "tcov") >= coverage)).select("query", "target")
    near = near.join(kind.select(F.col("id").alias("query"), F.col("family").alias("_q")), "query").join(kind.select(F.col("id").alias("target"), F.col("family").alias("_t")), "target")
    stars = connected_components(near.filter("_q = _t").select(F.col("query").alias("src"), F.col("target").alias("dst")))
    key = F.col(id_col).cast("string")
    joined = proteins.join(stars, key == F.col("node"), "left")
    return joined.withColumn("sub_family", F.concat_ws("_", F.col(family).cast("string"), F.coalesce("component", key))).drop("node", "component")


def profile_search(
    proteins: DataFrame, models: DataFrame, id_col: str, sequence: str, most_expected: float = 10.0, k: int = WORD, near: float = NEAR, filtered: bool = True
) -> DataFrame:
    """(query, family, bits, evalue, start, end): proteins that a model scores better than ``most_expected`` of them would by chance.

    ``models`` is read more than once: pass a written table.  Without ``filtered`` every protein runs through every model.
    """
    rows = proteins.select(F.col(id_col).cast("string").alias("query"), F.upper(F.col(sequence)).alias("sequence")).filter("query IS NOT NULL AND sequence <> ''")
    rows = materialize(rows.distinct(), "profile-queries")
    total = rows.count()

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, model in zip(pdf["family"], pdf["model"]):
                found = P.words(P.unpacked(model), k, near)
                yield pd.DataFrame({"target": name, "target_pos": [c for c, _ in found], "word": [w for _, w in found]})

    if filtered:
        known = models.select("family", "model").mapInPandas(own_words, "target string, target_pos int, word string")
        met = rows.select("query", F.posexplode(kmers(F.col("sequence"), k)).alias("query_pos", "word")).join(known, "word")
        pairs = two_hits(met, k).select("query", F.col("target").alias("family")).distinct()
    else:
        pairs = rows.select("query", F.explode(F.array(*[F.lit(r["family"]) for r in models.select("family").collect()])).alias("family"))
    pairs = materialize(pairs, "profile-pairs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                model = P.unpacked(r.model)
                size = np.array(list(map(len, r.sequence)))
                order = np.argsort(size, kind="stable")
                step = max(1, 2_000_000 // max(1, len(model)) // 8)
                for a in range(0, len(order), step):
                    some = order[a : a + step]
                    bits, start, end = P.best_paths(model, [A.encoded(r.sequence[i]) for i in some])
                    # Longer proteins have more places to score by chance.
                    mode = model.mode + np.log2(np.maximum(1, size[some]) / P.DRAWN)
                    expected = total * -np.expm1(-np.exp(-np.log(2) * (bits - mode)))
                    yield pd.DataFrame({"query": [r.query[i] for i in some], "family": r.family, "bits": bits, "evalue": expected, "start": start, "end": end})

    work = search_rows(pairs, rows, models).repartition(1 + pairs.count() // TASK_PROTEINS, "family", "part")
    found = work.drop("part").mapInPandas(run, "query string, family string, bits double, evalue double, start int, end int")
    return found.filter(F.col("evalue") <= most_expected)


def search_rows(pairs: DataFrame, proteins: DataFrame, models: DataFrame) -> DataFrame:
    """(family, part, query, sequence, model): the proteins that each model is to run through, about ROW_PROTEINS a row.

    A model is as large as many proteins, so it lies beside a row of them, not beside each.
    """
    sizes = materialize(pairs.groupBy("family").agg(F.count(F.lit(1)).alias("_n")), "profile-sizes")
    dealt = F.pmod(F.xxhash64("query"), F.ceil(F.col("_n") / ROW_PROTEINS)).alias("part")
    work = join_answers(pairs, sizes, "family", "_n").join(proteins, "query")
    work = work.groupBy("family", dealt).agg(F.collect_list(F.struct("query", "sequence")).alias("own")).join(models.select("family", "model"), "family")
    return work.select("family", "part", F.col("own.query").alias("query"), F.col("own.sequence").alias("sequence"), "model")


def best_family(hits: DataFrame) -> DataFrame:
    """Per query its best hit by bits, then by family."""
    return hits.groupBy("query").agg(F.min_by(F.struct("family", "bits", "evalue", "start", "end"), F.struct(-F.round("bits", 6), "family")).alias("b")).select("query", "b.*")
