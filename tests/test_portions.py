"""Rows cut by their texts."""

import pandas as pd

from mobilome.operators import portions as P
from mobilome.operators import scan, similarity


def test_rows_stay_whole_and_in_order():
    rows = pd.DataFrame({"id": range(7), "a": ["x" * 50, None, "", "y" * 500, "z", "é" * 60, "w" * 40], "b": ["", "q" * 90, None, "", "", "", ""]})
    cut = list(P.portions([rows, rows.iloc[:0]], "a", "b", most=100))
    assert len(cut) > 3 and len(cut[-1]) == 0
    assert pd.concat(cut[:-1]).reset_index(drop=True).equals(rows)
    assert all(len(c) == 1 or c[["a", "b"]].fillna("").map(len).to_numpy().sum() < 100 + 500 for c in cut)


def test_results_do_not_depend_on_portions(spark):
    """A batch of more characters than a portion gives what rows by themselves give."""
    line = "one two three four five six seven eight nine ten "
    texts = [(i, f"{line * 1000} of {i % 5}") for i in range(50)]
    assert sum(len(t) for _, t in texts) > 2 * P.CHARACTERS
    contigs = [(str(i), "ATG" + "GCTGAA" * (20_000 + i) + "TAA") for i in range(20)]

    def results(parts):
        t = spark.createDataFrame(texts, "id long, text string").repartition(parts, "id")
        c = spark.createDataFrame(contigs, "contig_id string, sequence string").repartition(parts, "contig_id")
        return sorted(similarity.gram_hits(t, t, 8).collect()), sorted(scan.find_genes(c).collect())

    whole = results(1)
    assert len(whole[0]) == 2500 and len(whole[1]) and whole == results(50)
