from mobilome.plans import files
from mobilome.storage import shared_dir


def test_structures_of_all_portions_count_and_leave_no_files(spark, tmp_path, monkeypatch):
    rows = [(i, "Mobile elements move " * (i * 7 % 400)) for i in range(60)] + [(None, "abc"), (70, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    once = files.structure_file(spark, str(tmp_path)).collect()[0]
    monkeypatch.setattr(files, "PORTION_BYTES", 1000)
    many = files.structure_file(spark, str(tmp_path)).collect()[0]
    assert (once.atoms, once["last"]) == (many.atoms, many["last"]) == (sum(18 * (i * 7 % 400) for i in range(60)) + 3, 6500)
    assert all(abs(once[c] - many[c]) < 0.01 for c in ("x", "y", "z", "plddt"))
    at = f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}"
    import os

    assert not [x for x in os.listdir(at) if x.startswith("structures-")]


def test_texts_of_chains_are_their_lines(spark):
    from pyspark.sql import functions as F

    from mobilome.operators import structures

    chains = [("ACDEFGHIKLMNPQRSTVWY" * 600)[:n] for n in [*range(1, 45), 99, 511, 512, 513, 4999, 5000, 5001, 6500, 6577, 6578, 6579, 10_001]] + ["", None, "AÄC" * 9]
    rows = spark.createDataFrame([(c,) for c in chains], "aa string")
    lines = {r.aa: "\n".join(r.l) for r in rows.select("aa", structures.structure_lines(F.col("aa")).alias("l")).collect() if r.aa}
    assert sorted(r.value for r in structures.structure_texts(rows, "aa").collect()) == sorted(lines.values())
