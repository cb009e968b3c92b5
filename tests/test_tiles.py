"""Tiles of sequence files against whole records, at every split of the files."""

import gzip
import random

import pytest

from mobilome.operators import scan
from mobilome.sources import fasta, tiles


def written(folder, rng, files=2, records=5):
    """Files of records in lines of several widths, with white space, empty lines and repeated names."""
    folder.mkdir()
    for f in range(files):
        out = ["ACGT\n"] if f == 0 else []  # bases before the first header
        for r in range(records):
            s = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 1, 59, 60, 61, 700, 2500])))
            width = rng.choice([7, 60, 10**6])
            out.append(f">c{r if f else 'x' + str(r)} some words {f}\n" + "".join(s[i : i + width] + rng.choice(["\n", "\r\n", " \n", "\n\n"]) for i in range(0, len(s), width)))
        (folder / f"f{f}.fa").write_bytes("".join(out).encode())


def records(spark, path):
    found = fasta.read_fasta(spark, path).collect()
    return {r.id: r.sequence for r in found if r.sequence and r.id.startswith("c")}


@pytest.mark.parametrize("split", [37, 200, 1000, 1 << 20])
def test_lines_make_the_records_at_every_split(spark, tmp_path, split):
    written(tmp_path / "in", random.Random(3))
    want = records(spark, f"{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = tiles.sequence_lines(spark, f"{tmp_path}/in").collect()
        assert len({r.record for r in lines}) == len(want)
        got = {}
        for r in sorted(lines, key=lambda r: (r.contig_id, r.offset)):
            assert len(got.get(r.contig_id, "")) == r.offset and r.description.startswith(f"{r.contig_id} some words")
            got[r.contig_id] = got.get(r.contig_id, "") + r.bases
        assert got == want
        for size, overlap in ((100, 30), (64, 0), (5000, 10)):
            found = {}
            for t in tiles.read_tiles(spark, f"{tmp_path}/in", size, overlap).collect():
                whole = want[t.contig_id]
                assert t.sequence == whole[max(0, t.own_start - overlap) : t.own_end + overlap] and t.start == max(0, t.own_start - overlap)
                assert t.at_end == (t.own_end + overlap >= len(whole))
                found.setdefault(t.contig_id, []).append((t.own_start, t.own_end))
            assert {c: sorted(x) for c, x in found.items()} == {c: [(a, min(a + size, len(s))) for a in range(0, len(s), size)] for c, s in want.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gzip_files(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">one x\nACGT\nAC\n>two\nGG\n"))
    got = {(t.contig_id, t.own_start, t.sequence) for t in tiles.read_tiles(spark, f"{tmp_path}/a.fa.gz", 4, 1).collect()}
    assert got == {("one", 0, "ACGTA"), ("one", 4, "TAC"), ("two", 0, "GG")}


def test_frames_of_tiles_are_those_of_wholes(spark, tmp_path):
    rng = random.Random(5)
    text = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((40, 900, 6000, 15_000))}
    (tmp_path / "g.fa").write_text("".join(f">{c}\n" + "\n".join(s[i : i + 70] for i in range(0, len(s), 70)) + "\n" for c, s in text.items()))
    whole = scan.find_genes(spark.createDataFrame([*text.items()], "contig_id string, sequence string"))
    want = sorted(map(tuple, whole.collect()))
    for size, overlap in ((2000, 1500), (5000, 1200), (100_000, 10)):
        got = tiles.find_genes_in_tiles(tiles.read_tiles(spark, f"{tmp_path}/g.fa", size, overlap))
        assert sorted(map(tuple, got.select(*whole.columns).collect())) == want
    with pytest.raises(Exception, match="longer than the overlap"):
        tiles.find_genes_in_tiles(tiles.read_tiles(spark, f"{tmp_path}/g.fa", 500, 60)).collect()


def test_lines_are_numbered_while_they_pass(spark, tmp_path):
    """Neighbouring lines of a record are one row, whatever batches they come in, and no plan sorts lines by block."""
    (tmp_path / "a.fa").write_text(">one x\n" + "ACGTACGTAC\n" * 500 + ">two\n" + "GG\n" * 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        rows = tiles.sequence_lines(spark, f"{tmp_path}/a.fa", most=300).orderBy("record", "offset").collect()
        assert len(rows) < 100 and max(len(r.bases) for r in rows) <= 320
        assert "".join(r.bases for r in rows if r.contig_id == "one") == "ACGTACGTAC" * 500
        assert [r.offset for r in rows if r.contig_id == "two"][:1] == [0] and sum(len(r.bases) for r in rows if r.contig_id == "two") == 600
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
