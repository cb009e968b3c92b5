"""Keyed state over files that are cut anywhere, and progress of more batches than a query remembers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mobilome.operators import intervals
from mobilome.streaming.keyed import stream_islands
from mobilome.streaming.progress import watched
from mobilome.streaming.scans import incremental

SCHEMA = "contig string, start long, end long, family string, gene long"


def genes(rng, contigs=6, most=40):
    rows, gene = [], 0
    for c in range(contigs):
        at = 0
        for _ in range(rng.randrange(1, most)):
            at += rng.choice([0, 10, 200, 251, 900])
            gene += 1
            rows.append((f"c{c}", at, at + rng.randrange(1, 300), rng.choice(["a", "a", "a", "b", None]), gene))
    return rows


def files(spark, rows, cuts, folder):
    """The rows in order of place, whatever contig, cut into files of those sizes."""
    rows = sorted(rows, key=lambda r: (r[1], r[4]))
    for n, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        if a < z:
            spark.createDataFrame(rows[a:z], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.01)


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_of_the_files_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = genes(rng)
    want = intervals.islands(spark.createDataFrame(rows, SCHEMA), "contig", "start", "end", "family", 250, ("gene",))
    cuts = sorted(rng.sample(range(len(rows)), [1, 3, 6][seed]))
    files(spark, rows, cuts, f"{tmp_path}/in")
    with watched(spark) as listener:
        query = stream_islands(spark, f"{tmp_path}/in", SCHEMA, "contig", "start", "end", "family", 250, f"{tmp_path}/out", f"{tmp_path}/check", ("gene",))
        run = listener.finished(query)
    assert run.rows == len(rows) and run.error is None and run.batches >= len(cuts)
    got = spark.read.schema(f"{SCHEMA}, island long").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)


def test_a_late_gene_is_an_error(spark, tmp_path):
    for n, start in enumerate((500, 100)):
        spark.createDataFrame([("c", start, start + 50, "a", n)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    query = stream_islands(spark, f"{tmp_path}/in", SCHEMA, "contig", "start", "end", "family", 250, f"{tmp_path}/out", f"{tmp_path}/check")
    with pytest.raises(Exception, match="came after one at 500"):
        query.awaitTermination()


def test_idle_contigs_are_dropped_by_a_timer(spark, tmp_path):
    """After the pause the contig is unknown, and its islands are numbered from one again."""

    def rows_after(n):
        for _ in range(60):
            time.sleep(0.5)
            found = [r.island for r in spark.read.schema(f"{SCHEMA}, island long").parquet(f"{tmp_path}/out").orderBy("start").collect()] if (tmp_path / "out").exists() else []
            if len(found) >= n:
                return found
        raise TimeoutError

    files(spark, [("c", i * 1000, i * 1000 + 10, "a", i) for i in range(3)], [], f"{tmp_path}/in")
    query = stream_islands(spark, f"{tmp_path}/in", SCHEMA, "contig", "start", "end", "family", 250, f"{tmp_path}/out", f"{tmp_path}/check", idle_ms=1000)
    try:
        assert rows_after(3) == [1, 2, 3]
        time.sleep(5)
        files(spark, [("c", 9000, 9010, "a", 9)], [], f"{tmp_path}/in")
        assert rows_after(4) == [1, 2, 3, 1]
    finally:
        query.stop()


def test_every_batch_of_a_long_run_is_counted(spark, tmp_path):
    n = 102
    spark.range(n * 5).repartition(n).write.parquet(f"{tmp_path}/in")
    seen = []
    with watched(spark, lambda run_id, run: seen.append(run.rows)) as listener:
        query = incremental(spark, f"{tmp_path}/in", "id long", lambda b: b.agg(F.count(F.lit(1)).alias("n")), f"{tmp_path}/out", f"{tmp_path}/check")
        run = listener.finished(query)
    assert run.rows == n * 5 and run.batches >= n > len(query.recentProgress)
    assert run.seconds > sum(p["durationMs"].get("triggerExecution", 0) for p in query.recentProgress) / 1000
    assert seen[-1] == n * 5 and sorted(seen) == seen
    rates = run.rates(1_000_000, n)
    assert rates["seconds"] == run.seconds and rates["contigs_per_second"] == pytest.approx(n / run.seconds)


def test_files_of_a_batch_for_every_core_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """A batch of as many files as there are cores is not dealt anew, which would sort its records; one of fewer is."""
    from mobilome.operators import boundaries
    from mobilome.streaming.scans import stream_pools

    dealt, real = [], boundaries.spread
    monkeypatch.setattr(boundaries, "spread", lambda rows: dealt.append(1) or real(rows))
    lines = [(f">sp|K{i}|E{i} Enolase OS=Bacillus subtilis OX=1\n{'M' * (100 + i)}",) for i in range(40)]
    spark.createDataFrame(lines, "value string").repartition(4).write.option("compression", "gzip").text(f"{tmp_path}/in")
    found = []
    for n in (spark.sparkContext.defaultParallelism, 1):
        stream_pools(spark, f"{tmp_path}/in", f"{tmp_path}/out{n}", f"{tmp_path}/check{n}", n).awaitTermination()
        found.append(sorted(r.accession for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out{n}").collect()))
        assert (len(dealt) > 0) == (n == 1)
    assert len(found[0]) == 40 and found[0] == found[1]


class Held:
    """A state that counts what it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def get(self):
        self.asked += 1
        return self.value

    def exists(self):
        self.asked += 1
        return self.value is not None

    def update(self, value):
        self.asked += 1
        self.value = value


def test_the_state_is_asked_twice_a_call():
    """Once for the open end and once for the new one, for any number of genes; islands are those of the genes one by one."""
    import pandas as pd

    from mobilome.streaming.keyed import OpenIslands

    rng = random.Random(4)
    rows = sorted(genes(rng, 1, 60), key=lambda r: (r[1], r[4]))
    work, held = OpenIslands("start", "end", "family", 250, ("gene",), SCHEMA.replace(",", "").split()[::2], None), Held()
    work.open, got, at, calls = held, [], 0, 0
    while at < len(rows):
        some = rows[at : at + rng.randrange(1, 6)]
        at, calls = at + len(some), calls + 1
        frame = pd.DataFrame(rng.sample(some, len(some)), columns=work.columns)
        got += [tuple(r) for f in work.handleInputRows(("c0",), iter([frame]), None) for r in f[["gene", "island"]].itertuples(index=False)]
    want, island, last = [], 0, None
    for r in rows:
        island += last is None or r[1] - last[2] > 250 or r[3] is None or r[3] != last[3]
        want.append((r[4], island))
        last = r
    assert got == want and held.asked == 2 * calls
