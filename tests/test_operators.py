"""Operators on small known cases."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mobilome.functions import decisions as D
from mobilome.functions import gene_kernels as G
from mobilome.functions import sequence as S
from mobilome.operators import datasets, hits, intervals, learning, metrics, scan, screening, similarity
from mobilome.operators.components import connected_components
from mobilome.plans import bindings
from mobilome.sources import fasta, tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    s = F.lit
    row = one(
        spark, rc=S.reverse_complement(s("AcgTN")), gc=S.gc_fraction(s("GGAT")), empty=S.gc_fraction(s("")), k=S.kmers(s("ACGT"), 3), none=S.kmers(s("AC"), 3),
        homo=S.is_homopolymer(s("AAAA")), ham=S.hamming(s("ACGT"), s("AGGA")), name=S.clean_family(s("IS200/IS605")), tok=S.structure_tokens(s("MDEEK")), pairs=S.bimodal_tokens(s("MKTI"), s("dpdc")),
        ir=S.inverted_repeat_length(s("18/22")), ir3=S.inverted_repeat_length(s("3")), dr=S.direct_repeat_length(s("9 bp"), s(4)), dr0=S.direct_repeat_length(s("none"), s(4)),
        sha=S.normalised_sha256(s(" ac\ngt ")), orf=S.primary_orf(s("120 (10 - 400), 300 (950 - 50)"), s(1000)), fallback=S.primary_orf(s("none"), s(1000)), dna=S.random_dna(s("x"), 12, s(0.5)),
    )
    assert row.rc == "NACGT" and row.gc == 0.5 and row.empty == 0.5 and row.k == ["ACG", "CGT"] and row.none == []
    assert row.homo and row.ham == 2 and row.name == "IS200_IS605" and row.tok == "mddek" and row.pairs == "Md Kp Td Ic"
    assert (row.ir, row.ir3, row.dr, row.dr0) == (22, None, 9, 4)
    assert row.sha == __import__("hashlib").sha256(b"ACGT").hexdigest()
    assert tuple(row.orf) == (49, 950, "-") and tuple(row.fallback) == (150, 850, "+") and set(row.dna) <= set("ACGT")


def test_routes_and_fusion(spark):
    cases = [(0.2, False, "REJECT"), (0.5, False, "UNCERTAIN"), (0.2, True, "UNCERTAIN"), (0.9, True, "ACCEPT_KNOWN"), (0.9, False, "STAGE2A")]
    df = spark.createDataFrame(cases, "p double, strong boolean, want string")
    assert df.filter(D.route(F.col("p"), F.col("strong"))["route"] != F.col("want")).count() == 0
    fused = [
        (0.95, None, None, 60.0, 95.0, True, True, "Known-like"), (0.95, 0.9, 0.9, None, None, False, False, "Novel_candidate"),
        (0.95, 0.7, 0.7, 25.0, 60.0, True, False, "Remote"), (0.1, None, None, None, None, False, False, "Negative"), (0.1, None, None, 50.0, 90.0, True, True, "Uncertain"),
    ]
    df = spark.createDataFrame(fused, "p double, a double, b double, i double, c double, hit boolean, strong boolean, want string")
    got = df.withColumn("f", D.fuse(*[F.col(x) for x in ("p", "a", "b", "i", "c", "hit", "strong")])).select("want", "f.*").collect()
    assert [(r.want, r.final_category) for r in got[:4]] == [(w[-1], w[-1]) for w in fused[:4]]
    assert all(0 <= r.transposase_score <= 1 and 0 <= r.novelty_score <= 1 for r in got)


def test_composite_of_a_complete_element(spark):
    s = D.element_scores(F.lit("IS3"), F.lit(1300), F.lit(1000), F.lit(0.95), F.lit(25), F.lit(0.96), F.lit(10.0), F.lit(None).cast("double"), F.lit(True))
    row = one(spark, s=s).s
    assert row.status == "complete" and row.composite_score >= 0.70
    s = D.element_scores(F.lit("IS110"), F.lit(1400), F.lit(1200), F.lit(0.9), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(22.0), F.lit(True))
    assert one(spark, s=s).s.status == "complete"


def test_exact_groups(spark):
    rows = spark.createDataFrame([("t1", "A", "IS3", "MKV"), ("t2", "B", "IS5", "mkv"), ("t3", "C", "IS3", "MLL")], "id string, name string, family string, seq string")
    got = {r.id: r for r in datasets.exact_groups(rows, S.normalised_sha256(F.col("seq")), "family", [F.length("name")], "id").collect()}
    assert got["t1"].representative == "t1" == got["t2"].representative and got["t1"].annotation_conflict and not got["t3"].annotation_conflict
    assert sum(r.is_representative for r in got.values()) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    edges += [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100 == got[101] and all(got[k] == 200 for k in range(201, 260)) and 7 in got and 200 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))


def test_splits_keep_clusters_together(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("c"), F.col("id") % 37).alias("cluster"), (F.col("id") % 5).cast("string").alias("family"))
    split = datasets.cluster_split(rows, "cluster", "family")
    assert split.count() == 300 and split.groupBy("cluster").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    a, b = split.filter("split = 'train'"), split.filter("split = 'test'")
    assert datasets.shared_values(a, b, "cluster").first().shared == 0 and a.count() > 150
    again = datasets.cluster_split(rows.repartition(7), "cluster", "family")
    assert sorted(again.collect()) == sorted(split.collect())


def one_by_one(clusters, ratios, seed="42"):
    """{cluster: [(stratum, n)]} dealt one cluster at a time: how many of each signature every split took, in order of the splits."""
    md5 = lambda *x: hashlib.md5(":".join(x).encode()).hexdigest()
    text = {c: ",".join(f"{s}:{n}" for s, n in sorted(m)) for c, m in clusters.items()}
    size = {c: sum(n for _, n in m) for c, m in clusters.items()}
    total = Counter()
    for m in clusters.values():
        total.update(dict(m))
    filled, held, takes = [0] * len(ratios), [Counter() for _ in ratios], {}
    for c in sorted(clusters, key=lambda c: (-size[c], md5(seed, text[c]), text[c])):
        costs = []
        for i, r in enumerate(ratios):
            over = sum(n * max(0.0, (held[i][s] - r * total[s]) / (r * total[s] + 1)) for s, n in sorted(clusters[c]))
            costs.append((filled[i] + size[c]) / (r * sum(size.values()) + 1e-5) + 0.5 * over)
        best = costs.index(min(costs))
        filled[best] += size[c]
        held[best].update(dict(clusters[c]))
        takes.setdefault(text[c], [0] * len(ratios))[best] += 1
    return takes, text


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_dealt_as_one_by_one(seed):
    rng = random.Random(seed)
    kinds = [[(s, rng.randrange(1, 4)) for s in rng.sample("abcd", rng.randrange(1, 4))] for _ in range(rng.randrange(1, 9))]
    clusters = {f"c{i}": sorted(rng.choice(kinds)) for i in range(rng.randrange(1, 400))}
    ratios = rng.choice([(0.7, 0.15, 0.15), (0.5, 0.5), (0.8, 0.1, 0.1)])
    want, text = one_by_one(clusters, ratios)
    total, run = Counter(), Counter(text.values())
    for m in clusters.values():
        total.update(dict(m))
    loads = datasets.SplitLoads(ratios, sum(total.values()), dict(total))
    members = {text[c]: m for c, m in clusters.items()}
    order = sorted(run, key=lambda t: (-sum(n for _, n in members[t]), hashlib.md5(f"42:{t}".encode()).hexdigest(), t))
    assert {t: loads.deal(run[t], sum(n for _, n in members[t]), members[t]) for t in order} == want


def test_a_run_of_a_hundred_million_clusters():
    loads = datasets.SplitLoads((0.7, 0.15, 0.15), 10**8, {"a": 10**8})
    takes = loads.deal(10**8, 1, [("a", 1)])
    assert sum(takes) == 10**8 and abs(takes[0] - 7 * 10**7) < 10


def test_cluster_split_is_the_loop_s(spark):
    rng = random.Random(5)
    rows = [(i, f"c{rng.randrange(150)}", rng.choice(["x", "y", None])) for i in range(400)]
    clusters = {}
    for _, c, s in rows:
        clusters.setdefault(c, Counter())[s or ""] += 1
    want, text = one_by_one({c: sorted(m.items()) for c, m in clusters.items()}, (0.7, 0.15, 0.15))
    got = {}
    split = datasets.cluster_split(spark.createDataFrame(rows, "id long, cluster string, kind string"), "cluster", "kind")
    found = {(r.cluster, r.split) for r in split.collect()}
    assert len(found) == len(clusters)
    for c, s in found:
        got.setdefault(text[c], [0, 0, 0])[datasets.SPLITS.index(s)] += 1
    assert got == want


def test_splitting_no_rows(spark):
    assert datasets.cluster_split(spark.createDataFrame([], "id long, cluster string, kind string"), "cluster", "kind").count() == 0


def test_negatives(spark):
    pool = spark.range(130).select(F.col("id"), F.when(F.col("id") < 50, "hard").when(F.col("id") < 80, "easy").otherwise("general").alias("kind"), (100 + F.col("id") * 3).alias("n"))
    positives = spark.range(40).select((300 + F.col("id") * 5).alias("n"))
    got = datasets.sample_negatives(pool, positives, 20, "id", "kind", "n")
    counts = {r.negative_type: r["count"] for r in got.groupBy("negative_type").count().collect()}
    assert counts["hard"] == 10 and counts["easy"] == 4 and counts["length_matched"] == 6 and got.select("id").distinct().count() == got.count()


def test_numbers_are_dense_whatever_the_partitions(spark):
    rows = spark.range(57).repartition(9).select((F.col("id") * 7 % 57).alias("k"))
    got = datasets.numbered(rows, [F.col("k")], "x_%06d", "name").orderBy("k").collect()
    assert [r.name for r in got] == [f"x_{i:06d}" for i in range(1, 58)]


def test_thresholds_and_areas(spark):
    rows = spark.createDataFrame([(1, s) for s in (10.0, 9.0, 8.0, 7.0, 6.0)] + [(0, s) for s in (5.0, 4.0, 3.0, 2.0, 1.0)], "y int, s double")
    best = metrics.fdr_threshold(rows, "y", "s", 0.05).first()
    assert (best.threshold, best.recall, best.fdr) == (6.0, 1.0, 0.0)
    assert metrics.auroc(rows, "y", "s").first()[0] == 1.0 and metrics.average_precision(rows, "y", "s").first()[0] == 1.0 and metrics.pr_auc(rows, "y", "s").first()[0] == pytest.approx(1.0)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.auroc(ties, "y", "s").first()[0] == 0.5
    four = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.1)], "y int, s double")
    c = metrics.confusion(four, "y", "s", F.lit(0.75)).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.mcc) == (2, 0, 2, 0, 1.0)
    none = metrics.fdr_threshold(spark.createDataFrame([(0, 1.0)], "y int, s double"), "y", "s", 0.05).first()
    assert none.threshold == float("inf") and none.recall == 0.0


def test_bootstrap_is_repeatable(spark):
    rows = spark.range(60).select(F.lit(1).alias("y"), (F.col("id") % 6).alias("u"), (F.col("id") % 3 != 0).alias("hit"))
    a = metrics.bootstrap_recall(rows, "y", "u", F.col("hit"), 50, "s").first()
    b = metrics.bootstrap_recall(rows.repartition(5), "y", "u", F.col("hit"), 50, "s").first()
    assert a == b and a.low <= a.mean <= a.high


HITS = "query string, target string, fident double, alnlen int, qcov double, tcov double, evalue double, bits double"


def test_homology_classes(spark):
    rows = [("e", "t", 1.0, 90, 1.0, 1.0, 0.0, 300.0), ("c", "t", 0.6, 90, 0.9, 0.9, 0.0, 200.0), ("d", "t", 0.5, 30, 0.3, 0.3, 0.0, 50.0), ("r2", "t", 0.15, 90, 0.9, 0.9, 0.0, 40.0), ("r3", "t", 0.25, 90, 0.9, 0.9, 0.0, 45.0)]
    h = spark.createDataFrame(rows, HITS).withColumn("line_no", F.lit(1))
    q = spark.createDataFrame([(x,) for x in ("e", "c", "d", "r2", "r3", "o")], "seq_id string")
    got = {r.seq_id: r.homology_class for r in hits.homology_classes(q, h).collect()}
    assert got == {"e": "L1_EXACT", "c": "L2_CLOSE", "d": "L3_DOMAIN_ONLY", "r2": "REMOTE_20_STRICT", "r3": "REMOTE_30_STRICT", "o": "NO_FULL_LENGTH_HOMOLOG"}
    p = {r.seq_id: r for r in hits.predictions(q, h).collect()}
    assert p["o"].score == 0.0 and p["o"].target_id == "None" and p["o"].evalue == 999.0 and p["e"].score == 300.0


def test_two_best_hits(spark):
    rows = [("q", "high_id", 0.28, 90, 0.9, 0.9, 0.0, 100.0), ("q", "high_bits", 0.25, 90, 0.9, 0.9, 0.0, 150.0)]
    h = spark.createDataFrame(rows, HITS).withColumn("line_no", F.monotonically_increasing_id())
    r = hits.homology_classes(spark.createDataFrame([("q",)], "seq_id string"), h).first()
    assert (r.max_identity, r.identity_target, r.bits_identity, r.bits_target) == (0.28, "high_id", 0.25, "high_bits")
    s = hits.leakage_summary(h).first()
    assert s.violations == 0 and s.passed


def test_islands_and_overlaps(spark):
    genes = spark.createDataFrame(
        [("c", "g1", 0, 300, "A", 50.0, 1e-5), ("c", "g2", 400, 700, "A", 80.0, 1e-9), ("c", "g3", 800, 900, "B", 10.0, 1.0), ("c", "g4", 1300, 1500, "B", 20.0, 0.1)],
        "contig string, gene string, start int, end int, family string, bits double, ev double",
    )
    i = intervals.islands(genes, "contig", "start", "end", "family", 250)
    r = {x.island: x for x in intervals.reduce_islands(i, "contig", "start", "end", "gene", "bits", "ev", ("family",)).collect()}
    assert len(r) == 3 and (r[1].start, r[1].end, r[1].primary_gene, r[1].n_genes) == (0, 700, "g2", 2)
    e = spark.createDataFrame([("c", 0, 100, 0.5, "a"), ("c", 10, 90, 0.9, "b"), ("c", 85, 300, 0.1, "d"), ("k", 0, 10, 0.2, "z")], "contig string, s int, e int, v double, k string")
    kept = {(x.contig, x.key) for x in intervals.resolve_overlaps(e, "contig", "s", "e", "v", "k").collect()}
    assert kept == {("c", "b"), ("c", "d"), ("k", "z")}


def test_overlap_matches(spark):
    p = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 500, 600), (3, "d", 0, 100)], "id int, contig string, start int, end int")
    t = spark.createDataFrame([(9, "c", 20, 120), (8, "c", 0, 60), (7, "d", 90, 400)], "id int, contig string, start int, end int")
    got = [tuple(r) for r in intervals.overlap_matches(p, t, 50).collect()]
    assert got == [(1, 9, 0.8)]


def test_linear_and_logistic(spark):
    v = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "id int, v array<double>")
    got = [r.p for r in v.orderBy("id").select(learning.linear_score(F.col("v"), [0, 0], [1, 0], [3.0, 1.0], -3.0).alias("p")).collect()]
    assert got[0] > 0.9 > 0.1 > got[1]
    rows = spark.range(200).select(F.array((F.col("id") / 200), F.lit(1.0) - F.col("id") % 7 / 7).alias("v"), (F.col("id") >= 100).cast("int").alias("y"))
    (w, b), (mean, scale) = learning.fit_logistic(rows, "v", "y")
    ok = rows.filter((learning.linear_score(F.col("v"), mean, scale, w, b) >= 0.5) == (F.col("y") == 1)).count()
    assert ok >= 190
    with pytest.raises(Exception, match="expected 2"):
        spark.range(1).select(learning.linear_score(F.array(F.lit(1.0)), [0, 0], [1, 1], [1.0, 1.0], 0.0)).collect()


def test_protein_qc(spark):
    rows = [("a", "maxaa*"), ("b", "MC*CC"), ("d", "MA1"), ("e", "M" * 60), ("e", "M" * 61), ("n", None)]
    ok, bad = screening.protein_qc(spark.createDataFrame(rows, "protein_id string, sequence string"), 3, 100)
    assert {r.protein_id: (r.sequence, r.qc_status) for r in ok.collect()} == {"a": ("MAXAA", "stop_symbol_normalized"), "b": ("MCXCC", "stop_symbol_normalized")}
    assert {r.protein_id for r in bad.collect()} == {"d", "e", "n"}


def test_closed_loop(spark):
    e = spark.createDataFrame([("E1", "g1", "complete", 0.8, 120.0), ("E2", "g2", "partial", 0.5, 0.4), ("E3", "g9", "complete", 0.7, 150.0)], "element_id string, tpase_gene_id string, status string, composite_score double, tpase_score double")
    p = spark.createDataFrame([("E1_tpase", "Remote", 0.9), ("xx_g2_yy", "Known-like", 0.8)], "protein_id string, final_category string, transposase_score double")
    got = {r.element_id: r for r in screening.closed_loop(e, p).collect()}
    assert got["E1"].dual_category == "High_Confidence_Novel_IS" and got["E1"].dual_confidence == pytest.approx(0.85)
    assert got["E2"].protein_category == "Known-like" and got["E2"].dual_category == "Standard_IS" and got["E3"].dual_category == "Confirmed_Standard_IS"


def test_reading_frames():
    dna = "CC" + "ATG" + "AAA" * 40 + "TAA" + "CC"
    found = [f for f in scan.reading_frames(dna) if f[2] == "+" and not f[3] and not f[4]]
    assert found and found[0][:2] == (2, 128) and found[0][5] == "M" + "K" * 40
    assert G.translate("ATGTGGTAAN") == "MW*"


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACGT" * 50), ("b", "GG")], "id string, seq string")
    fasta.write_fasta(rows.coalesce(1), str(tmp_path / "x"), "id", "seq", width=80)
    back = {r.id: r.sequence for r in fasta.read_fasta(spark, str(tmp_path / "x")).collect()}
    assert back == {"a": "ACGT" * 50, "b": "GG"}
    with pytest.raises(Exception, match="(?i)exist"):
        fasta.write_fasta(rows, str(tmp_path / "x"), "id", "seq")
    h = one(spark, p=fasta.protein_header(F.lit("x//IS1~~~orf1~~~Transposase~~~")), d=fasta.dna_header(F.lit("IS1_IS3_unknown")), u=fasta.uniprot_header(F.lit("sp|P1|X_Y Some protein OS=Escherichia coli OX=562 GN=abc PE=1")))
    assert tuple(h.p) == ("IS1", "orf1", "Transposase") and tuple(h.d) == ("IS1", "IS3", None) and tuple(h.u) == ("P1", "X_Y", "Some protein", "Escherichia coli", "562", "abc")


def test_hit_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q1\tt1\t0.9\t100\t0.9\t0.9\t1e-9\t300.0\nbad line\n")
    assert [r.bits for r in tables.read_hits(spark, str(tmp_path / "h.tsv")).collect()] == [300.0]
    (tmp_path / "p.tbl").write_text("# head\nq1 - IS3 - 1e-20 180.5 0.1 1e-19 170.0 0.1 1 1 0 0 1 1 1 1 desc\n")
    r = tables.read_profile_hits(spark, str(tmp_path / "p.tbl"), strict=True).first()
    assert (r.query, r.profile, r.bits, r.domain_bits) == ("q1", "IS3", 180.5, 170.0)


def test_feature_table_and_gff(spark):
    text = ["100\t50\tmobile_element", "\t\t\tmobile_element_type\tinsertion sequence:IS1", "10\t20\tgene", "\t\t\tgene\tabc"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "source string, pos int, value string")
    assert [(r.start, r.end, r.strand) for r in tables.feature_table(lines).collect()] == [(49, 100, "-")]
    e = spark.createDataFrame([("E1", "c1", 100, 1450, "+", "IS3", "complete", 0.8, 20, "CTAG", None)], "element_id string, contig_id string, start int, end int, strand string, family string, status string, composite_score double, tir_length int, tsd_sequence string, structure_type string")
    body = [r.value for r in tables.gff3_lines(e).orderBy("start").collect()]
    assert body[0] == "##gff-version 3" and "\t101\t1450\t" in body[1] and "TIR_len=20" in body[1]
    assert '"status": {"complete": 1, "pseudo": 0}' in tables.summary_json(e, {"status": ("status", ["complete", "pseudo"])})


def test_scan_of_a_planted_element(spark):
    import random

    from mobilome.functions import boundary_kernels as K

    rng = random.Random(11)
    r = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    arm = r(24)
    orf = "ATG" + "".join(rng.choice(("GCT", "AAA", "GAT", "CTG")) for _ in range(300)) + "TAA"
    element = arm + r(60) + orf + r(60) + K.reverse_complement(arm)
    site = "CTAGG"
    contig = r(700) + site + element + site + r(700)
    c = spark.createDataFrame([("c1", contig)], "contig_id string, sequence string")
    genes = scan.find_genes(c)
    h = genes.filter(F.length("protein") >= 300).select("gene_id", F.lit("IS3").alias("family"), F.lit(200.0).alias("bits"), F.lit(1e-30).alias("evalue"))
    found = scan.annotate(c, genes, h).collect()
    assert len(found) == 1 and abs(found[0].start - 705) <= 6 and abs(found[0].end - (705 + len(element))) <= 6 and found[0].status == "complete"
    edge = scan.annotate(c, genes, h, primary="first", edges=True).first()
    assert edge.truncation == "complete"


def test_stream_equals_batch(spark):
    from mobilome.plans import bindings

    d = "/root/testdata/sf0.001"
    assert sorted(bindings.stream_event_islands(spark, d).collect()) == sorted(bindings.event_islands(spark, d).collect())


def whole_texts():
    """Copies, near copies edited at both ends, shared openings only, short copies, and awkward rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    opening, out = " ".join(word() for _ in range(20)), []
    for _ in range(12):
        body = [word() for _ in range(rng.randrange(40, 90))]
        out += [" ".join(body), " ".join([word(), *body[1:-1], word()]), " ".join([*body[:20], word(), *body[21:]])]
        out.append(" ".join(body[: len(body) * 8 // 10]))
        out.append(opening + " " + " ".join(word() for _ in range(60)))
    return [*out, "Short one", "short  ONE", "short two", "", None, " ", out[0]]


def test_similar_text_edges_by_brute_force(spark):
    found = whole_texts()
    own = []
    for t in found:
        w = (t or "").lower().split()
        own.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    want = list(range(len(found)))
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or len(a & b) >= 0.8 * max(len(a), len(b)):
                want = [want[j] if x == want[i] else x for x in want] if want[j] < want[i] else [want[i] if x == want[j] else x for x in want]
    docs = spark.createDataFrame([*enumerate(found), (None, found[0])], "id long, text string").repartition(3)
    got = {r.node: r.component for r in connected_components(similarity.similar_text_edges(docs)).collect()}
    assert [got.get(i, i) for i in range(len(found))] == want and len(set(want)) < len(want) - 20


def test_clusters_read_whole_texts(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(100))
    rows = [(1, f"first {body} last"), (2, f"other {body} end"), (3, "w0 " * 20 + " ".join(f"a{i}" for i in range(80))), (4, "w0 " * 20 + " ".join(f"b{i}" for i in range(80))), (5, "tiny"), (6, "tiny")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cluster = {r.doc_id: r.cluster_id for r in bindings.cluster_split(spark, str(tmp_path)).collect()}
    assert cluster[1] == cluster[2] and cluster[5] == cluster[6] and len(set(cluster.values())) == 4
    assert sorted(r.size for r in bindings.family_purity(spark, str(tmp_path)).collect()) == [1, 1, 2, 2]
