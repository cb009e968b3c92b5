"""Commands over files: ``python -m mobilome.cli <command> --help``.

Every command reads tables, runs the operators, and writes tables to a destination that must not exist.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome.functions import sequence as S
from mobilome.operators import alignment, datasets, evaluation, external, filters, fragments, intervals, learning, metrics, models, multiple, profiles, scan, screening
from mobilome.operators import genes as gene_models
from mobilome.operators import hits as H
from mobilome.operators.boundaries import predict_boundaries
from mobilome.sources import artifacts, fasta, tables
from mobilome.storage import materialize

VERSION = "0.2.0"
COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(name: str, *options: tuple[str, dict]):
    """Register a command; options are (flag, argparse keywords), and those without a default must be given."""

    def add(f):
        COMMANDS[name] = (f, list(options))
        return f

    return add


def _opt(flag: str, default=None, kind=str, help: str = "") -> tuple[str, dict]:
    return flag, {"type": kind, "help": help, **({"required": True} if default is None else {"default": default})}


OUT = _opt("--out", help="destination folder, which must not exist")


def _write(frame: DataFrame, out: str) -> None:
    with artifacts.fresh(frame.sparkSession, out):
        frame.write.parquet(out)


def _proteins(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    good, _ = screening.protein_qc(fasta.read_fasta(spark, path).select(F.col("id").alias("protein_id"), "sequence"), least, most)
    return good


# --- data sets


@command("normalize", _opt("--proteins"), _opt("--elements"), _opt("--metadata"), OUT)
def normalize(spark, a):
    """Proteins and elements with cleaned metadata, deterministic ids and digests: <out>/tpases and <out>/is_elements."""
    meta = tables.read_metadata(spark, a.metadata).select(F.col("Name").alias("_n"), F.col("Family").alias("meta_family"), F.col("Group").alias("meta_group"))
    p = fasta.read_fasta(spark, a.proteins).withColumn("h", fasta.protein_header(F.col("description"))).filter(filters.has_role(F.col("h.role")))
    p = p.join(meta, F.col("h.name") == F.col("_n"), "left").select(
        F.col("h.name").alias("is_name"), filters.enriched_family(F.col("meta_family")).alias("family"), F.col("meta_group").alias("group"), F.col("sequence").alias("protein_sequence"),
        F.length("sequence").alias("protein_length"), S.normalised_sha256(F.col("sequence")).alias("protein_sha256"),
    )
    e = fasta.read_fasta(spark, a.elements).withColumn("h", fasta.dna_header(F.col("id")))
    e = e.join(meta, F.col("h.name") == F.col("_n"), "left").select(
        F.col("h.name").alias("is_name"), filters.enriched_family(F.col("meta_family"), F.col("h.family")).alias("family"), F.coalesce("meta_group", "h.group").alias("group"),
        F.col("sequence").alias("dna_sequence"), F.length("sequence").alias("dna_length"), S.normalised_sha256(F.col("sequence")).alias("dna_sha256"),
    )
    with artifacts.fresh(spark, a.out):
        for rows, name, prefix, key in ((p, "tpases", "tpase", "protein_sha256"), (e, "is_elements", "is", "dna_sha256")):
            datasets.numbered(rows, [F.col("is_name"), F.col(key)], f"{prefix}_%06d", f"{prefix}_id").write.parquet(f"{a.out}/{name}")


@command("deduplicate", _opt("--input"), _opt("--key", "protein_sha256"), _opt("--id", "tpase_id"), _opt("--family", "family"), OUT)
def deduplicate(spark, a):
    """One representative of equal sequences, with the size of its group and whether families disagree."""
    g = datasets.exact_groups(spark.read.parquet(a.input), F.col(a.key), a.family, [], a.id)
    _write(g.filter("is_representative").drop("is_representative", "representative"), a.out)


@command("cluster", _opt("--input"), _opt("--hits", "", help="hits of all against all; without them the sequences are searched here"), _opt("--sequence", "protein_sequence"), _opt("--id", "tpase_id"), _opt("--length", "protein_length"), _opt("--scheme", "A"), OUT)
def cluster(spark, a):
    """Clusters of sequences by the hits of a scheme: connected for A, B and C, greedy for D and E."""
    rows = spark.read.parquet(a.input)
    hits = tables.read_hits(spark, a.hits) if a.hits else materialize(alignment.search(rows, rows, a.id, a.sequence), "hits")
    edges = H.scheme_edges(hits).filter(F.col("scheme") == a.scheme)
    edges = edges.select(F.col("query").alias("src"), F.col("target").alias("dst"))
    if a.scheme in ("D", "E"):
        place = datasets.ranked(rows.select(a.id, a.length), [F.col(a.length).desc(), F.col(a.id)], "_p")
        names = place.select(F.col(a.id).alias("_i"), "_p")
        e = edges.join(names, F.col("src") == F.col("_i")).select(F.col("_p").alias("s"), "dst").join(names, F.col("dst") == F.col("_i")).select(F.col("s").alias("src"), F.col("_p").alias("dst"))
        own = H.greedy_clusters(place.select("_p"), e, "_p", []).join(place.select(F.col("_p").alias("representative"), F.col(a.id).alias("cluster_id")), "representative").select("_p", "cluster_id")
        _write(place.join(own, "_p").drop("_p", a.length).join(rows, a.id), a.out)
    else:
        _write(datasets.cluster_table(rows, edges, a.id, a.length), a.out)


@command("split", _opt("--input"), _opt("--cluster", "cluster_id"), _opt("--stratum", "family"), OUT)
def split(spark, a):
    """Train, validation and test sets that divide no cluster, and a manifest of their counts."""
    rows = datasets.cluster_split(spark.read.parquet(a.input), a.cluster, a.stratum)
    with artifacts.fresh(spark, a.out):
        rows.write.partitionBy("split").parquet(f"{a.out}/splits")
        counts = spark.read.parquet(f"{a.out}/splits").groupBy("split").agg(F.count(F.lit(1)).alias("sequences"), F.count_distinct(a.cluster).alias("clusters"))
        artifacts.write_lines(artifacts.manifest_lines(counts, "split", ["sequences", "clusters"]), f"{a.out}/manifest.yaml")


@command("audit", _opt("--hits"), _opt("--rule", "either"))
def audit(spark, a):
    """Leakage between splits by a rule over the hits of one against the other; violations are an error."""
    found = H.leakage_summary(tables.read_hits(spark, a.hits), a.rule).first()
    print(found.asDict())
    if not found["passed"]:
        raise SystemExit(f"{found['violations']} hits violate the rule {a.rule}")


@command("build-negatives", _opt("--proteins"), _opt("--positives"), _opt("--ratio", 3.0, float), OUT)
def build_negatives(spark, a):
    """Hard, length-matched and easy negatives from a protein library in FASTA, as many as ``--ratio`` times the positives."""
    raw = fasta.read_fasta(spark, a.proteins).withColumn("h", fasta.uniprot_header(F.col("description")))
    pool = filters.negative_pools(raw.select(F.col("h.accession").alias("accession"), F.col("h.description").alias("description"), F.col("h.organism").alias("organism"), "sequence"), "description", "organism", "sequence")
    pool = pool.withColumn("length", F.length("sequence"))
    positives = spark.read.parquet(a.positives).select(F.col("protein_length").alias("length"))
    picked = datasets.sample_negatives(pool, positives, int(a.ratio * positives.count()), "accession", "pool", "length")
    _write(datasets.numbered(picked, [F.col("negative_type"), F.col("accession")], "neg_%06d", "negative_id"), a.out)


@command("summary", _opt("--input"), _opt("--cluster", "cluster_id"), _opt("--family", "family"), OUT)
def summary(spark, a):
    """A Markdown table of the largest families: members and clusters."""
    t = H.family_clusters(spark.read.parquet(a.input), a.family, a.cluster)
    with artifacts.fresh(spark, a.out):
        artifacts.write_lines(artifacts.markdown_lines(t, [a.family, "members", "clusters"], [F.col("members").desc(), F.col(a.family)], 25), a.out)


@command("prepare-eval", _opt("--positives"), _opt("--negatives"), _opt("--identities"), OUT)
def prepare_eval(spark, a):
    """Positives and negatives of one split as one table, with the largest identity to the training set."""
    p = spark.read.parquet(a.positives).select(F.col("tpase_id").alias("seq_id"), "protein_sequence", "family", F.lit(1).alias("label"))
    n = spark.read.parquet(a.negatives).select(F.col("negative_id").alias("seq_id"), F.col("sequence").alias("protein_sequence"), F.lit("None").alias("family"), F.lit(0).alias("label"))
    best = H.nearest_identity(tables.read_hits(spark, a.identities)).select(F.col("query").alias("_q"), F.col("max_identity").alias("max_train_identity"))
    _write(p.unionByName(n).join(best, F.col("seq_id") == F.col("_q"), "left").drop("_q"), a.out)


# --- baselines


def _baseline(spark, a, runner, schema: str, adapt: Callable[[DataFrame], DataFrame]) -> None:
    q = spark.read.parquet(a.input)
    found = adapt(external.search(q, "seq_id", "protein_sequence", runner, schema))
    _write(H.predictions(q, found.withColumn("line_no", F.lit(0))), a.out)


@command("bench-blast", _opt("--input"), _opt("--database"), _opt("--program", "blastp"), OUT)
def bench_blast(spark, a):
    """Best hits of a protein search as predictions."""
    _baseline(spark, a, external.blast_runner(a.database, a.program), external.BLAST, lambda h: h.select("query", "target", (F.col("pident") / 100).alias("fident"), (F.col("qcovs") / 100).alias("qcov"), "evalue", "bits"))


@command("bench-mmseqs", _opt("--input"), _opt("--database"), _opt("--program", "mmseqs"), OUT)
def bench_mmseqs(spark, a):
    """Best hits of a sequence search as predictions."""
    _baseline(spark, a, external.similarity_runner(a.database, a.program), external.HITS, lambda h: h)


@command("bench-hmmer", _opt("--input"), _opt("--database"), _opt("--program", "hmmsearch"), OUT)
def bench_hmmer(spark, a):
    """Best profile hits as predictions; profiles have no identity."""
    _baseline(spark, a, external.profile_runner(a.database, a.program), external.PROFILE_HITS, lambda h: h.select("query", F.col("profile").alias("target"), F.lit(0.0).alias("fident"), F.lit(0.0).alias("qcov"), "evalue", "bits"))


@command("search", _opt("--queries"), _opt("--targets"), _opt("--id", "tpase_id"), _opt("--sequence", "protein_sequence"), _opt("--expected", 1e-3, float), OUT)
def search(spark, a):
    """Hits of one set of sequences against another, by alignment, as the eight usual columns."""
    q, t = spark.read.parquet(a.queries), spark.read.parquet(a.targets)
    found = alignment.search(q, t, a.id, a.sequence, most_expected=a.expected)
    with artifacts.fresh(spark, a.out):
        tables.write_tsv(found.select("query", "target", "fident", "alnlen", "qcov", "tcov", "evalue", "bits"), a.out)


@command("build-profiles", _opt("--input"), _opt("--family", "family"), _opt("--id", "tpase_id"), _opt("--sequence", "protein_sequence"), _opt("--least", 3, int), _opt("--sub-identity", 0.0, float), OUT)
def build_profiles(spark, a):
    """Profile models of all families, or of the parts of families that are connected at an identity."""
    rows, family = spark.read.parquet(a.input), a.family
    if a.sub_identity:
        rows, family = profiles.sub_families(rows, a.family, a.id, a.sequence, a.sub_identity), "sub_family"
    _write(profiles.profile_models(rows, family, a.id, a.sequence, a.least), a.out)


@command("align-families", _opt("--input"), _opt("--family", "family"), _opt("--id", "tpase_id"), _opt("--sequence", "protein_sequence"), OUT)
def align_families(spark, a):
    """Alignments of all families, level by level."""
    _write(multiple.align_families(spark.read.parquet(a.input), a.family, a.id, a.sequence), a.out)


@command("bench-search", _opt("--input"), _opt("--train"), _opt("--id", "tpase_id"), OUT)
def bench_search(spark, a):
    """Best hits of the alignment search against the training sequences as predictions."""
    q = spark.read.parquet(a.input)
    train = spark.read.parquet(a.train).select(F.col(a.id).alias("id"), F.col("protein_sequence").alias("sequence"))
    hits = alignment.search(q.select(F.col("seq_id").alias("id"), F.col("protein_sequence").alias("sequence")), train, most_expected=10.0)
    _write(H.predictions(q, alignment.best_hits(hits).withColumn("line_no", F.lit(0))), a.out)


@command("bench-profiles", _opt("--input"), _opt("--profiles"), OUT)
def bench_profiles(spark, a):
    """Best family models as predictions; profiles have no identity."""
    q = spark.read.parquet(a.input)
    best = profiles.best_family(profiles.profile_search(q, spark.read.parquet(a.profiles), "seq_id", "protein_sequence"))
    none = F.lit(0.0)
    _write(H.predictions(q, best.select("query", F.col("family").alias("target"), none.alias("fident"), none.alias("qcov"), "evalue", "bits", F.lit(0).alias("line_no"))), a.out)


@command("bench-embeddings", _opt("--train"), _opt("--test"), _opt("--model", "linear"), OUT)
def bench_embeddings(spark, a):
    """Scores of test embeddings by a model fitted to training embeddings: linear, or one hidden layer."""
    train, test = spark.read.parquet(a.train), spark.read.parquet(a.test)
    if a.model == "linear":
        (w, b), (mean, scale) = learning.fit_logistic(train, "embedding", "label")
        _write(test.withColumn("score", learning.linear_score(F.col("embedding"), mean, scale, w, b)), a.out)
    else:
        _write(models.score_vectors(test, "embedding", models.fit_hidden_layer(train, "embedding", "label", "seq_id")), a.out)


@command("eval-detection", _opt("--validation"), _opt("--test"), OUT)
def eval_detection(spark, a):
    """Areas and recalls at fixed false discovery rates, overall and by stratum of homology."""
    v, t = spark.read.parquet(a.validation), spark.read.parquet(a.test)
    kind = F.col("homology_class") if "homology_class" in t.columns else F.lit(None).cast("string")
    identity = F.col("max_train_identity") if "max_train_identity" in t.columns else F.lit(None).cast("double")
    at = metrics.fdr_threshold(v, "label", "score", 0.05).first()["threshold"]
    s = metrics.strata(t, filters.homology_strata(identity, kind), "label")
    with artifacts.fresh(spark, a.out):
        tables.write_tsv(metrics.overall_metrics(v, t, "label", "score"), f"{a.out}/overall")
        tables.write_tsv(metrics.confusion(s, "label", "score", F.lit(float(at)), ("stratum",)), f"{a.out}/strata")


# --- boundaries


@command("build-boundary-benchmark", _opt("--elements"), _opt("--most", 400, int), OUT)
def build_boundary_benchmark(spark, a):
    """Elements in random flanks, at most ``--most`` of them spread over families."""
    from mobilome.functions.decisions import NON_CANONICAL

    chosen = filters.capped_by_family(spark.read.parquet(a.elements), "family", "is_name", a.most, NON_CANONICAL)
    _write(fragments.genomic_contexts(chosen), a.out)


@command("eval-boundaries", _opt("--contexts"), OUT)
def eval_boundaries(spark, a):
    """Accuracy of both boundary engines over known contexts, by family, and their comparison."""
    c = spark.read.parquet(a.contexts)
    keep = ("family", "true_start", "true_end", "annotated_tir_len", "annotated_tsd_len")
    with artifacts.fresh(spark, a.out):
        whole = {}
        for engine in ("plan_a", "plan_b"):
            p = predict_boundaries(c, "contig_sequence", "tpase_start", "tpase_end", "family", engine, keep).withColumns(
                {"has_tir": F.col("tir").isNotNull(), "true_tir": F.col("annotated_tir_len").isNotNull(), "has_tsd": F.col("tsd").isNotNull(), "true_tsd": F.col("annotated_tsd_len").isNotNull()}
            )
            artifacts.cached(spark, f"{a.out}/{engine}", lambda p=p: p)
            done = spark.read.parquet(f"{a.out}/{engine}")
            tables.write_tsv(evaluation.boundary_summary(done, ("family",)), f"{a.out}/{engine}_families")
            whole[engine] = evaluation.boundary_summary(done)
        tables.write_tsv(evaluation.compare_methods(whole["plan_a"], whole["plan_b"], ["exact", "within_3", "within_10", "mean_error", "tir_f1", "tsd_f1"]), f"{a.out}/comparison")


# --- scans


def _profile_hits(spark, models: str, genes: DataFrame) -> DataFrame:
    found = profiles.best_family(profiles.profile_search(genes, spark.read.parquet(models), "gene_id", "protein"))
    return materialize(found.select(F.col("query").alias("gene_id"), "family", "bits", "evalue"), "profile-hits")


def _scan(spark, a, edges: bool) -> None:
    c = fasta.read_fasta(spark, a.input).select(F.col("id").alias("contig_id"), "sequence").filter(F.length("sequence") >= a.min_length)
    genes = materialize(gene_models.predict_genes(c) if a.profiles else scan.find_genes(c), "genes")
    found = external.search(genes, "gene_id", "protein", external.profile_runner(a.database, a.program), external.PROFILE_HITS) if a.database else None
    hits_ = found.select(F.col("query").alias("gene_id"), S.strip_model_prefix(F.col("profile")).alias("family"), "bits", "evalue") if found is not None else _profile_hits(spark, a.profiles, genes) if a.profiles else tables.read_tsv(spark, a.hits, "gene_id string, family string, bits double, evalue double")
    elements = scan.annotate(c, genes, hits_, a.engine, "first" if edges else "best", a.min_bits, edges=edges)
    with artifacts.fresh(spark, a.out):
        elements.write.parquet(f"{a.out}/elements")
        done = spark.read.parquet(f"{a.out}/elements")
        tables.write_tsv(done, f"{a.out}/tsv")
        tables.write_gff3(done, f"{a.out}/gff3")
        tables.write_elements(done, c, f"{a.out}/fasta")
        artifacts.write_text(spark, tables.summary_json(done, {"status": ("status", ["complete", "partial", "pseudo"])}), f"{a.out}/summary")


SCAN = (
    _opt("--input"), _opt("--hits", "", help="profile hits as a table of gene_id, family, bits and evalue"), _opt("--database", "", help="profile library, searched on the executors"),
    _opt("--profiles", "", help="models of build-profiles; genes are found by a trained model then"), _opt("--program", "hmmsearch"), _opt("--engine", "plan_a"), _opt("--min-bits", 10.6, float), OUT,
)


@command("scan-genome", *SCAN, _opt("--min-length", 0, int))
def scan_genome(spark, a):
    """Elements of a genome."""
    _scan(spark, a, edges=False)


@command("scan-metagenome", *SCAN, _opt("--min-length", 500, int))
def scan_metagenome(spark, a):
    """Elements of a draft or a metagenome, classed by truncation at contig ends."""
    _scan(spark, a, edges=True)


@command("scan", *SCAN, _opt("--min-length", 500, int))
def scan_any(spark, a):
    """Elements of an input whose shape decides between genome and metagenome."""
    first = tables.in_file_order(fasta.raw_records(spark, a.input))
    _scan(spark, a, edges=filters.is_fragmented(fasta.records(first, F.col("r"), "line_no"), ["line_no"]))


def _matched(spark, a) -> DataFrame:
    p = spark.read.parquet(f"{a.scan}/elements").select(F.col("element_id").alias("id"), "contig_id", "start", "end")
    t = tables.read_feature_table(spark, a.truth).select(F.monotonically_increasing_id().alias("id"), F.col("source").alias("contig_id"), "start", "end")
    p = datasets.ranked(p, [F.col("contig_id"), F.col("start"), F.col("id")], "_p").drop("id").withColumnRenamed("_p", "id")
    only = t.select("contig_id").first()
    if only is not None and not a.by_contig:  # an annotation of one genome names a file, not a contig
        p, t = p.withColumn("contig_id", F.lit("genome")), t.withColumn("contig_id", F.lit("genome"))
    return evaluation.scan_summary(p, t, intervals.overlap_matches(p, t, 5_000, 0.4, "contig_id"))


@command("benchmark-genome", _opt("--scan"), _opt("--truth"), _opt("--by-contig", 0, int), OUT)
def benchmark_genome(spark, a):
    """A scan against an annotation."""
    out = _matched(spark, a)
    with artifacts.fresh(spark, a.out):
        tables.write_tsv(out, a.out)


@command("benchmark-metagenome", _opt("--scan"), _opt("--truth"), OUT)
def benchmark_metagenome(spark, a):
    """A scan of fragments against what they hold."""
    truth, found = spark.read.parquet(a.truth), spark.read.parquet(f"{a.scan}/elements")
    with artifacts.fresh(spark, a.out):
        tables.write_tsv(evaluation.fragment_summary(truth, found), f"{a.out}/summary")
        classes = ["complete", "edge_5p_truncated", "edge_3p_truncated", "edge_both_truncated", "internal_partial"]
        tables.write_tsv(evaluation.truncation_confusion(truth, found, classes), f"{a.out}/confusion")


# --- proteins

PROTEINS = (_opt("--input"), _opt("--embeddings", help="table of protein_id and embedding"), _opt("--classifier", help="arrays mean, scale, coef, intercept and threshold"), _opt("--min-length", 50, int), _opt("--max-length", 2000, int), OUT)


def _first_scores(spark, a) -> DataFrame:
    c = artifacts.read_arrays(spark, a.classifier)
    w = c["coef"].ravel()
    score = learning.linear_score(F.col("embedding"), c["mean"].tolist(), c["scale"].tolist(), w.tolist(), float(c["intercept"].ravel()[0]))
    e = spark.read.parquet(a.embeddings).select(F.col("protein_id").alias("_i"), "embedding")
    from mobilome.functions import decisions as D

    scored = _proteins(spark, a.input, a.min_length, a.max_length).join(e, F.col("protein_id") == F.col("_i")).withColumn("tpase_score", score).drop("_i", "embedding")
    return scored.withColumn("final_category", D.stage1_category(F.col("tpase_score"), F.lit(float(c["threshold"]))))


@command("screen-proteins", *PROTEINS)
def screen_proteins(spark, a):
    """First scores and categories of proteins."""
    _write(_first_scores(spark, a).withColumn("routing_stage", F.lit("stage1_sequence")), a.out)


HOMOLOGY = (_opt("--search", help="eight-column hits"), _opt("--profiles", help="profile table"))


def _with_evidence(spark, a) -> DataFrame:
    best = H.best_similarity(tables.read_hits(spark, a.search))
    p = tables.read_profile_hits(spark, a.profiles)
    p = p.groupBy("query").agg(F.max_by(F.struct("profile", "evalue", "bits"), F.struct("bits", -F.col("evalue"))).alias("b")).select("query", "b.*")
    return screening.attach_evidence(_first_scores(spark, a), best, p)


@command("screen-proteins-homology", *PROTEINS, *HOMOLOGY)
def screen_proteins_homology(spark, a):
    """First scores with the evidence of two searches, and the route that follows."""
    from mobilome.functions import decisions as D

    _write(_with_evidence(spark, a).withColumn("r", D.route(F.col("tpase_score"), F.col("strong"))).select("*", "r.*").drop("r"), a.out)


@command("screen-proteins-research", *PROTEINS, *HOMOLOGY)
def screen_proteins_research(spark, a):
    """All evidence fused, with structure scores where the route asks for them."""
    e = _with_evidence(spark, a).drop("final_category").withColumn("tokens", S.structure_tokens(F.col("sequence")))
    e = e.withColumn("x", S.structure_scores(F.col("sequence"), F.col("tokens"))).withColumn("pair", S.bimodal_score(F.col("sequence"), F.col("tokens")))
    _write(screening.screen(e, "tpase_score", F.col("x.score"), F.col("x.similarity"), F.col("pair")).drop("x", "pair", "tokens"), a.out)


@command("version")
def version(spark, a):
    """The version."""
    print(VERSION)


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mobilome")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for flag, how in options:
            p.add_argument(flag, **how)
    a = parser.parse_args(words)
    f = COMMANDS[a.command][0]
    f(spark if spark is not None or a.command == "version" else SparkSession.builder.appName("mobilome").getOrCreate(), a)


if __name__ == "__main__":
    main()
