"""Registered queries of alignment search, profile models and gene finding, with the SQL of what SQL can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.operators import alignment
from mobilome.plans.derived import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

HEX, HEX_RESIDUES = "0123456789abcdef", "ACDEFGHIKLMNPQRS"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _letters(text: Column) -> Column:
    """64 residues that follow from a text."""
    return F.translate(F.sha2(text, 256), HEX, HEX_RESIDUES)


def supplier_proteins(spark, d) -> DataFrame:
    """(id, family, sequence): a nation's two domains, of which each supplier replaces six residues and every second one lacks three, before residues of its own."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("family"))
    key, family = F.col("id").cast("string"), F.col("family").cast("string")
    own = _letters(F.concat(F.lit("own"), key))
    shared = F.concat(_letters(F.concat(F.lit("one"), family)), _letters(F.concat(F.lit("two"), family)))
    cut = F.when(F.col("id") % 2 == 0, 64).otherwise(61)
    sequence = F.concat(F.substring(shared, 1, 20), F.substring(own, 1, 6), F.substring(shared, 27, 34), F.substring(shared, cut, F.lit(128)), F.substring(own, 7, 20))
    return s.select("id", "family", sequence.alias("sequence"))


def _sql_letters(text: str) -> str:
    return f"translate(sha256({text}), '{HEX}', '{HEX_RESIDUES}')"


SQL_PROTEINS = f"""proteins AS (
  SELECT id, family, substring(shared, 1, 20) || substring(own, 1, 6) || substring(shared, 27, 34) || substring(shared, CASE WHEN id % 2 = 0 THEN 64 ELSE 61 END, 128) || substring(own, 7, 20) AS sequence
  FROM (SELECT s_suppkey AS id, s_nationkey AS family, {_sql_letters("'own' || s_suppkey")} AS own, {_sql_letters("'one' || s_nationkey")} || {_sql_letters("'two' || s_nationkey")} AS shared FROM supplier))"""


@query(f"""
WITH {SQL_PROTEINS}, w AS (SELECT id, CAST(i AS INT) - 1 AS pos, substring(sequence, i, 4) AS word FROM proteins, unnest(range(1, length(sequence) - 2)) AS t(i)),
v AS (SELECT * FROM w WHERE len(list_distinct(string_split(word, ''))) > 2),
m AS (SELECT a.id AS query, b.id AS target, b.pos - a.pos AS diagonal, a.pos AS q, unnest([floor(a.pos / 40) - 1, floor(a.pos / 40)]) AS stretch FROM v a JOIN v b USING (word) WHERE a.id < b.id)
SELECT query, target, diagonal, CAST(stretch AS BIGINT) AS stretch, min(q) AS q_first, max(q) AS q_last, count(DISTINCT q) AS hits FROM m GROUP BY ALL HAVING max(q) - min(q) >= 4""")
def seed_diagonals(spark, d):
    """Stretches of diagonals with two hits of equal words."""
    p = supplier_proteins(spark, d).select("id", "sequence")
    found = alignment.seed_diagonals(p, p, near=None, apart=F.col("query") < F.col("target"))
    return found.select("query", "target", "diagonal", F.col("stretch").cast("long").alias("stretch"), "q_first", "q_last", "hits")


@query(f"WITH {SQL_PROTEINS} SELECT id AS query, count(*) OVER (PARTITION BY family) AS hits, true AS own_family, 1.0::DOUBLE AS best_identity FROM proteins")
def protein_search(spark, d):
    """Every protein finds its family, and nothing else."""
    p = supplier_proteins(spark, d)
    hits = alignment.search(p, p, most_expected=1e-9)
    kind = p.select(F.col("id").alias("i"), "family")
    own = hits.join(kind.select(F.col("i").alias("query"), F.col("family").alias("qf")), "query").join(kind.select(F.col("i").alias("target"), F.col("family").alias("tf")), "target")
    return own.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.bool_and(F.col("qf") == F.col("tf")).alias("own_family"), F.max("fident").alias("best_identity"))


@query(f"WITH {SQL_PROTEINS} SELECT id, min(id) OVER (PARTITION BY family) AS component FROM proteins")
def protein_clusters(spark, d):
    """Clusters by alignment: identity above 0.3 and either coverage 0.8."""
    return alignment.alignment_clusters(supplier_proteins(spark, d), "id", "sequence")


#: One codon of each residue that the derived proteins have.
CODONS = dict(zip(HEX_RESIDUES, "GCT TGC GAT GAA TTC GGT CAT ATC AAA CTG ATG AAC CCG CAG CGT AGC".split()))
HEX_BASES = "ACGT" * 4


def _flank(text: Column) -> Column:
    """256 bases that follow from a text."""
    return F.translate(F.concat(*[F.sha2(F.concat(text, F.lit(str(i))), 256) for i in range(4)]), HEX, HEX_BASES)


def supplier_contigs(spark, d) -> DataFrame:
    """(contig_id, family, sequence): each supplier's protein as a gene between flanks of its own, on the other strand for every third."""
    from mobilome.functions.sequence import reverse_complement

    p = supplier_proteins(spark, d)
    known = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    gene = F.concat(F.lit("ATG"), F.array_join(F.transform(F.split("sequence", ""), lambda c: known[c]), ""), F.lit("TAA"))
    name = F.col("id").cast("string")
    sequence = F.concat(_flank(F.concat(F.lit("left"), name)), F.when(F.col("id") % 3 == 0, reverse_complement(gene)).otherwise(gene), _flank(F.concat(F.lit("right"), name)))
    return p.select(name.alias("contig_id"), F.col("family").cast("string").alias("family"), sequence.alias("sequence"))


@query(f"""
WITH {SQL_PROTEINS} SELECT CAST(id AS VARCHAR) AS contig_id, 256 AS gene_start, 256 + 3 * (length(sequence) + 2) AS gene_end, CASE WHEN id % 3 = 0 THEN '-' ELSE '+' END AS strand, true AS whole_end FROM proteins""")
def predicted_genes(spark, d):
    """The gene of every contig: its end is found exactly; where an earlier start scores better, the gene begins there."""
    from mobilome.operators import genes

    contigs = supplier_contigs(spark, d)
    found = genes.predict_genes(contigs)
    length = F.length("sequence") - 512
    planted = contigs.select("contig_id", (F.col("contig_id").cast("long") % 3 == 0).alias("back"), F.lit(256).alias("gene_start"), (256 + length).alias("gene_end"))
    met = found.join(planted, "contig_id").filter(F.when(F.col("back"), (F.col("strand") == "-") & (F.col("start") == 256)).otherwise((F.col("strand") == "+") & (F.col("end") == F.col("gene_end"))))
    reaches = F.when(F.col("back"), F.col("end") >= F.col("gene_end") - 30).otherwise(F.col("start") <= F.col("gene_start") + 30)
    return met.select("contig_id", "gene_start", "gene_end", "strand", reaches.alias("whole_end"))


@query(f"""
WITH {SQL_PROTEINS} SELECT CAST(id AS VARCHAR) AS query, CAST(family AS VARCHAR) AS family FROM proteins QUALIFY count(*) OVER (PARTITION BY family) >= 3""")
def profile_families(spark, d):
    """The family that the models of all families give each protein."""
    from mobilome.operators import profiles
    from mobilome.storage import materialize

    p = supplier_proteins(spark, d)
    models = materialize(profiles.profile_models(p, "family", "id", "sequence"), "models")
    return profiles.best_family(profiles.profile_search(p, models, "id", "sequence", 1e-6)).select("query", "family")


@query(f"""
WITH {SQL_PROTEINS} SELECT CAST(id AS VARCHAR) AS contig_id, CAST(family AS VARCHAR) AS family, count(*) OVER (PARTITION BY id) AS elements FROM proteins QUALIFY count(*) OVER (PARTITION BY family) >= 3""")
def scan_profiles(spark, d):
    """Contigs scanned from end to end: trained genes, family models, islands, boundaries, scores and overlap resolution."""
    from mobilome.operators import genes, profiles, scan
    from mobilome.storage import materialize

    contigs = supplier_contigs(spark, d).select("contig_id", "sequence")
    models = materialize(profiles.profile_models(supplier_proteins(spark, d), "family", "id", "sequence"), "models")
    found = materialize(genes.predict_genes(contigs), "genes")
    hits = profiles.best_family(profiles.profile_search(found, models, "gene_id", "protein", 1e-6)).select(F.col("query").alias("gene_id"), "family", "bits", "evalue")
    elements = scan.annotate(contigs, found, hits)
    return elements.groupBy("contig_id", "family").agg(F.count(F.lit(1)).alias("elements"))


@query(f"WITH {SQL_PROTEINS} SELECT family, count(*) AS proteins, 1 AS parts FROM proteins GROUP BY family")
def closed_split(spark, d):
    """A split that begins with single proteins and ends without alike ones apart: every family lies in one part."""
    from mobilome.operators import closure

    p = supplier_proteins(spark, d)
    found = closure.closed_split(p, "id", "sequence", "family", most_expected=1e-6)
    return found.groupBy(F.col("stratum").alias("family")).agg(F.count(F.lit(1)).alias("proteins"), F.count_distinct("split").cast("int").alias("parts"))


@query(f"WITH {SQL_PROTEINS} SELECT CAST(id AS VARCHAR) AS id, CAST(family AS VARCHAR) AS family, sequence AS letters, true AS one_width FROM proteins")
def family_alignments(spark, d):
    """Alignments of all families: every row spells its protein, and all rows of a family have one width."""
    from mobilome.operators import multiple

    aligned = multiple.align_families(supplier_proteins(spark, d), "family", "id", "sequence")
    widths = aligned.groupBy(F.col("family").alias("_f")).agg((F.min(F.length("aligned")) == F.max(F.length("aligned"))).alias("one_width"))
    met = aligned.join(widths, F.col("family") == F.col("_f"))
    return met.select("id", "family", F.regexp_replace("aligned", "-", "").alias("letters"), "one_width")
