"""Registered queries that write derived files to the shared folder and read them back: sources and sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.operators import filters, hits, screening, structures
from mobilome.plans.derived import SQL_DNA, SQL_HITS, SQL_INTERVALS, SQL_PROTEIN, dna, protein, table, texts
from mobilome.plans.derived import hits as derived_hits
from mobilome.plans.derived import intervals as event_intervals
from mobilome.sources import artifacts, fasta, tables
from mobilome.storage import materialize, shared_dir

#: Bytes of documents whose structures are on disk at once, unless that makes more portions than the second number.
PORTION_BYTES, MOST_PORTIONS = 16 << 20, 16

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _read_back(spark, records: DataFrame, gzip: bool) -> DataFrame:
    at = _place(spark, "fasta")
    if gzip:
        fasta.fasta_lines(records, "id", "seq").write.option("compression", "gzip").text(at)
    else:
        fasta.write_fasta(records, at, "id", "seq")
    found = fasta.read_fasta(spark, at)
    return found.select(F.col("id").try_cast("long").alias("doc_id"), F.length("sequence").alias("length"), F.sha2("sequence", 256).alias("sha256"))


_FASTA = f"SELECT doc_id, CAST(length(s) AS INT) AS length, sha256(s) AS sha256 FROM (SELECT doc_id, {SQL_DNA} AS s FROM documents)"


def _records(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), dna(F.col("text")).alias("seq"))


@query(_FASTA)
def fasta_round_trip(spark, d):
    return _read_back(spark, _records(spark, d), gzip=False)


@query(_FASTA)
def gzip_fasta_round_trip(spark, d):
    return _read_back(spark, _records(spark, d), gzip=True)


@query(f"""
WITH e AS (SELECT doc_id, upper({SQL_DNA}) AS s, source FROM documents), f AS (SELECT *, least(length(s), 5 + doc_id % 900) AS fin FROM e)
SELECT 'e' || doc_id AS element_id, 'e' || doc_id || ' c' || doc_id || ':' || 6 || '-' || fin || ' family=' || coalesce(source, 'none') || ' status=complete score=' || printf('%.4f', (doc_id % 97) / 97.0::DOUBLE) AS header,
  length(substr(s, 6, fin - 5)) AS n_bases, CAST(ceil(length(substr(s, 6, fin - 5)) / 80) AS BIGINT) AS n_lines, sha256(substr(s, 6, fin - 5)) AS sha256 FROM f WHERE fin > 5""")
def wrapped_fasta(spark, d):
    c = table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("contig_id"), F.upper(dna(F.col("text"))).alias("sequence"), "doc_id", "source")
    e = c.select(
        F.concat(F.lit("e"), F.col("doc_id")).alias("element_id"), "contig_id", F.lit(5).alias("start"), F.least(F.length("sequence"), (F.col("doc_id") % 900 + 5).cast("int")).alias("end"),
        F.coalesce("source", F.lit("none")).alias("family"), F.lit("complete").alias("status"), (F.col("doc_id") % 97 / 97.0).alias("composite_score"),
    )
    at = _place(spark, "elements")
    tables.write_elements(e.filter("end > 5"), c, at)
    raw = spark.read.text(at, lineSep="\n>").select(F.regexp_replace("value", r"^>", "").alias("v"))
    body = F.substr("v", F.length(F.substring_index("v", "\n", 1)) + 2)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(x) > 0)
    flat = F.array_join(lines, "")
    return raw.select(
        F.substring_index("v", " ", 1).alias("element_id"), F.substring_index("v", "\n", 1).alias("header"), F.length(flat).cast("long").alias("n_bases"),
        F.size(F.filter(lines, lambda x: F.length(x) <= 80)).cast("long").alias("n_lines"), F.sha2(flat, 256).alias("sha256"),
    )


def _hits_file(spark, d) -> str:
    """Hits in the order of their line numbers, with lines that no reader may take among them."""
    h = derived_hits(spark, d)
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query", "target", "fident")], F.lit("90"), *[F.col(c).cast("string") for c in ("qcov", "tcov", "evalue", "bits")])
    bad = h.filter(F.col("line_no") % 50 == 1).select((F.col("line_no") + 0.5).alias("at"), F.lit("x\ty\tnot a number\tz").alias("value"))
    at = _place(spark, "hits")
    h.select(F.col("line_no").cast("double").alias("at"), line.alias("value")).union(bad).orderBy("at").select("value").write.text(at)
    return at


@query(f"""
WITH {SQL_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, evalue, line_no) AS rn FROM hits)
SELECT CAST(query AS VARCHAR) AS query, CAST(target AS VARCHAR) AS target, round(fident, 6) AS fident, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov, round(evalue, 9) AS evalue, round(bits, 4) AS bits FROM o WHERE rn = 1""")
def hits_file(spark, d):
    best = hits.best_similarity(tables.read_hits(spark, _hits_file(spark, d)))
    return best.select("query", "target", *[F.round(c, 6).alias(c) for c in ("fident", "qcov", "tcov")], F.round("evalue", 9).alias("evalue"), F.round("bits", 4).alias("bits"))


@query(f"""
WITH {SQL_HITS}, o AS (SELECT *, max(fident) OVER (PARTITION BY query) AS m, row_number() OVER (PARTITION BY query ORDER BY fident DESC, line_no) AS rn FROM hits)
SELECT CAST(query AS VARCHAR) AS query, round(m, 6) AS max_identity, CAST(target AS VARCHAR) AS target FROM o WHERE rn = 1""")
def blast_file(spark, d):
    """The seven-column table, read as it was written; per query its largest identity."""
    h = derived_hits(spark, d)
    line = F.concat_ws("\t", F.col("query").cast("string"), F.col("target").cast("string"), (F.col("fident") * 100).cast("string"), F.lit("90"), (F.col("qcov") * 100).cast("string"), F.col("evalue").cast("string"), F.col("bits").cast("string"))
    at = _place(spark, "blast")
    h.select("line_no", line.alias("value")).orderBy("line_no").select("value").write.text(at)
    read = tables.read_blast(spark, at)
    return hits.nearest_identity(read.withColumn("fident", F.col("pident") / 100)).withColumn("max_identity", F.round("max_identity", 6))


@query("""
SELECT 'g' || p_partkey AS query, 'fam' || p_size AS profile, 1.0 / (p_partkey + 1) AS evalue, p_partkey % 300 + 0.5 AS bits, 0.25::DOUBLE AS domain_evalue, p_partkey % 7 + 0.25 AS domain_bits FROM part""")
def profile_table(spark, d):
    k = F.col("p_partkey")
    words = F.concat_ws(
        "   ", F.concat(F.lit("g"), k), F.lit("-"), F.concat(F.lit("fam"), F.col("p_size")), F.lit("PF1"), (F.lit(1.0) / (k + 1)).cast("string"), (k % 300 + 0.5).cast("string"), F.lit("0.0"), F.lit("0.25"),
        (k % 7 + 0.25).cast("string"), *[F.lit("1") for _ in range(9)], F.lit("a long description"),
    )
    at = _place(spark, "profiles")
    table(spark, d, "part").select(F.explode(F.array(words, F.lit("# a comment"), F.lit(""))).alias("value")).write.text(at)
    return tables.read_profile_hits(spark, at, strict=True)


@query("""
SELECT CAST(p_size AS VARCHAR) AS family, count(*) AS members, count(DISTINCT p_partkey % 40) AS clusters FROM part GROUP BY 1""")
def clusters_file(spark, d):
    """A representative and member table, written and read, joined with families: members and clusters by family."""
    at = _place(spark, "clusters")
    k = F.col("p_partkey")
    tables.write_lines_of(table(spark, d, "part").select((k % 40).cast("string").alias("representative"), k.cast("string").alias("member_id")), at)
    read = tables.read_clusters(spark, at)
    families = table(spark, d, "part").select(k.cast("string").alias("m"), F.col("p_size").cast("string").alias("family"))
    return hits.family_clusters(read.join(families, F.col("member_id") == F.col("m")), "family", "representative")


@query("""SELECT n_name AS name, n_regionkey AS region, n_nationkey * 1.5 AS score FROM nation""")
def tsv_file(spark, d):
    at = _place(spark, "tsv")
    tables.write_tsv(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") * 1.5).alias("score")), at)
    return tables.read_tsv(spark, at, "name string, region long, score double")


@query("""
WITH r AS (SELECT p_partkey AS k, ' IS' || (p_partkey % 300) || ' ' AS name, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE ' fam' || p_size END AS fam, ['NA', 'grp1', 'unknown', ' None', 'grp2'][1 + p_partkey % 5] AS grp,
  CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(p_partkey * 3 AS VARCHAR) END AS len FROM part),
l AS (SELECT *, row_number() OVER (PARTITION BY trim(name) ORDER BY k DESC) AS rn FROM r)
SELECT trim(name) AS "Name", coalesce(nullif(trim(fam), ''), 'Unknown') AS "Family", CASE WHEN trim(grp) NOT IN ('NA', '', 'None', 'unknown') THEN trim(grp) END AS "Group", TRY_CAST(len AS INT) AS "Length" FROM l WHERE rn = 1""")
def metadata_file(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k, F.concat(F.lit(" IS"), k % 300, F.lit(" ")).alias("Name"), F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" fam"), F.col("p_size"))).alias("Family"),
        F.element_at(F.array(*map(F.lit, ("NA", "grp1", "unknown", " None", "grp2"))), (k % 5 + 1).cast("int")).alias("Group"), F.when(k % 4 == 0, "n/a").otherwise((k * 3).cast("string")).alias("Length"),
    )
    at = _place(spark, "metadata")
    rows.orderBy("p_partkey").drop("p_partkey").write.csv(at, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_metadata(spark, at)


@query(f"""
WITH {SQL_INTERVALS}, k AS (SELECT *, event_id % 3 = 0 AS back FROM iv WHERE event_type IN ('click', 'view') AND event_id % 4 <> 3)
SELECT "start", "end", min(CASE WHEN back THEN '-' ELSE '+' END) AS strand, count(*) > 0 AS found FROM k GROUP BY "start", "end" """)
def feature_table(spark, d):
    """Annotation tables of opening and qualifier lines, one a range of places, so that no task orders them all; of equal places one counts."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = event_intervals(spark, d).filter("event_type IN ('click', 'view')")
    a, b = (F.col("start") + 1).cast("string"), F.col("end").cast("string")
    back = F.col("event_id") % 3 == 0
    opening = F.concat_ws("\t", F.when(back, b).otherwise(a), F.when(back, a).otherwise(b), F.lit("mobile_element"))
    kind = F.when(F.col("event_id") % 4 == 3, "transposon:x").otherwise("insertion sequence:y")
    lines = F.array(F.concat_ws("\t", F.lit("1"), F.lit("9999"), F.lit("gene")), F.lit("\t\t\tgene\tabc"), opening, F.concat(F.lit("\t\t\tmobile_element_type\t"), kind))
    at = _place(spark, "features")
    e.select("start", "end", back.alias("back"), "event_id", F.posexplode(lines).alias("i", "value")).repartitionByRange(width, "start", "end").sortWithinPartitions("start", "end", F.col("back").cast("int"), "event_id", "i").select("value").write.text(at)
    read = tables.read_feature_table(spark, at)
    return read.groupBy("start", "end").agg(F.min("strand").alias("strand"), (F.count(F.lit(1)) == 1).alias("found")).select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "found")


@query(f"""
WITH {SQL_INTERVALS} SELECT 'u' || user_id AS contig_id, event_type AS family, "start" - 1 AS "start", "end", '+' AS strand, CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'partial' END AS status
FROM iv WHERE event_id % 9 <> 0""")
def third_party_table(spark, d):
    k = F.col("event_id")
    rows = event_intervals(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("seqID"), F.col("event_type").alias("family"), F.when(k % 9 == 0, "bad").otherwise(F.col("start").cast("string")).alias("isBegin"),
        F.col("end").cast("string").alias("isEnd"), F.lit("+").alias("strand"), F.when(k % 2 == 0, "c").otherwise("p").alias("type"),
    )
    at = _place(spark, "third-party")
    tables.write_tsv(rows, at)
    read = tables.read_tsv(spark, at, "seqID string, family string, isBegin string, isEnd string, strand string, type string")
    return tables.third_party_elements(read).select("contig_id", "family", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "status")


@query("""
SELECT 'P' || p_partkey AS name, p_name || CASE p_partkey % 4 WHEN 0 THEN ' integrase core' WHEN 1 THEN ' Integrase of phage' ELSE ' kinase' END AS description FROM part WHERE p_partkey % 4 = 0""")
def profile_library(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " integrase core").when(k % 4 == 1, " Integrase of phage").otherwise(" kinase")
    text = F.concat(F.lit("HMMER3/f\nNAME  P"), k, F.lit("\nACC   X\nDESC  "), F.col("p_name"), tail, F.lit("\nLENG  7\n//"))
    at = _place(spark, "library")
    table(spark, d, "part").select(text.alias("value")).write.text(at)
    return tables.profile_records(spark, at, "integrase|transposase", "phage").select("name", "description")


_ATOMS = """n AS (SELECT doc_id, aa, length(aa) AS n FROM p WHERE length(aa) > 0),
a AS (SELECT doc_id, n, i, round(5.0::DOUBLE * cos(i * 1.5::DOUBLE), 3) AS x, round(5.0::DOUBLE * sin(i * 1.5::DOUBLE), 3) AS y, round(i * 1.52::DOUBLE, 3) AS z,
  round(least(96.0, greatest(52.0, 88.0::DOUBLE - greatest(0.0, (10 - least(i, n - i + 1)) * 1.8::DOUBLE) + (i % 7) * 0.8::DOUBLE)), 2) AS plddt FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"""


@query(f"""
WITH p AS (SELECT doc_id, {SQL_PROTEIN} AS aa FROM documents), {_ATOMS},
m AS (SELECT doc_id, count(*) AS n, avg(plddt) AS plddt, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS radius FROM a GROUP BY doc_id),
e AS (SELECT *, 2.8::DOUBLE * pow(n, 0.33::DOUBLE) AS expected FROM m)
SELECT doc_id, CAST(n AS INT) AS residues, round(plddt, 4) AS plddt, round(radius, 4) AS radius, n >= 10 AND 100.0 * least(radius, expected) / greatest(radius, expected) * plddt / 100.0 + 20.0 >= 39.95 AS hit,
  CASE WHEN n >= 10 THEN round(100.0::DOUBLE * least(radius, expected) / greatest(radius, expected) * plddt / 100.0 + 20.0, 0) END AS bits FROM e""")
def simulated_folds(spark, d):
    p = texts(spark, d).select("doc_id", protein(F.col("text")).alias("aa"))
    # Proteins without residues go once they are measured; a filter before would translate every text twice.
    f = structures.predicted_folds(p, "doc_id", "aa").filter("radius IS NOT NULL")
    bits = F.when(F.col("residues") >= 10, F.round(100.0 * F.least("radius", 2.8 * F.pow("residues", F.lit(0.33))) / F.greatest("radius", 2.8 * F.pow("residues", F.lit(0.33))) * F.col("plddt") / 100.0 + 20.0, 0))
    return f.select("doc_id", "residues", F.round("plddt", 4).alias("plddt"), F.round("radius", 4).alias("radius"), "hit", bits.alias("bits"))


@query(f"""
WITH q AS (SELECT doc_id, {SQL_PROTEIN} AS aa FROM documents), p AS (SELECT doc_id, substr(aa, c * 6500 + 1, 6500) AS aa FROM q, LATERAL (SELECT unnest(range(0, (length(aa) - 1) // 6500 + 1)) AS c) WHERE length(aa) > 0), {_ATOMS}
SELECT count(*) AS atoms, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z, round(avg(plddt), 4) AS plddt, CAST(max(i) AS INT) AS last FROM a""")
def structure_file(spark, d):
    """Predicted structures as fixed-width atom lines, written and read.  The format has eight columns for a coordinate, so a long protein is several chains.

    An atom's line is 80 bytes for one letter of text, so the files are compressed, and written, read and removed a portion of the documents at a time.
    """
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("aa") - 1) / 6500).cast("int")), lambda c: F.substring(F.col("aa"), c * 6500 + 1, F.lit(6500)))
    documents = texts(spark, d)
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    portions = min(MOST_PORTIONS, 1 + size // PORTION_BYTES)
    sums = None
    for i in range(portions):
        mine = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(portions)) == i)
        # Empty chains go when lines are made; a filter before would translate every text twice.
        p = mine.select(protein(F.col("text")).alias("aa")).select(F.explode(parts).alias("aa"))
        at = _place(spark, "structures")
        # Dealt anew, since a file that is compressed is read by one task.
        chains = p.repartition(2 * spark.sparkContext.defaultParallelism)
        structures.structure_texts(chains, "aa").write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(at)
        a = tables.alpha_carbons(spark.read.text(at))
        read = materialize(a.agg(F.count(F.lit(1)).alias("atoms"), *[F.sum(c).alias(c) for c in ("x", "y", "z", "plddt")], F.max("residue").alias("last")), "structure-sums")
        artifacts.remove(spark, at)
        sums = read if sums is None else sums.unionByName(read)
    # One row a portion.
    atoms = F.sum("atoms")
    return sums.agg(
        atoms.alias("atoms"), *[F.round(F.sum(c), 3).alias(c) for c in ("x", "y", "z")], F.round(F.try_divide(F.sum("plddt"), atoms), 4).alias("plddt"), F.max("last").alias("last")
    )


@query("""
WITH p AS (SELECT p_partkey AS k, 'db//' || p_brand || p_partkey || '~~~orf' || (p_partkey % 3) || '~~~' || CASE WHEN p_partkey % 2 = 0 THEN 'Transposase' ELSE 'Accessory' END AS a FROM part)
SELECT k, substr(split_part(a, '~~~', 1), 5) AS name, split_part(a, '~~~', 2) AS orf, split_part(a, '~~~', 3) AS role, k % 2 = 0 AS confirmed, 'IS' || k AS element, CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE 'fam' || (k % 9) END AS family,
  CASE WHEN k % 5 <> 0 AND k % 3 = 1 THEN 'grp' || (k % 4) END AS grp, 'P' || lpad(CAST(k AS VARCHAR), 5, '0') AS accession, 'E' || k || '_BACSU' AS entry, 'protein of kind ' || (k % 11) AS description, 'Bacillus sp. ' || (k % 6) AS organism,
  CAST(1000 + k AS VARCHAR) AS taxonomy FROM p""")
def record_headers(spark, d):
    k = F.col("p_partkey")
    one = F.concat(F.lit("db//"), F.col("p_brand"), k, F.lit("~~~orf"), k % 3, F.lit("~~~"), F.when(k % 2 == 0, "Transposase").otherwise("Accessory"))
    two = F.when(k % 5 == 0, F.concat(F.lit("IS"), k)).otherwise(F.concat(F.lit("IS"), k, F.lit("_fam"), k % 9, F.when(k % 3 == 0, F.lit("_unknown")).when(k % 3 == 1, F.concat(F.lit("_grp"), k % 4)).otherwise("")))
    three = F.concat(F.lit("sp|P"), F.lpad(k.cast("string"), 5, "0"), F.lit("|E"), k, F.lit("_BACSU protein of kind "), k % 11, F.lit(" OS=Bacillus sp. "), k % 6, F.lit(" OX="), k + 1000, F.lit(" GN=abc PE=1 SV=2"))
    parsed = table(spark, d, "part").select(k.alias("k"), fasta.protein_header(one).alias("a"), fasta.dna_header(two).alias("b"), fasta.uniprot_header(three).alias("c"))
    return parsed.select(
        "k", "a.name", "a.orf", "a.role", filters.has_role(F.col("a.role")).alias("confirmed"), F.col("b.name").alias("element"), "b.family", F.col("b.group").alias("grp"),
        "c.accession", "c.entry", "c.description", "c.organism", "c.taxonomy",
    )


@query(f"""
WITH p AS (SELECT CAST(CASE WHEN doc_id % 41 = 0 THEN 1 ELSE doc_id END AS VARCHAR) AS protein_id, lower({SQL_PROTEIN}) || CASE doc_id % 5 WHEN 0 THEN '*' WHEN 1 THEN 'k*v' WHEN 2 THEN 'j' ELSE '' END AS raw FROM documents),
u AS (SELECT protein_id, upper(raw) AS raw, replace(regexp_replace(upper(raw), '[*]+$', ''), '*', 'X') AS s, count(*) OVER (PARTITION BY protein_id) AS copies FROM p)
SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS rejected, CAST(count(*) FILTER (copies > 1) AS BIGINT) AS duplicates, CAST(count(*) FILTER (contains(s, 'J')) AS BIGINT) AS letters,
  CAST(count(*) FILTER (NOT length(s) BETWEEN 50 AND 2000) AS BIGINT) AS lengths, CAST(count(*) FILTER (ok AND raw <> s) AS BIGINT) AS normalised, CAST(sum(length(s)) FILTER (ok) AS BIGINT) AS residues
FROM (SELECT *, copies = 1 AND s <> '' AND NOT contains(s, 'J') AND length(s) BETWEEN 50 AND 2000 AS ok FROM u)""")
def protein_quality(spark, d):
    """Quality control of proteins as read from FASTA: counts of what is accepted, and of every reason for a rejection."""
    k = F.col("doc_id")
    tail = F.when(k % 5 == 0, "*").when(k % 5 == 1, "k*v").when(k % 5 == 2, "j").otherwise("")
    p = table(spark, d, "documents").select(
        F.when(k % 41 == 0, 1).otherwise(k).cast("string").alias("id"), F.concat(F.lower(protein(F.col("text"))), tail).alias("seq")
    )
    at = _place(spark, "proteins")
    fasta.write_fasta(p, at, "id", "seq")
    good, bad = screening.protein_qc(fasta.read_fasta(spark, at).select(F.col("id").alias("protein_id"), "sequence"), 50, 2000)

    def has(reason: str):
        return F.count_if(F.array_contains("reasons", reason))

    a = good.agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("qc_status") == "stop_symbol_normalized").alias("normalised"), F.sum("length").alias("residues"))
    b = bad.agg(F.count(F.lit(1)).alias("rejected"), has("duplicate_id").alias("duplicates"), has("invalid_residue").alias("letters"), has("length").alias("lengths"))
    return a.crossJoin(b)  # one row each


@query(f"""
WITH {SQL_INTERVALS}
SELECT '##gff-version 3' AS line UNION ALL
SELECT concat_ws(chr(9), 'u' || user_id, 'mobilome', 'mobile_genetic_element', "start" + 1, "end", printf('%.2f', score), '+', '.', 'ID=' || event_id || ';Family=' || event_type || ';Status=partial;Score=' || printf('%.4f', score)
  || CASE WHEN event_id % 2 = 0 THEN ';TIR_len=' || (event_id % 40) ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ';TSD=ACG' ELSE '' END) FROM iv""")
def gff3_file(spark, d):
    k = F.col("event_id")
    e = event_intervals(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("contig_id"), k.cast("string").alias("element_id"), F.col("event_type").alias("family"), F.lit("partial").alias("status"), F.col("score").alias("composite_score"), "start", "end", F.lit("+").alias("strand"),
        F.when(k % 2 == 0, k % 40).alias("tir_length"), F.when(k % 3 == 0, "ACG").alias("tsd_sequence"), F.lit(None).cast("string").alias("structure_type"),
    )
    at = _place(spark, "gff3")
    tables.write_gff3(e, at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("""
WITH s AS (SELECT o_orderstatus AS split, count(*) AS sequences, count(DISTINCT o_custkey) AS clusters FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY split) AS i FROM s),
l AS (SELECT 0 AS line_no, 'splits:' AS line UNION ALL SELECT CAST(1000 * i AS INT), '  - name: ' || split FROM r UNION ALL SELECT CAST(1000 * i + 1 AS INT), '    sequences: ' || sequences FROM r UNION ALL SELECT CAST(1000 * i + 2 AS INT), '    clusters: ' || clusters FROM r)
SELECT CAST(row_number() OVER (ORDER BY line_no) AS INT) AS line_no, line FROM l""")
def manifest_file(spark, d):
    """A manifest of splits, written as YAML lines and read back in their order."""
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count(F.lit(1)).alias("sequences"), F.count_distinct("o_custkey").alias("clusters"))
    at = _place(spark, "manifest")
    artifacts.write_lines(artifacts.manifest_lines(counts, "split", ["sequences", "clusters"]), at)
    return tables.in_file_order(spark.read.text(at)).select(F.col("line_no").cast("int").alias("line_no"), F.col("value").alias("line"))


@query("""
WITH g AS (SELECT p_size AS family, count(*) AS n, round(avg(p_retailprice), 2) AS price FROM part GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, family) AS i FROM g)
SELECT 1 AS line_no, '| family | n |' AS line UNION ALL SELECT 2, '| --- | --- |' UNION ALL SELECT CAST(i + 2 AS INT), '| ' || family || ' | ' || n || ' |' FROM t WHERE i <= 12""")
def markdown_report(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_size").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    lines = artifacts.markdown_lines(g, ["family", "n"], [F.col("n").desc(), F.col("family")], 12)
    at = _place(spark, "report")
    artifacts.write_lines(lines, at)
    read = tables.in_file_order(spark.read.text(at))
    return read.select(F.col("line_no").cast("int").alias("line_no"), F.col("value").alias("line"))


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'X') AS x,
  (SELECT sha256(string_agg(CAST(n_nationkey AS VARCHAR) || chr(10), '' ORDER BY n_nationkey)) FROM nation) AS inputs FROM orders""")
def summary_file(spark, d):
    """A JSON summary, written, read back and parsed, with the digest of an input file."""
    at, other = _place(spark, "summary"), _place(spark, "input")
    table(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_nationkey").cast("string").alias("value")).write.text(other)
    artifacts.write_text(spark, tables.summary_json(table(spark, d, "orders"), {"status": ("o_orderstatus", ["F", "X"])}), at)
    read = spark.read.schema("total long, status struct<F: long, X: long>").json(at)
    digest = artifacts.file_sha256(spark, f"{other}/part-*").select(F.col("sha256").alias("inputs"))
    return read.select("total", F.col("status.F").alias("f"), F.col("status.X").alias("x")).crossJoin(digest)  # one row each


@query(f"""
WITH s AS (SELECT 'c' || doc_id AS contig_id, {SQL_DNA} AS seq FROM documents)
SELECT contig_id, CAST(ceil(length(seq) / 4000) AS BIGINT) AS tiles, CAST(length(seq) AS BIGINT) AS bases, CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS BIGINT) AS gc, sha256(seq) AS sha256 FROM s WHERE seq <> ''""")
def tiled_contigs(spark, d):
    """Contigs written in lines and read as overlapping tiles: what the tiles own is each contig, once."""
    from mobilome.sources import tiles

    c = texts(spark, d).select(F.concat(F.lit("c"), F.col("doc_id")).alias("contig_id"), dna(F.col("text")).alias("sequence"))
    at = _place(spark, "tiles")
    fasta.write_fasta(c, at, "contig_id", "sequence", width=70)
    own = F.substring(F.col("sequence"), (F.col("own_start") - F.col("start") + 1).cast("int"), (F.col("own_end") - F.col("own_start")).cast("int"))
    t = tiles.read_tiles(spark, at, 4_000, 500).select("contig_id", "tile", own.alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "own"))), lambda x: x["own"]), "")
    return t.groupBy("contig_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.length("own")).alias("bases"), F.sum(F.length(F.regexp_replace("own", "[^GC]", ""))).alias("gc"), F.sha2(whole, 256).alias("sha256")
    )
