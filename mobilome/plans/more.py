"""Registered queries of dataset preparation, audits, screening, test contigs, sampling and evaluation, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mobilome.functions import decisions as D
from mobilome.functions import sequence as S
from mobilome.operators import datasets, evaluation, filters, fragments, learning, metrics, models, screening
from mobilome.operators import hits as H
from mobilome.plans.derived import SQL_DNA, SQL_EVIDENCE, SQL_HITS, SQL_INTERVALS, SQL_PROTEIN, SQL_SCORED, dna, evidence, hits, protein, scored, table, texts
from mobilome.plans.derived import intervals as event_intervals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, places: int = 6):
    return F.round(c, places)


def pick(key, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def sql_pick(key: str, *values) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{quoted}][1 + {key} % {len(values)}]"


# --- dataset preparation ------------------------------------------------------------------------------------------

_ORGANISMS = ("Escherichia coli", "Homo sapiens", "Serratia marcescens", "Bacillus subtilis", None, "Vibrio cholerae", "Mus musculus")
_DESCRIPTIONS = (
    "Putative transposase", "Integrase core protein", "50S ribosomal protein L1", "Hypothetical protein", "Holliday junction resolvase", "Enolase", "DNA repair protein RecN", "Tyrosine recombinase XerC",
    "Ribonuclease H", "Uncharacterised Mobile Element factor", "Rep protein", "Serine recombinase", "Chromosome partition protein ParB", "Endodeoxyribonuclease  IV", "ATP-dependent DNA helicase RecQ", "para-aminobenzoate synthase",
)


def _any_sql(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{t}')" for t in terms) + ")"


_DESCRIBED = f"t AS (SELECT p_partkey AS k, {sql_pick('p_partkey', *_DESCRIPTIONS)} AS description, {sql_pick('p_partkey', *_ORGANISMS)} AS organism, CAST(p_partkey % 1700 AS INT) AS n FROM part)"


#: Records of a gzipped file, unless a batch has a file for every core.
POOL_RECORDS = 5_000


def _described(spark, d, parts: int | None = None):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k)
    return (rows if parts is None else rows.repartition(parts, k)).select(k.alias("k"), pick(k, *_DESCRIPTIONS).alias("description"), pick(k, *_ORGANISMS).alias("organism"), F.repeat(F.lit("M"), (k % 1700).cast("int")).alias("s"))


@query(f"""
WITH {_DESCRIBED}
SELECT k, CASE WHEN {_any_sql("description", filters.HARD_KEYWORDS)} THEN 'hard' WHEN {_any_sql("description", filters.EASY_KEYWORDS)} THEN 'easy' ELSE 'general' END AS pool
FROM t WHERE n BETWEEN 80 AND 1500 AND NOT {_any_sql("organism", filters.EXCLUDED_ORGANISMS)} AND NOT {_any_sql("description", filters.EXCLUDED_KEYWORDS)}""")
def negative_pools(spark, d):
    return filters.negative_pools(_described(spark, d), "description", "organism", "s").select("k", "pool")


@query(ORACLE["negative_pools"].replace("SELECT k, CASE", "SELECT 'K' || k AS accession, CASE", 1))
def stream_pools(spark, d):
    """The pools again, from gzipped records that come in five batches of files; a file cannot be split, so a batch has as many as its records are worth, up to one a core."""
    from mobilome.storage import shared_dir
    from mobilome.streaming.scans import stream_pools as pools

    root = f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/pools-{uuid.uuid4().hex}"
    files = min(spark.sparkContext.defaultParallelism, 1 + table(spark, d, "part").count() // POOL_RECORDS)
    k = F.col("k").cast("string")
    header = F.concat(F.lit(">sp|K"), k, F.lit("|E"), k, F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" OS="), F.coalesce("organism", F.lit("")), F.lit(" OX=1"))
    # Dealt before the records are made, which are many times as large.
    lines = _described(spark, d, 5 * files).select(F.concat(header, F.lit("\n"), "s").alias("value"))
    lines.write.option("compression", "gzip").text(f"{root}/in")
    pools(spark, f"{root}/in", f"{root}/out", f"{root}/check", files).awaitTermination()
    found = spark.read.schema("accession string, description string, organism string, sequence string, pool string").option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return found.select("accession", "pool")


@query(f"""
WITH {_DESCRIBED}
SELECT k, CASE WHEN regexp_matches(description, '(?i)\\b({filters.CHALLENGE_EXCLUDED})\\b') THEN NULL {" ".join(f"WHEN regexp_matches(description, '(?i)" + chr(92) + f"b({w})" + chr(92) + f"b') THEN '{n}'" for n, w in filters.CHALLENGE_CLASSES)} END AS class FROM t""")
def challenge_classes(spark, d):
    return _described(spark, d).select("k", filters.challenge_class(F.col("description")).alias("class"))


@query("""
SELECT n_nationkey, r_name AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'header' ELSE n_name END AS family, CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown' ELSE n_name END AS protein_family FROM nation JOIN region ON n_regionkey = r_regionkey""")
def strict_map(spark, d):
    n = filters.strict_map(table(spark, d, "nation"), "n_regionkey", table(spark, d, "region"), "r_regionkey", "r_name")
    known = F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name"))
    return n.select("n_nationkey", F.col("r_name").alias("region"), filters.enriched_family(known, F.lit("header")).alias("family"), filters.enriched_family(known).alias("protein_family"))


@query("SELECT count(*) FILTER (rn <= 5) > 1 OR min(CASE WHEN rn <= 5 THEN n END) < 100000 AS fragmented FROM (SELECT length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def input_shape(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("sequence"))
    return spark.createDataFrame([(filters.is_fragmented(c, ["doc_id"]),)], "fragmented boolean")


@query("""
WITH names AS (SELECT s_suppkey AS tpase_id, 'IS' || (s_suppkey % 60) AS is_name FROM supplier), v AS (SELECT vec_id AS seq_id, vec_id % 4 AS label, ['IS3', 'IS200/IS605', 'IS5'][1 + vec_id % 3] AS family, vec_id % 5 AS part FROM embeddings)
SELECT DISTINCT is_name FROM v JOIN names ON seq_id = tpase_id WHERE label = 1 AND (part = 0 OR (part = 1 AND family = 'IS200/IS605'))""")
def selected_names(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tpase_id"), F.concat(F.lit("IS"), F.col("s_suppkey") % 60).alias("is_name"))
    k = F.col("vec_id")
    v = table(spark, d, "embeddings").select(k.alias("seq_id"), (k % 4).alias("label"), pick(k, "IS3", "IS200/IS605", "IS5").alias("family"), (k % 5).alias("part"))
    return filters.selected_names(v.filter("part = 0"), v.filter("part = 1"), names)


@query("""
WITH e AS (SELECT p_partkey AS k, ['IS3', 'IS110', 'IS5', 'IS1', 'IS21'][1 + (p_partkey * p_partkey) % 5] AS family FROM part), f AS (SELECT count(DISTINCT family) AS n, count(*) AS total FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5('42:' || CAST(k AS VARCHAR)), k) AS rn FROM e)
SELECT k, family FROM o CROSS JOIN f WHERE total <= 100 OR rn <= CASE WHEN family = 'IS110' THEN 60 ELSE greatest(10, 100 // n) END""")
def capped_families(spark, d):
    k = F.col("p_partkey")
    e = table(spark, d, "part").select(k.alias("k"), pick(k * k, "IS3", "IS110", "IS5", "IS1", "IS21").alias("family"))
    return filters.capped_by_family(e, "family", "k", 100, ("IS110",))


@query("""
WITH s AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT (SELECT count(*) FROM s) AS rows_in_union, (SELECT count(DISTINCT sha) FROM s WHERE split = 'test' AND sha IN (SELECT sha FROM s WHERE split = 'train')) AS shared_test_train,
  (SELECT count(*) FROM s WHERE split = 'test' AND sha NOT IN (SELECT sha FROM s WHERE split <> 'test')) AS unused, (SELECT count(*) FROM s WHERE split = 'test' AND sha IN (SELECT sha FROM s WHERE split <> 'test')) AS used""")
def split_sets(spark, d):
    """Union of three splits, content shared between them, and rows whose content is used elsewhere or not."""
    k = F.col("doc_id")
    s = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").otherwise("train").alias("split"))
    parts = {n: s.filter(F.col("split") == n) for n in ("train", "val", "test")}
    union = parts["train"].unionByName(parts["val"]).unionByName(parts["test"])
    shared = datasets.shared_values(parts["test"], parts["train"], "sha").select(F.col("shared").alias("shared_test_train"))
    others = union.filter("split <> 'test'").select("sha")
    used = parts["test"].join(others, "sha", "left_semi").agg(F.count(F.lit(1)).alias("used"))
    unused = parts["test"].join(others, "sha", "left_anti").agg(F.count(F.lit(1)).alias("unused"))
    return union.agg(F.count(F.lit(1)).alias("rows_in_union")).crossJoin(shared).crossJoin(unused).crossJoin(used)  # one row each


# --- audits and clusters ------------------------------------------------------------------------------------------


@query(f"""
WITH {SQL_HITS}, x AS (SELECT *, least(qcov, tcov) AS rcov FROM hits),
l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, line_no) AS rn FROM x), s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, line_no) AS rn FROM x WHERE rcov >= 0.8)
SELECT p_partkey AS seq_id, p_partkey % 2 AS label, coalesce(l.target, -1) AS nearest, round(coalesce(l.fident, 0.0), 6) AS local_identity, round(coalesce(l.bits, 0.0), 4) AS bits, round(coalesce(s.fident, 0.0), 6) AS strict_identity,
  CASE WHEN l.query IS NULL THEN 'NO_HOMOLOG_FOUND' WHEN s.query IS NULL THEN 'DOMAIN_OVERLAP' WHEN s.fident >= 0.99 AND s.rcov >= 0.99 THEN 'L1_EXACT' WHEN s.fident >= 0.30 THEN 'L2_CLOSE' WHEN s.fident >= 0.20 THEN 'REMOTE_30' ELSE 'REMOTE_20' END AS homology_class
FROM part LEFT JOIN (SELECT * FROM l WHERE rn = 1) l ON l.query = p_partkey LEFT JOIN (SELECT * FROM s WHERE rn = 1) s ON s.query = p_partkey""")
def reciprocal_audit(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), (F.col("p_partkey") % 2).alias("label"))
    return H.reciprocal_audit(q, hits(spark, d)).withColumns({"local_identity": r("local_identity"), "bits": r("bits", 4), "strict_identity": r("strict_identity")})


@query(f"""
WITH RECURSIVE {SQL_HITS}, v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS i FROM part),
e AS (SELECT 'D' AS scheme, query AS a, target AS b FROM hits WHERE query <> target AND fident >= 0.3 AND qcov >= 0.8 AND tcov >= 0.8 UNION SELECT 'E', query, target FROM hits WHERE query <> target AND fident >= 0.3 AND tcov >= 0.8),
x AS (SELECT scheme, a, b FROM e UNION SELECT scheme, b, a FROM e),
nb AS (SELECT scheme, va.i, list(DISTINCT vb.i) AS js FROM x JOIN v va ON x.a = va.id JOIN v vb ON x.b = vb.id GROUP BY scheme, va.i),
g(scheme, i, reps) AS (SELECT unnest(['D', 'E']), CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT g.scheme, g.i + 1, CASE WHEN nb.js IS NOT NULL AND list_has_any(g.reps, nb.js) THEN g.reps ELSE list_append(g.reps, g.i + 1) END
  FROM g LEFT JOIN nb ON nb.scheme = g.scheme AND nb.i = g.i + 1 WHERE g.i < (SELECT count(*) FROM v)),
z AS (SELECT scheme, reps FROM g WHERE i = (SELECT count(*) FROM v)),
o AS (SELECT z.scheme, v.id, CASE WHEN list_contains(z.reps, v.i) THEN v.i ELSE list_min(list_intersect(z.reps, nb.js)) END AS r FROM z CROSS JOIN v LEFT JOIN nb ON nb.scheme = z.scheme AND nb.i = v.i)
SELECT o.scheme, o.id, v.id AS representative FROM o JOIN v ON v.i = o.r""")
def greedy_clusters(spark, d):
    """Greedy clusters by the covering edges of both greedy schemes, longer ids' names first; tests hold it to the one-by-one form."""
    e = H.scheme_edges(hits(spark, d))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").alias("n"))
    out = [H.greedy_clusters(v, e.filter(F.col("scheme") == s).select(F.col("query").alias("src"), F.col("target").alias("dst")), "id", [F.col("n")]).select(F.lit(s).alias("scheme"), "id", "representative") for s in ("D", "E")]
    return out[0].unionByName(out[1])


@query(f"""
WITH {SQL_EVIDENCE}, x AS (SELECT okey, okey % 2 AS y, p, CASE WHEN okey % 3 <> 0 THEN (okey % 45) / 100.0::DOUBLE END AS identity, {sql_pick("okey", "L2_CLOSE", "NO_FULL_LENGTH_HOMOLOG", "L3_DOMAIN_ONLY", None)} AS class FROM strong),
s AS (SELECT *, unnest(list_filter(['Overall', CASE WHEN y <> 1 OR coalesce(identity, 0) < 0.30 THEN 'Remote30' END, CASE WHEN y <> 1 OR coalesce(identity, 0) < 0.20 THEN 'Remote20' END,
  CASE WHEN y <> 1 OR coalesce(class IN ('NO_FULL_LENGTH_HOMOLOG', 'L3_DOMAIN_ONLY'), false) THEN 'NoFullLength' END], lambda z: z IS NOT NULL)) AS stratum FROM x)
SELECT stratum, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y <> 1) AS negatives, count(*) FILTER (y = 1 AND p >= 0.5) AS found FROM s GROUP BY stratum""")
def remote_strata(spark, d):
    k = F.col("okey")
    x = evidence(spark, d).select((k % 2).alias("y"), "p", F.when(k % 3 != 0, (k % 45) / 100.0).alias("identity"), pick(k, "L2_CLOSE", "NO_FULL_LENGTH_HOMOLOG", "L3_DOMAIN_ONLY", None).alias("class"))
    s = metrics.strata(x, filters.homology_strata(F.col("identity"), F.col("class")), "y")
    return s.groupBy("stratum").agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") != 1).alias("negatives"), F.count_if((F.col("y") == 1) & (F.col("p") >= 0.5)).alias("found"))


# --- screening ----------------------------------------------------------------------------------------------------

_LOOP = """e AS (SELECT p_partkey AS k, 'E' || p_partkey AS element_id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'c' || (p_partkey % 23) || '_g' ELSE 'g' || (p_partkey % 90) || 'x' END AS gene, CASE WHEN p_partkey % 3 = 0 THEN 'complete' ELSE 'partial' END AS status,
  (p_partkey % 97) / 97.0::DOUBLE AS composite, CASE WHEN p_partkey % 2 = 0 THEN 120.0::DOUBLE ELSE 0.4::DOUBLE END AS tpase_score FROM part),
p AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'E' || s_suppkey || '_tpase' WHEN 1 THEN 'E' || s_suppkey WHEN 2 THEN 'pre_c' || (s_suppkey % 29) || '_g' || s_suppkey ELSE 'g' || s_suppkey || 'x_y' END AS pid, ['Novel_candidate', 'Remote', 'Known-like', 'Uncertain', 'Negative'][1 + s_suppkey % 5] AS cat, (s_suppkey % 89) / 89.0::DOUBLE AS score, s_suppkey AS o FROM supplier)"""


def _loop_inputs(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    e = table(spark, d, "part").select(
        F.concat(F.lit("E"), k).alias("element_id"), F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("c"), k % 23, F.lit("_g"))).otherwise(F.concat(F.lit("g"), k % 90, F.lit("x"))).alias("tpase_gene_id"),
        F.when(k % 3 == 0, "complete").otherwise("partial").alias("status"), (k % 97 / 97.0).alias("composite_score"), F.when(k % 2 == 0, 120.0).otherwise(0.4).alias("tpase_score"),
    )
    pid = F.when(s % 4 == 0, F.concat(F.lit("E"), s, F.lit("_tpase"))).when(s % 4 == 1, F.concat(F.lit("E"), s)).when(s % 4 == 2, F.concat(F.lit("pre_c"), s % 29, F.lit("_g"), s)).otherwise(F.concat(F.lit("g"), s, F.lit("x_y")))
    p = table(spark, d, "supplier").select(pid.alias("protein_id"), pick(s, "Novel_candidate", "Remote", "Known-like", "Uncertain", "Negative").alias("final_category"), (s % 89 / 89.0).alias("transposase_score"), s.alias("place"))
    return e, p


@query(f"""
WITH {_LOOP}, x AS (SELECT k, pid, cat, score, 0 AS tier, CASE pid WHEN element_id || '_tpase' THEN 0 WHEN element_id THEN 1 ELSE 2 END AS rk FROM e JOIN p ON pid IN (element_id || '_tpase', element_id, gene)),
l AS (SELECT k, pid, cat, score, 1 AS tier, o AS rk FROM e JOIN p ON contains(pid, element_id) OR (gene <> '' AND contains(pid, gene))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, rk, pid) AS rn FROM (SELECT * FROM x UNION ALL SELECT * FROM l)) WHERE rn = 1)
SELECT element_id, coalesce(cat, 'Uncertain') AS protein_category,
  CASE WHEN status = 'complete' AND coalesce(cat, 'Uncertain') IN ('Novel_candidate', 'Remote') THEN 'High_Confidence_Novel_IS' WHEN status = 'complete' AND cat = 'Known-like' THEN 'High_Confidence_Known_IS'
    WHEN status <> 'complete' AND coalesce(cat, 'Uncertain') IN ('Novel_candidate', 'Remote') THEN 'Candidate_Novel_IS' WHEN status = 'complete' THEN 'Confirmed_Standard_IS' ELSE 'Standard_IS' END AS dual_category,
  CAST(round_even(CAST(0.5::DOUBLE * composite + 0.5::DOUBLE * coalesce(score, least(1.0, CASE WHEN tpase_score > 1 THEN tpase_score / 150.0::DOUBLE ELSE tpase_score END)) AS DECIMAL(18, 12)), 4) AS DOUBLE) AS dual_confidence
FROM e LEFT JOIN b USING (k)""")
def closed_loop(spark, d):
    e, p = _loop_inputs(spark, d)
    return screening.closed_loop(e, p, "place").select("element_id", "protein_category", "dual_category", "dual_confidence")


@query(f"""
WITH {SQL_EVIDENCE}, x AS (SELECT *, CASE WHEN p < 0.35 AND strong THEN 'UNCERTAIN' WHEN p < 0.35 THEN 'REJECT' WHEN p >= 0.70 AND strong THEN 'ACCEPT_KNOWN' WHEN p >= 0.70 THEN 'STAGE2A' ELSE 'UNCERTAIN' END AS route FROM strong),
y AS (SELECT *, CASE WHEN route IN ('STAGE2A', 'UNCERTAIN') THEN fast END AS f2, CASE WHEN route IN ('STAGE2A', 'UNCERTAIN') THEN sim END AS s2 FROM x),
z AS (SELECT *, CASE WHEN f2 IS NULL THEN route WHEN f2 >= 0.7 OR s2 >= 0.7 THEN 'STAGE2A' WHEN f2 < 0.35 AND s2 < 0.35 THEN 'REJECT' ELSE 'STAGE2B' END AS rescue FROM y)
SELECT 'p' || okey AS protein_id, strong, any_hit, route, rescue, round(f2, 6) AS fast_score, round(CASE WHEN rescue = 'STAGE2B' OR (route = 'STAGE2A' AND f2 >= 0.60) THEN "full" END, 6) AS full_score, ident IS NOT NULL AS searched FROM z""")
def screening_flow(spark, d):
    """First scores with the evidence of two searches, routed; structure scores are looked at only where the route asks for them."""
    e = evidence(spark, d).withColumn("protein_id", F.concat(F.lit("p"), F.col("okey")))
    search = e.filter("ident IS NOT NULL").select(F.col("protein_id").alias("query"), F.lit("t").alias("target"), (F.col("ident") / 100).alias("fident"), (F.col("cov") / 100).alias("qcov"), F.col("ev").alias("evalue"), F.lit(50.0).alias("bits"))
    profiles = e.filter("hev IS NOT NULL").select(F.col("protein_id").alias("query"), F.lit("h").alias("profile"), F.col("hev").alias("evalue"), F.lit(9.0).alias("bits"))
    attached = screening.attach_evidence(e.select("protein_id", "p", "fast", "sim", "full"), search, profiles)
    out = screening.screen(attached, "p", F.col("fast"), F.col("sim"), F.col("full"))
    return out.select("protein_id", "strong", "any_hit", "route", "rescue", r("fast_score").alias("fast_score"), r("full_score").alias("full_score"), F.col("mmseqs_target").isNotNull().alias("searched"))


@query(f"""
WITH {SQL_EVIDENCE} SELECT 'p' || okey AS protein_id, CASE WHEN okey % 2 = 0 THEN 'Remote' ELSE 'Negative' END AS final_category, 'fusion' AS routing_stage, 'fused' AS notes, round(p, 6) AS transposase_score, 'STAGE2A' AS route, ident IS NOT NULL AS mmseqs_hit, 13 + 16 + 13 AS n_columns,
  'protein_id,length,sequence_sha256' AS first_columns FROM strong""")
def flattened_records(spark, d):
    e = evidence(spark, d)
    null = F.lit(None).cast("string")

    def part(columns, **given):
        return F.struct(*[given.get(c, null).alias(c) for c in columns])

    s1, c, full = screening.STAGE1_COLUMNS, screening.COMBINED_COLUMNS, screening.RESEARCH_COLUMNS
    nested = e.select(
        part(s1, protein_id=F.concat(F.lit("p"), F.col("okey")), final_category=F.lit("Uncertain"), routing_stage=F.lit("stage1"), notes=F.lit("first")).alias("stage1"),
        part(c[13:21], mmseqs_hit=F.col("ident").isNotNull()).alias("search"), part(c[21:27]).alias("profile"), part(c[27:], route=F.lit("STAGE2A")).alias("routing"), part(full[29:40]).alias("structure"),
        F.struct(F.when(F.col("okey") % 2 == 0, "Remote").otherwise("Negative").alias("final_category"), F.lit("fusion").alias("routing_stage"), F.lit("fused").alias("notes"), F.col("p").alias("transposase_score"), F.lit(0.0).alias("novelty_score")).alias("fusion"),
    )
    flat = screening.flattened(nested)
    return flat.select(
        "protein_id", "final_category", "routing_stage", "notes", r("transposase_score").alias("transposase_score"), "route", "mmseqs_hit",
        F.lit(len(flat.columns)).alias("n_columns"), F.lit(",".join(flat.columns[:3])).alias("first_columns"),
    )


@query("""
WITH x AS (SELECT o_orderkey AS okey, ['complete', 'edge_5p_truncated', 'internal_partial', 'edge_both_truncated'][1 + o_orderkey % 4] AS t, ['complete', 'partial', 'pseudo'][1 + o_orderkey % 3] AS c, (o_orderkey * 7) % 220 / 2.0::DOUBLE AS bits FROM orders)
SELECT okey, CASE WHEN c = 'pseudo' AND bits < 30 THEN 'pseudo' WHEN t = 'complete' THEN 'complete' ELSE 'partial' END AS status, round(least(1.0, bits / 150.0::DOUBLE), 6) AS hit_score, round(1 / (1 + exp(-(bits - 30.0::DOUBLE) / 10.0::DOUBLE)), 6) AS chance FROM x""")
def final_status(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(k.alias("okey"), pick(k, "complete", "edge_5p_truncated", "internal_partial", "edge_both_truncated").alias("t"), pick(k, "complete", "partial", "pseudo").alias("c"), ((k * 7) % 220 / 2.0).alias("bits"))
    return x.select("okey", D.final_status(F.col("t"), F.col("c"), F.col("bits")).alias("status"), r(D.hit_score(F.col("bits"))).alias("hit_score"), r(S.bit_sigmoid(F.col("bits"))).alias("chance"))


# --- sequences and notes ------------------------------------------------------------------------------------------


@query(f"""
WITH s AS (SELECT doc_id, ' ' || lower({SQL_PROTEIN}) || chr(10) || 'mk ' AS p, [CAST(doc_id % 30 AS VARCHAR) || '/' || (doc_id % 25), CAST(doc_id % 9 AS VARCHAR), 'none', NULL][1 + doc_id % 4] AS ir, CASE doc_id % 3 WHEN 0 THEN (doc_id % 28) || ' bp' WHEN 1 THEN 'variable' END AS dr,
  {sql_pick("doc_id", "IS3", "IS200/IS605", "IS66", "ISX", "IS110")} AS family, coalesce(n_chars, 0) AS n FROM documents),
t AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(ir, '^\\s*\\d+\\s*/\\s*(\\d+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(ir, '(\\d+)', 1), '') AS INT)) AS irn, TRY_CAST(nullif(regexp_extract(dr, '(\\d+)', 1), '') AS INT) AS drn FROM s)
SELECT doc_id, sha256(upper(replace(replace(p, ' ', ''), chr(10), ''))) AS clean_sha, sha256(upper(p)) AS upper_sha, CASE WHEN irn > 3 THEN irn END AS ir_length,
  CASE WHEN family NOT IN ('IS200/IS605', 'IS110') THEN CASE WHEN drn BETWEEN 2 AND 20 THEN drn ELSE CASE family WHEN 'IS3' THEN 3 WHEN 'IS66' THEN 8 ELSE 4 END END END AS dr_length,
  regexp_replace(family, '[^A-Za-z0-9]+', '_', 'g') AS clean_family, family AS model_family, sha256(regexp_replace(upper(trim(replace(p, chr(10), ''))), '(.)', '\\1#', 'g')) AS hashed_sha,
  [CASE WHEN doc_id % 2 = 0 THEN 49 ELSE CAST(floor(n * 0.15::DOUBLE) AS INT) END, CASE WHEN doc_id % 2 = 0 THEN 950 ELSE CAST(floor(n * 0.85::DOUBLE) AS INT) END] AS orf, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM t""")
def sequence_notes(spark, d):
    k = F.col("doc_id")
    p = F.concat(F.lit(" "), F.lower(protein(F.col("text"))), F.lit("\nmk "))
    ir = F.when(k % 4 == 0, F.concat(k % 30, F.lit("/"), k % 25)).when(k % 4 == 1, (k % 9).cast("string")).when(k % 4 == 2, "none")
    dr = F.when(k % 3 == 0, F.concat(k % 28, F.lit(" bp"))).when(k % 3 == 1, "variable")
    s = table(spark, d, "documents").select("doc_id", p.alias("p"), ir.alias("ir"), dr.alias("dr"), pick(k, "IS3", "IS200/IS605", "IS66", "ISX", "IS110").alias("family"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    orf = S.primary_orf(F.when(k % 2 == 0, "120 (10 - 400), 300 (950 - 50)").otherwise("none"), F.col("n"))
    return s.select(
        "doc_id", S.normalised_sha256(F.col("p")).alias("clean_sha"), S.upper_sha256(F.col("p")).alias("upper_sha"), S.inverted_repeat_length(F.col("ir")).alias("ir_length"),
        fragments.family_repeat_length(F.col("dr"), F.col("family")).alias("dr_length"), S.clean_family(F.col("family")).alias("clean_family"), S.strip_model_prefix(F.concat(F.lit("Tpase_"), F.col("family"))).alias("model_family"),
        F.sha2(S.model_input(F.upper(F.trim(F.replace("p", F.lit("\n"), F.lit("")))), "hashed"), 256).alias("hashed_sha"), F.array(orf["start"], orf["end"]).alias("orf"), orf["strand"].alias("strand"),
    )


# --- test contigs -------------------------------------------------------------------------------------------------

_CONTEXT = f"""s AS (SELECT 'n' || doc_id AS is_name, upper({SQL_DNA}) AS s, {sql_pick("doc_id", "IS3", "IS200/IS605", "IS66", "IS110")} AS family, doc_id FROM documents),
c AS (SELECT *, length(s) AS n, CASE WHEN family IN ('IS3', 'IS66') THEN CASE WHEN doc_id % 25 BETWEEN 2 AND 20 THEN doc_id % 25 ELSE CASE family WHEN 'IS3' THEN 3 ELSE 8 END END END AS tsd FROM s WHERE length(s) BETWEEN 200 AND 10000),
x AS (SELECT is_name, family, n, tsd, 40 + coalesce(tsd, 0) AS true_start, 40 + coalesce(tsd, 0) + n AS true_end, 80 + 2 * coalesce(tsd, 0) + n AS contig_length FROM c)"""


def _contexts(spark, d):
    k = F.col("doc_id")
    e = texts(spark, d).select(
        F.concat(F.lit("n"), k).alias("is_name"), pick(k, "IS3", "IS200/IS605", "IS66", "IS110").alias("family"), dna(F.col("text")).alias("dna_sequence"), F.lit("none").alias("orf_annotation"), (k % 25).cast("string").alias("dr_length"), F.lit("12").alias("tir_left")
    )
    return fragments.genomic_contexts(e, 40), e


@query(f"""
WITH {_CONTEXT} SELECT is_name, CAST(true_start AS INT) AS true_start, CAST(true_end AS INT) AS true_end, CAST(contig_length AS INT) AS contig_length, CAST(true_start + floor(n * 0.15::DOUBLE) AS INT) AS tpase_start, CAST(tsd AS INT) AS annotated_tsd_len, true AS holds_element, CASE WHEN tsd IS NOT NULL THEN true END AS holds_repeats,
  CASE WHEN family IN ('IS3', 'IS66') THEN 12 END AS annotated_tir_len FROM x""")
def genomic_contexts(spark, d):
    """Elements in random flanks: where they lie, and whether element and direct repeats stand there."""
    c, e = _contexts(spark, d)
    own = e.select(F.col("is_name").alias("i"), F.upper("dna_sequence").alias("s"))
    site = F.length("true_tsd_seq")
    j = c.join(own, F.col("is_name") == F.col("i"))
    return j.select(
        "is_name", "true_start", "true_end", "contig_length", "tpase_start", F.col("annotated_tsd_len").cast("int").alias("annotated_tsd_len"), (F.substr("contig_sequence", F.col("true_start") + 1, F.col("true_length")) == F.col("s")).alias("holds_element"),
        ((F.substr("contig_sequence", F.col("true_start") - site + 1, site) == F.col("true_tsd_seq")) & (F.substr("contig_sequence", F.col("true_end") + 1, site) == F.col("true_tsd_seq"))).alias("holds_repeats"), F.col("annotated_tir_len").cast("int").alias("annotated_tir_len"),
    )


def _draw_sql(tag: str, low: str, high: str) -> str:
    u = f"CAST('0x' || substr(md5('42:' || is_name || ':{tag}'), 1, 8) AS BIGINT)"
    return f"({low} + {u} % greatest({high} - {low} + 1, 1))"


@query(f"""
WITH {_CONTEXT}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || is_name), is_name) AS rn FROM x),
k AS (SELECT *, CASE WHEN rn <= 50 THEN 'complete' WHEN rn <= 80 THEN 'edge_5p_truncated' WHEN rn <= 110 THEN 'edge_3p_truncated' WHEN rn <= 120 THEN 'edge_both_truncated' END AS class, {_draw_sql("cut", "20", "least(250, n // 3)")} AS inside FROM o WHERE rn <= 120),
l AS (SELECT *, CASE class WHEN 'edge_5p_truncated' THEN true_start + inside WHEN 'edge_3p_truncated' THEN greatest(0, true_start - {_draw_sql("flank", "150", "400")}) WHEN 'edge_both_truncated' THEN true_start + {_draw_sql("left", "40", "150")} ELSE 0 END AS l FROM k),
c2 AS (SELECT *, least(contig_length, CASE class WHEN 'edge_5p_truncated' THEN least(contig_length, l + greatest(650, n - inside + 300)) WHEN 'edge_3p_truncated' THEN true_end - inside WHEN 'edge_both_truncated' THEN greatest(l + 550, true_end - {_draw_sql("right", "40", "150")}) ELSE contig_length END) AS r FROM l)
SELECT 'fragment_' || class || '_' || is_name AS contig_id, CAST(r - l AS INT) AS contig_length, CAST(greatest(true_start - l, 0) AS INT) AS gold_start, CAST(least(true_end - l, r - l) AS INT) AS gold_end, class AS gold_truncation FROM c2""")
def cut_fragments(spark, d):
    c, _ = _contexts(spark, d)
    out = fragments.cut_fragments(fragments.fragment_classes(c))
    return out.select("contig_id", "contig_length", "gold_start", "gold_end", "gold_truncation")


# --- sampling and evaluation --------------------------------------------------------------------------------------


@query(f"""
WITH {SQL_SCORED}, u AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rk, count(*) OVER () AS k FROM scored WHERE y IS NOT NULL GROUP BY lang), t AS (SELECT max(k) AS k FROM u),
dr AS (SELECT r, CAST('0x' || substr(md5('7:' || r || ':' || i), 1, 12) AS BIGINT) % k AS pick FROM (SELECT unnest(range(100)) AS r) CROSS JOIN t CROSS JOIN LATERAL (SELECT unnest(range(1, k + 1)) AS i)),
st AS (SELECT lang, score AS step, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scored WHERE y IS NOT NULL GROUP BY 1, 2),
b AS (SELECT r, step, sum(pos) AS pos, sum(neg) AS neg FROM dr JOIN u ON pick = rk JOIN st ON st.lang IS NOT DISTINCT FROM u.lang GROUP BY r, step),
w AS (SELECT r, pos, sum(pos) OVER v AS tp, sum(pos + neg) OVER v AS n FROM b WINDOW v AS (PARTITION BY r ORDER BY step DESC)),
ap AS (SELECT r, sum(pos * tp / n) / sum(pos) AS value FROM w GROUP BY r HAVING sum(pos) > 0)
SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM ap""")
def bootstrap_average_precision(spark, d):
    out = metrics.bootstrap_average_precision(scored(spark, d).filter("y IS NOT NULL"), "y", "score", "lang", 100, "7")
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("""
WITH v AS (SELECT vec_id, label AS family, (vec_id * 37) % 101 / 101.0::DOUBLE AS score, vec_id % 4 = 0 AS neg FROM embeddings WHERE label IS NOT NULL),
f AS (SELECT family, count(*) AS n, round(avg((score >= 0.4)::INT), 6) AS recall, round(avg((score >= 0.6)::INT), 6) AS other FROM v WHERE NOT neg GROUP BY family)
SELECT count(*) AS families, CAST(sum(n) AS BIGINT) AS members, round(avg(recall), 6) AS macro_recall, round(avg(other), 6) AS macro_other, round(avg(recall - other), 6) AS macro_delta FROM f WHERE n >= 30""")
def macro_means(spark, d):
    """Recalls of two methods over held-out families of 30 members or more, averaged plainly."""
    k = F.col("vec_id")
    v = table(spark, d, "embeddings").filter("label IS NOT NULL").select(F.col("label").alias("family"), ((k * 37) % 101 / 101.0).alias("score"), (k % 4 != 0).cast("int").alias("y"))
    a = metrics.group_recall(v, "y", "score", "family", F.lit(0.4)).select("family", "n", r("recall").alias("recall"))
    b = metrics.group_recall(v, "y", "score", "family", F.lit(0.6)).select(F.col("family").alias("f"), r("recall").alias("other"))
    both = a.join(b, F.col("family") == F.col("f")).withColumn("delta", F.col("recall") - F.col("other"))
    out = models.macro_means(both, "n", ["recall", "other", "delta"])
    return out.withColumns({c: r(c) for c in ("macro_recall", "macro_other", "macro_delta")})


@query("""
WITH x AS (SELECT ['a', 'b', 'c', 'd'][1 + o_orderkey % 4] AS t, CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b', 'c', 'd'][1 + (o_orderkey * 7) % 4] ELSE ['a', 'b', 'c', 'd'][1 + o_orderkey % 4] END AS p, o_orderkey % 11 <> 0 AS top3 FROM orders),
k AS (SELECT c, sum(tp) AS tp, sum(n) AS n, sum(m) AS m FROM (SELECT t AS c, (t = p)::INT AS tp, 1 AS n, 0 AS m FROM x UNION ALL SELECT p, 0, 0, 1 FROM x) GROUP BY c)
SELECT round((SELECT avg((t = p)::INT) FROM x), 6) AS accuracy, round((SELECT avg(top3::INT) FROM x), 6) AS top3_accuracy, round(avg(2 * tp / (n + m)), 6) AS macro_f1 FROM k""")
def class_metrics(spark, d):
    k = F.col("o_orderkey")
    truth = pick(k, "a", "b", "c", "d")
    x = table(spark, d, "orders").select(truth.alias("t"), F.when(k % 3 == 0, pick(k * 7, "a", "b", "c", "d")).otherwise(truth).alias("p"), (k % 11 != 0).alias("top3"))
    out = learning.class_metrics(x, "t", "p", F.col("top3"))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("""
WITH t AS (SELECT 'c' || o_orderkey AS contig_id, o_orderkey % 3 <> 0 AS pos, ['complete', 'edge_5p_truncated', 'edge_3p_truncated'][1 + o_orderkey % 3] AS gold FROM orders),
d AS (SELECT 'c' || (l_orderkey) AS contig_id, l_extendedprice + l_linenumber / 100.0 AS score, ['complete', 'edge_5p_truncated', 'internal_partial'][1 + l_linenumber % 3] AS truncation FROM lineitem WHERE l_quantity >= 45),
b AS (SELECT contig_id, arg_max(truncation, score) AS truncation, count(*) AS found FROM d GROUP BY contig_id), j AS (SELECT * FROM t LEFT JOIN b USING (contig_id))
SELECT round(count(*) FILTER (pos AND found IS NOT NULL) / count(*) FILTER (pos), 6) AS recall, round(1 - sum(CASE WHEN NOT pos THEN coalesce(found, 0) ELSE 0 END) / count(*) FILTER (NOT pos), 6) AS specificity,
  round(count(*) FILTER (pos AND found IS NOT NULL AND (truncation = gold OR (starts_with(truncation, 'edge_') AND starts_with(gold, 'edge_')))) / count(*) FILTER (pos AND found IS NOT NULL), 6) AS truncation_accuracy FROM j""")
def fragment_summary(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.concat(F.lit("c"), k).alias("contig_id"), (k % 3 != 0).alias("is_positive"), pick(k, "complete", "edge_5p_truncated", "edge_3p_truncated").alias("gold_truncation"))
    l = table(spark, d, "lineitem").filter("l_quantity >= 45")
    found = l.select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("contig_id"), (F.col("l_extendedprice") + F.col("l_linenumber") / 100.0).alias("composite_score"), pick(F.col("l_linenumber"), "complete", "edge_5p_truncated", "internal_partial").alias("truncation"))
    out = evaluation.fragment_summary(t, found)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("""
WITH t AS (SELECT 'c' || o_orderkey AS contig_id, o_orderkey % 3 <> 0 AS pos, ['complete', 'edge_5p_truncated', 'edge_3p_truncated'][1 + o_orderkey % 3] AS gold FROM orders),
d AS (SELECT 'c' || l_orderkey AS contig_id, l_extendedprice + l_linenumber / 100.0 AS score, ['complete', 'edge_5p_truncated', 'internal_partial'][1 + l_linenumber % 3] AS truncation FROM lineitem WHERE l_quantity >= 45),
b AS (SELECT contig_id, arg_max(truncation, score) AS truncation FROM d GROUP BY contig_id), j AS (SELECT gold, coalesce(truncation, 'none') AS x FROM t LEFT JOIN b USING (contig_id) WHERE pos)
SELECT gold AS gold_truncation, count(*) FILTER (x = 'complete') AS complete, count(*) FILTER (x = 'edge_5p_truncated') AS edge_5p_truncated, count(*) FILTER (x = 'internal_partial') AS internal_partial, count(*) FILTER (x = 'none') AS "none" FROM j GROUP BY gold""")
def truncation_confusion(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.concat(F.lit("c"), k).alias("contig_id"), (k % 3 != 0).alias("is_positive"), pick(k, "complete", "edge_5p_truncated", "edge_3p_truncated").alias("gold_truncation"))
    l = table(spark, d, "lineitem").filter("l_quantity >= 45")
    found = l.select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("contig_id"), (F.col("l_extendedprice") + F.col("l_linenumber") / 100.0).alias("composite_score"), pick(F.col("l_linenumber"), "complete", "edge_5p_truncated", "internal_partial").alias("truncation"))
    return evaluation.truncation_confusion(t, found, ["complete", "edge_5p_truncated", "internal_partial"])


@query("""
WITH a AS (SELECT avg(o_totalprice) / 1000000 AS v, count(*) / 100000.0::DOUBLE AS w FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT avg(o_totalprice) / 1000000 AS v, count(*) / 100000.0::DOUBLE AS w FROM orders WHERE o_orderkey % 2 = 1)
SELECT 'v' AS metric, printf('%.4f', b.v) AS value_b, printf('%.4f', a.v) AS value_a, printf('%+.4f', a.v - b.v) AS delta FROM a, b UNION ALL SELECT 'w', printf('%.4f', b.w), printf('%.4f', a.w), printf('%+.4f', a.w - b.w) FROM a, b""")
def compare_methods(spark, d):
    def one(rest):
        return table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == rest).agg((F.avg("o_totalprice") / 1000000).alias("v"), (F.count(F.lit(1)) / 100000.0).alias("w"))

    return evaluation.compare_methods(one(0), one(1), ["v", "w"])


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[9:16], lambda x: CAST(x AS DOUBLE)) AS b, 100.0::DOUBLE AS n, CAST(1 + vec_id % 50 AS DOUBLE) AS m FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: (a[i] * n + b[i] * m) / (n + m))), 6) AS total, ['f0', 'f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7'][list_position(a, list_max(a))] AS family, round(list_max(a), 6) AS probability FROM v""")
def windowed_embeddings(spark, d):
    """Length-weighted mean of two windows' vectors, and the family of the largest probability."""
    e = F.col("embedding").cast("array<double>")
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.slice(e, 1, 8).alias("a"), F.slice(e, 9, 8).alias("b"), F.array(F.lit(100.0), (F.col("vec_id") % 50 + 1).cast("double")).alias("n"))
    best = learning.top_family(F.col("a"), [f"f{i}" for i in range(8)])
    mean = learning.windowed_mean(F.array("a", "b"), F.col("n"))
    return v.select("vec_id", r(F.aggregate(mean, F.lit(0.0), lambda x, y: x + y)).alias("total"), best["family"].alias("family"), r(best["probability"]).alias("probability"))


@query(f"""
WITH p AS (SELECT doc_id, source AS family, upper({SQL_PROTEIN}) AS s FROM documents WHERE source IS NOT NULL), big AS (SELECT family FROM p GROUP BY family HAVING count(*) >= 3),
w AS (SELECT family, substr(s, i, 3) AS word FROM p, LATERAL (SELECT unnest(range(1, length(s) - 1)) AS i) WHERE length(s) >= 3), c AS (SELECT family, word, count(*) AS n FROM w GROUP BY ALL),
o AS (SELECT word, sum(n) AS a FROM c GROUP BY word), z AS (SELECT family, sum(n) AS fn FROM c GROUP BY family), t AS (SELECT sum(a) AS total, count(*) AS words FROM o)
SELECT family, word, round(log2(((n + 1) / (fn + words)) / ((a + 1) / (total + words))), 6) AS weight FROM c JOIN big USING (family) JOIN o USING (word) JOIN z USING (family) CROSS JOIN t""")
def family_profiles(spark, d):
    p = texts(spark, d).filter("source IS NOT NULL").select("doc_id", F.col("source").alias("family"), protein(F.col("text")).alias("s"))
    return models.family_profiles(p, "family", "s").select("family", "word", r("weight").alias("weight"))


@query()
def hidden_layer_fit(spark, d):
    """Scores of all vectors by a network fitted to a bounded sample of them."""
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").withColumn("y", (F.col("label") < 5).cast("int"))
    net = models.fit_hidden_layer(v, "embedding", "y", "vec_id", 2_000, hidden=32, rounds=8)
    return models.score_vectors(v, "embedding", net, 64).select("vec_id", "y", r("score", 3).alias("score"))


@query(f"""WITH {SQL_INTERVALS} SELECT 'element_' || lpad(CAST(i AS VARCHAR), 8, '0') AS element_id FROM range(1, (SELECT count(*) + 1 FROM iv)) t(i)""")
def stream_numbered(spark, d):
    """Running element numbers over a stream of batches: dense, whatever the batches."""
    from mobilome.storage import shared_dir
    from mobilome.streaming.scans import numbered

    root = f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/numbered-{uuid.uuid4().hex}"
    source = event_intervals(spark, d)
    source.repartition(4, "user_id").write.parquet(f"{root}/in")
    numbered(spark, f"{root}/in", source.schema, lambda b: b, ["user_id", "start", "event_id"], "element_%08d", f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.option("basePath", f"{root}/out/rows").parquet(f"{root}/out/rows").select("element_id")


@query("""
WITH c AS (SELECT o_custkey % 50 AS cluster, o_orderkey AS id, o_orderstatus AS family FROM orders), s AS (SELECT cluster, count(*) AS cluster_size FROM c GROUP BY 1),
p AS (SELECT c.*, cluster_size, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % CAST(ceil(cluster_size / 100) AS BIGINT) AS part FROM c JOIN s USING (cluster))
SELECT CAST(cluster AS BIGINT) AS cluster, part, max(cluster_size) AS cluster_size, array_to_string(list_sort(list(id)), ',') AS ids, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM p GROUP BY cluster, part""")
def cluster_lists(spark, d):
    """Ids and families of every cluster, in lists of bounded length."""
    c = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("family"))
    found = datasets.cluster_lists(c, "cluster", "id", "family", 100)
    return found.select(F.col("cluster").cast("long").alias("cluster"), "part", "cluster_size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join("families", ",").alias("families"))


@query("""
WITH v AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)
SELECT vec_id AS seq_id, label, CAST(i AS BIGINT) AS embedding_idx, round(CAST(embedding[1] AS DOUBLE), 4) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 4) AS last FROM v WHERE vec_id % 3 <> 0""")
def embedding_metadata(spark, d):
    """Rows of a matrix, known by their place, met with the metadata of the sequences that an index names."""
    from mobilome.sources import artifacts

    v = datasets.ranked(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), [F.col("vec_id")], "place")
    matrix = v.select((F.col("place") - 1).alias("row"), F.col("embedding").alias("vector"))
    index = v.select(F.col("vec_id").alias("seq_id"), (F.col("place") - 1).cast("long").alias("embedding_idx"))
    metadata = v.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("seq_id"), "label")
    met = artifacts.with_metadata(matrix, index, metadata).join(index.withColumnRenamed("seq_id", "s"), F.col("seq_id") == F.col("s"))
    ends = [F.round(F.element_at("vector", at).cast("double"), 4).alias(n) for at, n in ((1, "first"), (-1, "last"))]
    return met.select("seq_id", "label", "embedding_idx", *ends)


@query()
def hidden_layer_cluster(spark, d):
    """Scores of all vectors by a network that is fitted to all of them in the cluster; tests hold it to one machine's weights."""
    from mobilome.operators import training

    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").withColumn("y", (F.col("label") < 5).cast("int"))
    net = training.fit_hidden_layer(v, "embedding", "y", "vec_id", rounds=3, batches=4, hidden=32, rate=0.01)
    return models.score_vectors(v, "embedding", net, 64).select("vec_id", "y", r("score", 3).alias("score"))
