"""Registered queries: every operator family over the general tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilome.functions import decisions as D
from mobilome.functions import sequence as S
from mobilome.operators import boundaries, datasets, evaluation, intervals, learning, metrics, scan, similarity
from mobilome.operators import hits as H
from mobilome.operators.components import connected_components
from mobilome.plans.derived import (
    SQL_CONTIGS, SQL_DNA, SQL_EVIDENCE, SQL_HITS, SQL_INTERVALS, SQL_PROTEIN, SQL_SCORED,
    contigs, dna, evidence, hits, protein, scored, table, texts,
)
from mobilome.plans.derived import intervals as event_intervals
from mobilome.storage import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c, places: int = 6):
    return F.round(c, places)


# --- exact groups and datasets ------------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    return datasets.exact_groups(docs, F.sha2("text", 256), "lang", [F.col("source").isNull(), F.length("text")], "doc_id")


@query("""
SELECT doc_id, sha256(coalesce(text, '')) AS sequence_key, count(*) OVER w AS group_size,
       first_value(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY source IS NULL, length(coalesce(text, '')), doc_id) AS representative,
       coalesce(min(lang) OVER w <> max(lang) OVER w, false) AS annotation_conflict
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))""")
def exact_dedup_documents(spark, d):
    return _groups(spark, d).select("doc_id", "sequence_key", "group_size", "representative", "annotation_conflict")


@query("""
SELECT sha256(coalesce(text, '')) AS sequence_key, count(*) AS group_size, min(doc_id) AS least_id, min(lang) <> max(lang) AS annotation_conflict
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_conflict_groups(spark, d):
    g = _groups(spark, d).filter("group_size > 1")
    return g.groupBy("sequence_key", "group_size", "annotation_conflict").agg(F.min("doc_id").alias("least_id"))


@query("""
SELECT 'tpase_' || lpad(CAST(row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS VARCHAR), 6, '0') AS tpase_id, doc_id FROM documents""")
def numbered_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return datasets.numbered(docs, [F.col("lang"), F.col("doc_id")], "tpase_%06d", "tpase_id").select("tpase_id", "doc_id")


@query("""
SELECT d.doc_id, CAST(coalesce(l.quality, 0) AS INT) AS quality, CAST(coalesce(l.toxic, 0) AS INT) AS toxic, l.doc_id IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_default_scores(spark, d):
    docs, l = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "lid")
    return docs.join(l, F.col("doc_id") == F.col("lid"), "left").select(
        "doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("lid").isNotNull().alias("labelled")
    )


@query("""
WITH s AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN rk <= round_even(n * 0.7, 0) THEN 'train' WHEN rk <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM s""")
def stratified_split(spark, d):
    return datasets.stratified_split(table(spark, d, "documents"), "lang", "doc_id").select("doc_id", "lang", "split")


def _negatives_sql(positives: str, target: int = 100, width: int = 50, offsets=(0, -1, 1, -2, 2)) -> str:
    """All three strata; a bin's wants go to its neighbours one offset after the other, then the rest is filled."""
    matched = int(0.3 * target)
    rounds, used, need = [], "u0", "w0"
    for i, o in enumerate(offsets):
        rounds.append(f"""g{i} AS (SELECT w.bin AS home, w.want, u.bin, least(w.want, coalesce(u.n - u.used, 0)) AS got FROM {need} w LEFT JOIN {used} u ON u.bin = w.bin + {o}),
u{i + 1} AS (SELECT u.bin, u.n, u.used + coalesce(g.got, 0) AS used FROM {used} u LEFT JOIN g{i} g ON g.bin = u.bin), w{i + 1} AS (SELECT home AS bin, want - got AS want FROM g{i})""")
        used, need = f"u{i + 1}", f"w{i + 1}"
    return f"""
WITH pool AS (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'easy' ELSE 'general' END AS kind, md5('42:' || CAST(doc_id AS VARCHAR)) AS h, n_chars // {width} AS bin FROM documents),
pos AS (SELECT n_chars // {width} AS bin, count(*) AS p FROM {positives} GROUP BY 1), q AS (SELECT *, p * {matched} / sum(p) OVER () AS x FROM pos),
q2 AS (SELECT *, CAST(floor(x) AS BIGINT) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, bin) AS turn FROM q), w0 AS (SELECT bin, CAST(f + CASE WHEN turn <= {matched} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS want FROM q2),
u0 AS (SELECT bin, count(*) AS n, 0::BIGINT AS used FROM pool WHERE kind = 'general' GROUP BY bin), {", ".join(rounds)},
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.kind, p.bin ORDER BY h, doc_id) AS rk FROM pool p WHERE kind = 'general'),
m AS (SELECT r.*, rk <= coalesce(u.used, 0) AS taken FROM r LEFT JOIN {used} u ON u.bin = r.bin),
filled AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY h, doc_id) AS k FROM m WHERE NOT taken)
SELECT doc_id, n_chars, 'length_matched' AS negative_type FROM m WHERE taken
UNION ALL SELECT doc_id, n_chars, 'length_matched' FROM filled WHERE k <= {matched} - (SELECT count(*) FROM m WHERE taken)
UNION ALL SELECT doc_id, n_chars, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, doc_id) AS k FROM pool WHERE kind <> 'general')
WHERE k <= CASE kind WHEN 'hard' THEN {int(0.5 * target)} ELSE {target - int(0.5 * target) - matched} END"""


def _negative_pool(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "hard").when(F.col("doc_id") % 3 == 1, "easy").otherwise("general")
    return table(spark, d, "documents").select("doc_id", "n_chars").withColumn("kind", kind)


@query(_negatives_sql("(SELECT length(text) AS n_chars FROM benchmark)"))
def negatives_quota(spark, d):
    positives = table(spark, d, "benchmark").select(F.length("text").alias("n_chars"))
    return datasets.sample_negatives(_negative_pool(spark, d), positives, 100, "doc_id", "kind", "n_chars").select("doc_id", "n_chars", "negative_type")


@query(_negatives_sql("(SELECT n_chars FROM pool WHERE kind = 'easy')"))
def negatives_length_matched(spark, d):
    pool = _negative_pool(spark, d)
    return datasets.sample_negatives(pool, pool.filter("kind = 'easy'").select("n_chars"), 100, "doc_id", "kind", "n_chars").select("doc_id", "n_chars", "negative_type")


@query("""
WITH f AS (SELECT unnest(range(10)) AS fold), v AS (SELECT vec_id, label, vec_id % 4 = 0 AS neg, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM embeddings)
SELECT vec_id, CAST(fold AS INT) AS fold, CASE WHEN label = fold THEN 'test' ELSE split END AS role FROM v CROSS JOIN f
WHERE label = fold OR split <> 'test' OR (neg AND split = 'test')""")
def lofo_folds(spark, d):
    v = table(spark, d, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 4 != 0).cast("int").alias("y"), F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "val").otherwise("train").alias("split")
    )
    return datasets.leave_one_out_folds(v, "label", "y", "split", range(10)).select("vec_id", "fold", "role")


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: Clusters of whole texts: five-word grams, identity at least 0.3, both coverages at least 0.8; equal words are one class.
_CLUSTERED = f"""
WITH RECURSIVE q AS (SELECT doc_id AS id, array_to_string(w, ' ') AS plain, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
e AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM q),
p AS (SELECT a.id AS x, b.id AS y, a.n AS xn, b.n AS yn, count(*) AS shared FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL),
k AS (SELECT x, y FROM p WHERE shared / least(xn, yn) >= 0.3 AND shared / greatest(xn, yn) >= 0.8 UNION SELECT min(id) OVER (PARTITION BY plain), id FROM q),
both_ways AS (SELECT x, y FROM k WHERE x <> y UNION SELECT y, x FROM k WHERE x <> y),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x)"""


def _text_edges(spark, d):
    return similarity.similar_text_edges(texts(spark, d).select(F.col("doc_id").alias("id"), "text"))


@query(f"{_CLUSTERED} SELECT doc_id, root AS component FROM c")
def components_documents(spark, d):
    stars = connected_components(_text_edges(spark, d))
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(stars, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def _similar(spark, d):
    """Clusters of whole texts by word grams."""
    return datasets.cluster_table(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), _text_edges(spark, d), "doc_id", "n_chars")


@query(f"""{_CLUSTERED},
k2 AS (SELECT root, count(*) AS size, min(lang) <> max(lang) AS mixed FROM c JOIN documents USING (doc_id) GROUP BY root)
SELECT CAST(sum(size) AS BIGINT) AS n_sequences, count(*) AS n_clusters, CAST(count(*) FILTER (size = 1) AS BIGINT) AS n_singletons,
       round(count(*) FILTER (size = 1) / count(*), 6) AS singleton_fraction, list_sort(list(size))[count(*) // 2 + 1] AS median_size, max(size) AS max_size,
       CAST(count(*) FILTER (mixed) AS BIGINT) AS n_mixed FROM k2""")
def cluster_statistics(spark, d):
    return datasets.cluster_statistics(_similar(spark, d), "cluster_id", "lang").withColumn("singleton_fraction", r("singleton_fraction"))


def _split_sql(members: str) -> str:
    """Clusters (doc_id, cluster_id, stratum) dealt one by one, each to the split with the least price."""
    return f"""
mem AS ({members}),
st AS (SELECT list(stratum ORDER BY stratum) AS names, list(n ORDER BY stratum) AS total FROM (SELECT stratum, count(*) AS n FROM mem GROUP BY stratum)),
kn AS (SELECT cluster_id, stratum, count(*) AS n FROM mem GROUP BY ALL),
kd AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS size, string_agg(stratum || ':' || n, ',' ORDER BY stratum) AS signature, map_from_entries(list((stratum, n))) AS m FROM kn GROUP BY cluster_id),
od AS (SELECT cluster_id, size, signature, list_transform(names, lambda s: coalesce(m[s], 0)) AS v,
       row_number() OVER (ORDER BY size DESC, md5('42:' || signature), signature, cluster_id) AS i FROM kd CROSS JOIN st),
al AS (SELECT CAST(sum(size) AS DOUBLE) AS whole FROM od),
gr AS (SELECT CAST(0 AS BIGINT) AS i, [0.0::DOUBLE, 0, 0] AS filled, [list_transform(names, lambda s: 0.0::DOUBLE), list_transform(names, lambda s: 0.0::DOUBLE), list_transform(names, lambda s: 0.0::DOUBLE)] AS held, CAST(0 AS BIGINT) AS pick FROM st
  UNION ALL
  SELECT i, list_transform(range(1, 4), lambda k: filled[k] + CASE WHEN k = best THEN size ELSE 0 END),
    list_transform(range(1, 4), lambda k: list_transform(range(1, len(v) + 1), lambda j: held[k][j] + CASE WHEN k = best THEN v[j] ELSE 0 END)), best
  FROM (SELECT *, CAST(list_position(price, list_min(price)) AS BIGINT) AS best FROM (
    SELECT od.i, gr.filled, gr.held, od.size, od.v, list_transform([0.7::DOUBLE, 0.15, 0.15], lambda x, k: (gr.filled[k] + od.size) / (x * al.whole + 1e-5)
      + 0.5 * list_reduce(list_prepend(0.0::DOUBLE, list_transform(od.v, lambda n, j: n * greatest(0.0, (gr.held[k][j] - x * st.total[j]) / (x * st.total[j] + 1)))), lambda a, b: a + b)) AS price
    FROM gr JOIN od ON od.i = gr.i + 1 CROSS JOIN al CROSS JOIN st))),
tk AS (SELECT signature, count(*) FILTER (pick = 1) AS tr, count(*) FILTER (pick = 2) AS va FROM gr JOIN od USING (i) GROUP BY signature),
pl AS (SELECT cluster_id, signature, row_number() OVER (PARTITION BY signature ORDER BY md5('42:' || cluster_id), cluster_id) AS rn FROM od)
SELECT doc_id, cluster_id, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + va THEN 'val' ELSE 'test' END AS split FROM mem JOIN pl USING (cluster_id) JOIN tk USING (signature)"""


@query(_CLUSTERED + "," + _split_sql("""
  SELECT doc_id, coalesce(lang, '') AS stratum, cluster_id FROM c JOIN documents USING (doc_id) JOIN (
    SELECT root, 'cluster30_' || lpad(CAST(row_number() OVER (ORDER BY size DESC, rep) AS VARCHAR), 6, '0') AS cluster_id FROM (
      SELECT root, count(*) AS size, arg_max(doc_id, n_chars * 1000000000000 + doc_id) AS rep FROM c JOIN documents USING (doc_id) GROUP BY root)) USING (root)"""))
def cluster_split(spark, d):
    return datasets.cluster_split(_similar(spark, d), "cluster_id", "lang").select("doc_id", "cluster_id", "split")


@query("WITH RECURSIVE " + _split_sql("SELECT l_orderkey * 10 + l_linenumber AS doc_id, CAST(l_suppkey * 10 + l_linenumber AS VARCHAR) AS cluster_id, l_returnflag AS stratum FROM lineitem WHERE l_returnflag <> 'N'"))
def negative_split(spark, d):
    """Negatives by type: returned lines, whose lines of one supplier and number stay together."""
    l = table(spark, d, "lineitem").filter("l_returnflag <> 'N'")
    named = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string").alias("cluster_id"), F.col("l_returnflag").alias("kind"))
    return datasets.cluster_split(named, "cluster_id", "kind").select("doc_id", "cluster_id", "split")


@query(f"""{_CLUSTERED},
m AS (SELECT c.root, d.doc_id, d.n_chars, d.source FROM c JOIN documents d USING (doc_id)),
s AS (SELECT root, count(*) AS size, arg_max(doc_id, n_chars * 1000000000000 + doc_id) AS rep, min(n_chars) AS min_length, max(n_chars) AS max_length FROM m GROUP BY root),
named AS (SELECT *, 'cluster30_' || lpad(CAST(row_number() OVER (ORDER BY size DESC, rep) AS VARCHAR), 6, '0') AS cluster_id FROM s),
f AS (SELECT root, source, count(*) AS k FROM m GROUP BY root, source),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY k DESC, source NULLS FIRST) AS rn FROM f),
t AS (SELECT root, count(*) AS n_families, max(k) AS top_k, string_agg(concat_ws(':', source, CAST(k AS VARCHAR)), ', ' ORDER BY rn) FILTER (rn <= 4) AS families FROM o GROUP BY root)
SELECT cluster_id, size, min_length, max_length, n_families, families, round(top_k / size, 6) AS top_share,
  CASE WHEN n_families = 1 THEN 'low' WHEN top_k / size >= 0.95 THEN 'moderate' ELSE 'high' END AS risk
FROM named JOIN t USING (root) ORDER BY size DESC, cluster_id LIMIT 20""")
def family_purity(spark, d):
    return datasets.family_purity(_similar(spark, d), "cluster_id", "source", "n_chars").withColumn("top_share", r("top_share"))


# --- hits ---------------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def best_hit_per_order(spark, d):
    l = table(spark, d, "lineitem")
    return H.best_hit(l, "l_orderkey", [F.col("l_extendedprice"), F.col("l_discount"), -F.col("l_linenumber")], ["l_linenumber", "l_partkey", "l_extendedprice"])


@query(f"""
WITH {SQL_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, line_no) AS rn FROM hits)
SELECT p_partkey AS seq_id, coalesce(bits, 0.0) AS score, coalesce(CAST(target AS VARCHAR), 'None') AS target_id, round(coalesce(fident * 100, 0.0), 6) AS pident,
       round(coalesce(qcov * 100, 0.0), 6) AS coverage, coalesce(evalue, 999.0) AS evalue
FROM part LEFT JOIN (SELECT * FROM b WHERE rn = 1) ON p_partkey = query""")
def tool_predictions(spark, d):
    queries = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"))
    h = hits(spark, d).withColumn("target", F.col("target").cast("string"))
    return H.predictions(queries, h).withColumns({"pident": r("pident"), "coverage": r("coverage")})


@query(f"""
WITH {SQL_HITS}, x AS (SELECT *, qcov >= 0.8 AND tcov >= 0.8 AS fl FROM hits),
a AS (
  SELECT query, first(target ORDER BY fident DESC, bits DESC, line_no) AS it, first(fident ORDER BY fident DESC, bits DESC, line_no) AS fi, first(qcov ORDER BY fident DESC, bits DESC, line_no) AS fq, first(tcov ORDER BY fident DESC, bits DESC, line_no) AS ft,
         first(target ORDER BY bits DESC, fident DESC, line_no) AS bt, first(fident ORDER BY bits DESC, fident DESC, line_no) AS bi
  FROM x WHERE fl GROUP BY query),
b AS (SELECT query, max(fident) AS best_local FROM x GROUP BY query)
SELECT p_partkey AS seq_id, CASE WHEN fi >= 0.999 AND fq >= 0.999 AND ft >= 0.999 THEN 'L1_EXACT' WHEN fi >= 0.3 THEN 'L2_CLOSE' WHEN fi < 0.2 THEN 'REMOTE_20_STRICT' WHEN fi IS NOT NULL THEN 'REMOTE_30_STRICT'
       WHEN best_local >= 0.3 THEN 'L3_DOMAIN_ONLY' ELSE 'NO_FULL_LENGTH_HOMOLOG' END AS homology_class,
       coalesce(it, -1) AS identity_target, fi AS max_identity, coalesce(bt, -1) AS bits_target, bi AS bits_identity, best_local AS best_local_identity
FROM part LEFT JOIN a ON p_partkey = a.query LEFT JOIN b ON p_partkey = b.query""")
def two_argmax_audit(spark, d):
    out = H.homology_classes(table(spark, d, "part").select(F.col("p_partkey").alias("seq_id")), hits(spark, d))
    return out.fillna(-1, ["identity_target", "bits_target"])


@query(f"""
WITH {SQL_HITS}
SELECT 'either' AS rule, count(*) FILTER (v) AS violations, count(DISTINCT query) FILTER (v) AS leaked_queries, max(fident) AS max_identity, count(*) FILTER (v) = 0 AS passed
FROM (SELECT *, fident > 0.3 AND greatest(qcov, tcov) >= 0.8 AS v FROM hits)
UNION ALL SELECT 'both', count(*) FILTER (v), count(DISTINCT query) FILTER (v), max(fident), count(*) FILTER (v) = 0 FROM (SELECT *, fident >= 0.3 AND qcov >= 0.8 AND tcov >= 0.8 AS v FROM hits)
UNION ALL SELECT 'ambiguous', count(*) FILTER (v), count(DISTINCT query) FILTER (v), max(fident), count(*) FILTER (v) = 0 FROM (SELECT *, fident >= 0.25 AND (qcov >= 0.5 OR tcov >= 0.5) AS v FROM hits)""")
def leakage_rules(spark, d):
    parts = [H.leakage_summary(hits(spark, d), rule).select(F.lit(rule).alias("rule"), "*") for rule in ("either", "both", "ambiguous")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""
WITH {SQL_HITS}
SELECT s AS scheme, count(*) AS edges FROM (
  SELECT unnest(list_filter([CASE WHEN fident > 0.3 AND greatest(qcov, tcov) >= 0.8 THEN 'A' END, CASE WHEN fident >= 0.3 AND qcov >= 0.8 AND tcov >= 0.8 THEN 'B' END,
    CASE WHEN fident >= 0.3 AND qcov >= 0.8 AND tcov >= 0.5 THEN 'C' END, CASE WHEN fident >= 0.3 AND qcov >= 0.8 AND tcov >= 0.8 THEN 'D' END, CASE WHEN fident >= 0.3 AND tcov >= 0.8 THEN 'E' END], lambda x: x IS NOT NULL)) AS s
  FROM hits WHERE query <> target) GROUP BY s""")
def cluster_schemes(spark, d):
    return H.scheme_edges(hits(spark, d)).groupBy("scheme").agg(F.count(F.lit(1)).alias("edges"))


_GRAMS = """
  SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 8 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END) AS g FROM"""


@query(f"""
WITH q AS ({_GRAMS} (SELECT doc_id AS id, {_WORDS} AS w FROM documents)), t AS ({_GRAMS} (SELECT item_id AS id, {_WORDS} AS w FROM benchmark)),
qe AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM q), te AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM t),
p AS (SELECT qe.id AS query, te.id AS target, qe.n AS qn, te.n AS tn, count(*) AS shared FROM qe JOIN te ON qe.gram = te.gram GROUP BY ALL)
SELECT query, target, shared, round(shared / least(qn, tn), 6) AS fident, round(shared / qn, 6) AS qcov, round(shared / tn, 6) AS tcov FROM p""")
def contamination_audit(spark, d):
    q = texts(spark, d).select(F.col("doc_id").alias("id"), "text")
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.gram_hits(q, t, 8).select("query", "target", "shared", r("fident").alias("fident"), r("qcov").alias("qcov"), r("tcov").alias("tcov"))


# --- metrics ------------------------------------------------------------------------------------------------------

_CURVE = f"""{SQL_SCORED}, steps AS (SELECT score AS t, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scored WHERE y IS NOT NULL GROUP BY score),
curve AS (SELECT *, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM steps),
c AS (SELECT *, tp / (tp + fp) AS p, tp / np AS r, fp / (tp + fp) AS f FROM curve)"""


def _labelled(spark, d):
    return scored(spark, d).filter("y IS NOT NULL")


@query(f"""
WITH {_CURVE}, m AS (SELECT t, r, f FROM c WHERE f <= 0.14 ORDER BY r DESC, t DESC LIMIT 1),
b AS (SELECT *, max(CASE WHEN f > 0.14 THEN 1 ELSE 0 END) OVER (ORDER BY t DESC) AS broken FROM c), k AS (SELECT t, r, f FROM b WHERE broken = 0 ORDER BY r DESC, t DESC LIMIT 1)
SELECT 'max_recall' AS variant, round(coalesce((SELECT t FROM m), 'Infinity'::DOUBLE), 6) AS threshold, round(coalesce((SELECT r FROM m), 0), 6) AS recall, round(coalesce((SELECT f FROM m), 0), 6) AS fdr
UNION ALL SELECT 'max_recall_or_top', round(coalesce((SELECT t FROM m), (SELECT max(t) FROM c)), 6), round(coalesce((SELECT r FROM m), 0), 6), round(coalesce((SELECT f FROM m), 0), 6)
UNION ALL SELECT 'first_break', round(coalesce((SELECT t FROM k), (SELECT max(t) FROM c)), 6), round(coalesce((SELECT r FROM k), 0), 6), round(coalesce((SELECT f FROM k), 0), 6)""")
def fdr_threshold(spark, d):
    rows = _labelled(spark, d)
    known = metrics.written_curve(rows, "y", "score")
    parts = [
        metrics.fdr_threshold(rows, "y", "score", 0.14, v, known).select(F.lit(v).alias("variant"), r("threshold").alias("threshold"), r("recall").alias("recall"), r("fdr").alias("fdr"))
        for v in ("max_recall", "max_recall_or_top", "first_break")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {_CURVE} SELECT round(sum(p * pos / np), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(_labelled(spark, d), "y", "score").select(r("average_precision").alias("average_precision"))


@query(f"""
WITH {_CURVE} SELECT round(sum(area), 6) AS pr_auc FROM (
  SELECT (r - coalesce(lag(r) OVER (ORDER BY t DESC), 0)) * (p + coalesce(lag(p) OVER (ORDER BY t DESC), 1)) / 2 AS area FROM c)""")
def pr_auc(spark, d):
    return metrics.pr_auc(_labelled(spark, d), "y", "score").select(r("pr_auc").alias("pr_auc"))


@query(f"WITH {_CURVE} SELECT round(sum(pos * (nn - fp + neg / 2)) / max(np * nn), 6) AS auroc FROM c")
def auroc(spark, d):
    return metrics.auroc(_labelled(spark, d), "y", "score").select(r("auroc").alias("auroc"))


_RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(fp / nullif(tp + fp, 0), 0), 6) AS fdr, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""


def _rounded(df):
    return df.select("*", *[r(c).alias(f"_{c}") for c in ("precision", "recall", "f1", "fdr", "specificity", "mcc")]).drop(
        "precision", "recall", "f1", "fdr", "specificity", "mcc"
    ).withColumnsRenamed({f"_{c}": c for c in ("precision", "recall", "f1", "fdr", "specificity", "mcc")})


@query(f"""
WITH {SQL_SCORED}, k AS (SELECT lang, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y <> 1 AND score >= 0.5) AS fp, count(*) FILTER (y <> 1 AND score < 0.5) AS tn,
  count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM scored WHERE y IS NOT NULL GROUP BY lang) SELECT lang, tp, fp, tn, fn, {_RATES} FROM k""")
def binary_metrics(spark, d):
    return _rounded(metrics.confusion(_labelled(spark, d), "y", "score", F.lit(0.5), ("lang",)))


@query(f"""
WITH {SQL_SCORED}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (score >= 0.5) AS found FROM scored WHERE y = 1 GROUP BY lang)
SELECT lang, n, found, round(found / n, 6) AS recall, round(avg(found / n) OVER (), 6) AS macro_recall FROM g""")
def family_recall(spark, d):
    g = metrics.group_recall(_labelled(spark, d), "y", "score", "lang", F.lit(0.5))
    return g.select("lang", "n", "found", r("recall").alias("recall"), r(F.avg("recall").over(Window.partitionBy(F.lit(0)))).alias("macro_recall"))


_BINS = [("0-500", 0, 500), ("500-1500", 500, 1500), ("1500-4000", 1500, 4000), ("4000-12000", 4000, 12000), ("12000+", 12000, 1e12), ("none", -2, -1)]


@query(f"""
WITH {SQL_SCORED}, b(bin, lo, hi) AS (VALUES {", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in _BINS)})
SELECT bin, count(doc_id) AS n, count(doc_id) FILTER (score >= 0.5) AS found, round(coalesce(count(doc_id) FILTER (score >= 0.5) / nullif(count(doc_id), 0), 0), 6) AS recall
FROM b LEFT JOIN (SELECT * FROM scored WHERE y = 1) s ON n_chars >= lo AND n_chars < hi GROUP BY bin""")
def stratified_recall(spark, d):
    out = metrics.binned_recall(_labelled(spark, d), "y", "score", "n_chars", [(n, float(a), float(b)) for n, a, b in _BINS], F.lit(0.5))
    return out.withColumn("recall", r("recall"))


@query(f"""
WITH {SQL_SCORED}, x AS (SELECT *, unnest(list_filter(['Overall', CASE WHEN y <> 1 OR n_chars < 2000 THEN 'Short' END, CASE WHEN y <> 1 OR toxic = 1 THEN 'Toxic' END], lambda s: s IS NOT NULL)) AS stratum FROM scored WHERE y IS NOT NULL),
k AS (SELECT stratum, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y <> 1 AND score >= 0.5) AS fp, count(*) FILTER (y <> 1 AND score < 0.5) AS tn, count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM x GROUP BY stratum)
SELECT stratum, tp, fp, tn, fn, {_RATES} FROM k""")
def homology_strata(spark, d):
    s = metrics.strata(_labelled(spark, d), {"Overall": F.lit(True), "Short": F.col("n_chars") < 2000, "Toxic": F.col("toxic") == 1}, "y")
    return _rounded(metrics.confusion(s, "y", "score", F.lit(0.5), ("stratum",)))


def _overall_sql() -> str:
    """Areas on odd documents, and their recall at the thresholds fixed on even ones."""
    steps = "SELECT score AS t, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scored WHERE y IS NOT NULL AND doc_id % 2 = {} GROUP BY score"
    curve = "SELECT *, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM {}"
    at = "coalesce((SELECT t FROM v WHERE fp / (tp + fp) <= {} ORDER BY tp / np DESC, t DESC LIMIT 1), 'Infinity'::DOUBLE)"
    parts = [
        f"round({at.format(t)}, 6) AS threshold_{n}, round(coalesce((SELECT count(*) FILTER (score >= {at.format(t)}) / nullif(count(*), 0) FROM scored WHERE y = 1 AND doc_id % 2 = 1), 0), 6) AS recall_{n}"
        for n, t in (("1fdr", 0.01), ("5fdr", 0.05), ("10fdr", 0.10))
    ]
    return f"""WITH {SQL_SCORED}, a AS ({steps.format(0)}), b AS ({steps.format(1)}), v AS ({curve.format("a")}), w AS ({curve.format("b")})
SELECT (SELECT round(sum(pos * (nn - fp + neg / 2)) / max(np * nn), 6) FROM w) AS auroc, (SELECT round(sum(tp / (tp + fp) * pos / np), 6) FROM w) AS average_precision, {", ".join(parts)}"""


@query(_overall_sql())
def overall_metrics(spark, d):
    s = _labelled(spark, d)
    valid, test = s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1")
    out = metrics.overall_metrics(valid, test, "y", "score")
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(f"""
WITH {SQL_SCORED}, u AS (SELECT lang, count(*) FILTER (y = 1) AS n, count(*) FILTER (y = 1 AND score >= 0.5) - count(*) FILTER (y = 1 AND score >= 0.6) AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rk, count(*) OVER () AS k
  FROM scored WHERE y IS NOT NULL GROUP BY lang),
t AS (SELECT max(k) AS k FROM u), dr AS (
  SELECT r, CAST('0x' || substr(md5('42:' || r || ':' || i), 1, 12) AS BIGINT) % k AS pick FROM (SELECT unnest(range(200)) AS r) CROSS JOIN t CROSS JOIN LATERAL (SELECT unnest(range(1, k + 1)) AS i)),
v AS (SELECT r, sum(g) / sum(n) AS value FROM dr JOIN u ON pick = rk GROUP BY r HAVING sum(n) > 0)
SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v""")
def bootstrap_ci(spark, d):
    s = _labelled(spark, d)
    out = metrics.bootstrap_recall(s, "y", "lang", F.col("score") >= 0.5, 200, "42", F.col("score") >= 0.6)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("""
SELECT event_type, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM events JOIN orders ON event_id = o_orderkey GROUP BY event_type""")
def confusion_pivot(spark, d):
    joined = table(spark, d, "events").join(table(spark, d, "orders"), F.col("event_id") == F.col("o_orderkey"))
    return joined.groupBy("event_type").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("""
SELECT k.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) k(status) LEFT JOIN orders ON o_orderstatus = k.status GROUP BY k.status""")
def enum_zero_fill(spark, d):
    keys = spark.createDataFrame([(k,) for k in "FOPX"], "status string")
    counts = table(spark, d, "orders").groupBy("o_orderstatus").count()
    return keys.join(counts, F.col("status") == F.col("o_orderstatus"), "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


# --- intervals ----------------------------------------------------------------------------------------------------

_ISLANDS = f"""{SQL_INTERVALS}, g AS (
  SELECT *, CASE WHEN "start" - lag("end") OVER w <= 250 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", event_id) AS island FROM g)"""


@query(f"WITH {_ISLANDS} SELECT event_id, user_id, CAST(island AS BIGINT) AS island FROM i")
def event_islands(spark, d):
    return intervals.islands(event_intervals(spark, d), "user_id", "start", "end", "event_type", 250, ("event_id",)).select("event_id", "user_id", "island")


@query(f"""
WITH {_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, min("start") AS "start", arg_max("end", "start" * 100000000 + event_id) AS "end", count(*) AS n_genes,
  first(event_id ORDER BY score DESC, "start", event_id) AS primary_gene, round(max(score), 6) AS score, first(event_type ORDER BY "start", event_id) AS event_type FROM i GROUP BY user_id, island""")
def island_reduction(spark, d):
    i = intervals.islands(event_intervals(spark, d), "user_id", "start", "end", "event_type", 250, ("event_id",)).withColumn("ev", F.lit(0.0))
    out = intervals.reduce_islands(i, "user_id", "start", "end", "event_id", "score", "ev", ("event_type",), "best", ("event_id",))
    return out.select("user_id", "island", "start", "end", "n_genes", "primary_gene", r("score").alias("score"), "event_type")


@query(f"""
WITH RECURSIVE {SQL_INTERVALS}, o AS (SELECT *, CAST(event_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY "start", CAST(event_id AS VARCHAR)) AS n FROM iv),
f AS (
  SELECT user_id, n, "start" AS s, "end" AS e, score AS v, key AS k, 1 AS slot FROM o WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.n, CASE WHEN clash AND o.score <= f.v THEN f.s ELSE o."start" END, CASE WHEN clash AND o.score <= f.v THEN f.e ELSE o."end" END,
         CASE WHEN clash AND o.score <= f.v THEN f.v ELSE o.score END, CASE WHEN clash AND o.score <= f.v THEN f.k ELSE o.key END, CASE WHEN clash THEN f.slot ELSE f.slot + 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1
  CROSS JOIN LATERAL (SELECT least(f.e, o."end") - greatest(f.s, o."start") > 0.5 * least(f.e - f.s, o."end" - o."start") AS clash))
SELECT user_id, arg_max(k, n) AS key FROM f GROUP BY user_id, slot""")
def overlap_fold(spark, d):
    return intervals.resolve_overlaps(event_intervals(spark, d), "user_id", "start", "end", "score", "event_id").select("user_id", "key")


@query(f"""
WITH {SQL_INTERVALS}, p AS (SELECT * FROM iv WHERE event_type = 'click'), t AS (SELECT * FROM iv WHERE event_type = 'view'),
m AS (SELECT p.event_id AS pred_id, t.event_id AS truth_id, t."start" AS ts, (least(p."end", t."end") - greatest(p."start", t."start")) / greatest(p."end" - p."start", t."end" - t."start") AS ov
  FROM p JOIN t ON p.user_id = t.user_id AND p."start" < t."end" AND t."start" < p."end")
SELECT pred_id, truth_id, round(ov, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY ov DESC, ts, truth_id) AS rn FROM m) WHERE rn = 1 AND ov >= 0.4""")
def interval_best_match(spark, d):
    iv = event_intervals(spark, d).withColumnRenamed("event_id", "id")
    out = intervals.overlap_matches(iv.filter("event_type = 'click'"), iv.filter("event_type = 'view'"), 720, 0.4, "user_id")
    return out.withColumn("overlap", r("overlap"))


# --- decisions ----------------------------------------------------------------------------------------------------

def _strong():
    return D.strong_homology(F.col("ev"), F.col("ident"), F.col("cov"), F.col("hev"))


_ROUTE = """CASE WHEN p < 0.35 AND strong THEN 'UNCERTAIN' WHEN p < 0.35 THEN 'REJECT' WHEN p >= 0.70 AND strong THEN 'ACCEPT_KNOWN' WHEN p >= 0.70 THEN 'STAGE2A' ELSE 'UNCERTAIN' END"""


@query(f"""
WITH {SQL_EVIDENCE}, x AS (SELECT *, {_ROUTE} AS route FROM strong)
SELECT okey, strong, CASE WHEN p >= 0.5 THEN 'Uncertain' ELSE 'Negative' END AS stage1, route,
  CASE WHEN p < 0.35 AND strong THEN 'conflict' WHEN p < 0.35 THEN 'low_score' WHEN p >= 0.70 AND strong THEN 'strong_homology' WHEN p >= 0.70 THEN 'no_strong_homology' ELSE 'intermediate' END AS reason,
  CASE WHEN fast IS NULL THEN route WHEN fast >= 0.7 OR sim >= 0.7 THEN 'STAGE2A' WHEN fast < 0.35 AND sim < 0.35 THEN 'REJECT' ELSE 'STAGE2B' END AS rescue FROM x""")
def router_policy(spark, d):
    e = evidence(spark, d).withColumn("strong", _strong()).withColumn("x", D.route(F.col("p"), F.col("strong")))
    return e.select(
        "okey", "strong", D.stage1_category(F.col("p"), F.lit(0.5)).alias("stage1"), F.col("x.route").alias("route"), F.col("x.reason").alias("reason"),
        D.rescue_route(F.col("x.route"), F.col("fast"), F.col("sim")).alias("rescue"),
    )


@query(f"""
WITH {SQL_EVIDENCE}, a AS (SELECT *, coalesce(ident, 0) / 100 * (coalesce(cov, 0) / 100) AS h, CASE WHEN fast IS NOT NULL AND "full" IS NOT NULL THEN (fast + "full") / 2 ELSE coalesce(fast, "full") END AS s FROM strong),
b AS (SELECT *, CAST(round_even(CAST(greatest(0.0, least(1.0, CASE WHEN s IS NOT NULL THEN (CASE WHEN strong THEN 0.40::DOUBLE * p + 0.35::DOUBLE * s + 0.20::DOUBLE * h + 0.08::DOUBLE WHEN any_hit THEN 0.50::DOUBLE * p + 0.42::DOUBLE * s + 0.08::DOUBLE * h ELSE 0.5::DOUBLE * p + 0.5::DOUBLE * s END)
  ELSE (CASE WHEN strong THEN greatest(p, 0.70::DOUBLE * p + 0.30::DOUBLE) ELSE p END) END)) AS DECIMAL(18, 12)), 4) AS DOUBLE) AS score FROM a),
c AS (SELECT *, CASE WHEN strong THEN greatest(0.85, least(1.0, CASE WHEN any_hit THEN h * 1.2::DOUBLE ELSE 0 END)) ELSE least(1.0, CASE WHEN any_hit THEN h * 1.2::DOUBLE ELSE 0 END) END AS pen FROM b)
SELECT okey, score AS transposase_score, CASE WHEN score < 0.35 THEN 0.0 ELSE CAST(round_even(CAST(greatest(0.0, least(1.0, greatest(p, coalesce(s, 0), score) * (1 - pen))) AS DECIMAL(18, 12)), 4) AS DOUBLE) END AS novelty_score,
  CASE WHEN score >= 0.7 THEN (CASE WHEN strong THEN 'Known-like' WHEN any_hit AND s >= 0.55 THEN 'Remote' WHEN (NOT any_hit OR h < 0.05) AND s >= 0.65 THEN 'Novel_candidate' WHEN s >= 0.55 THEN 'Remote' ELSE 'Uncertain' END)
       WHEN score < 0.35 THEN (CASE WHEN strong THEN 'Uncertain' ELSE 'Negative' END) ELSE 'Uncertain' END AS final_category,
  CASE WHEN score >= 0.7 THEN (CASE WHEN strong THEN 'fusion_known_like' WHEN any_hit AND s >= 0.55 THEN 'fusion_remote' WHEN (NOT any_hit OR h < 0.05) AND s >= 0.65 THEN 'fusion_novel_candidate' WHEN s >= 0.55 THEN 'fusion_remote' ELSE 'fusion_uncertain' END)
       WHEN score < 0.35 THEN (CASE WHEN strong THEN 'fusion_conflict' ELSE 'fusion_negative' END) ELSE 'fusion_intermediate' END AS routing_stage FROM c""")
def fusion_scores(spark, d):
    e = evidence(spark, d).withColumn("strong", _strong())
    f = D.fuse(F.col("p"), F.col("fast"), F.col("full"), F.col("ident"), F.col("cov"), F.col("any_hit"), F.col("strong"))
    return e.withColumn("f", f).select("okey", "f.transposase_score", "f.novelty_score", "f.final_category", "f.routing_stage")


_FAMILIES = ["IS1", "IS3", "IS91", "IS110", "IS200/IS605", "IS66", "ISx", "IS607"]
_LENGTHS = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in D.EXPECTED_LENGTH.items()), " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in D.EXPECTED_LENGTH.items())


@query(f"""
WITH x AS (SELECT o_orderkey AS okey, ({_FAMILIES!r})[1 + o_orderkey % 8] AS fam, 400 + (o_orderkey * 13) % 3600 AS len, 200 + (o_orderkey * 7) % 2000 AS orf, ((o_orderkey * 37) % 101) / 101.0::DOUBLE AS hit,
  CASE WHEN o_orderkey % 3 <> 0 THEN 8 + o_orderkey % 30 END AS tl, CASE WHEN o_orderkey % 3 <> 0 THEN 0.65::DOUBLE + (o_orderkey % 36) / 100.0::DOUBLE END AS ti, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 31) / 1.0::DOUBLE END AS ts,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 27) / 1.0::DOUBLE END AS st, o_orderkey % 2 = 0 AS complete FROM orders),
a AS (SELECT *, fam NOT IN ('IS200/IS605', 'IS91', 'IS110', 'IS607') AS canon, least(1.0, orf / len) AS den, CASE fam {_LENGTHS[0]} ELSE 700 END AS lo, CASE fam {_LENGTHS[1]} ELSE 3200 END AS hi FROM x),
b AS (SELECT *, CASE WHEN canon THEN coalesce(ti * least(1.0, tl / 20.0::DOUBLE), 0.15) ELSE coalesce(greatest(0.2, least(1.0, st / 22.0::DOUBLE)), 0.2) END AS bd, CASE WHEN canon THEN coalesce(least(1.0, ts / 18.0::DOUBLE), 0.05) ELSE 1.0 END AS td,
  CASE WHEN den BETWEEN 0.5 AND 0.95 THEN 1.0 WHEN den >= 0.35 AND den < 0.5 THEN 0.7 WHEN den > 0.95 THEN 0.85 ELSE 0.4 END AS ar,
  CASE WHEN len BETWEEN lo AND hi THEN 1.0 WHEN len >= lo * 0.7::DOUBLE AND len <= hi * 1.3::DOUBLE THEN 0.75 WHEN len >= lo * 0.5::DOUBLE AND len <= hi * 1.8::DOUBLE THEN 0.5 ELSE 0.25 END AS ln FROM a),
c AS (SELECT *, CAST(round_even(CAST(0.35::DOUBLE * hit + 0.25::DOUBLE * bd + 0.15::DOUBLE * td + 0.15::DOUBLE * ar + 0.10::DOUBLE * ln AS DECIMAL(18, 12)), 4) AS DOUBLE) AS score FROM b)
SELECT okey, CAST(round_even(CAST(bd AS DECIMAL(18, 12)), 4) AS DOUBLE) AS boundary_score, CAST(round_even(CAST(td AS DECIMAL(18, 12)), 4) AS DOUBLE) AS tsd_score, ar::DOUBLE AS architecture_score, ln::DOUBLE AS length_score, score AS composite_score,
  CASE WHEN score >= 0.65 AND complete THEN 'complete' WHEN score >= 0.38 THEN 'partial' ELSE 'pseudo' END AS status FROM c""")
def composite_score(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        k.alias("okey"), F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]), (k % 8 + 1).cast("int")).alias("fam"), (400 + (k * 13) % 3600).alias("len"), (200 + (k * 7) % 2000).alias("orf"), ((k * 37) % 101 / 101.0).alias("hit"),
        F.when(k % 3 != 0, 8 + k % 30).alias("tl"), F.when(k % 3 != 0, 0.65 + (k % 36) / 100.0).alias("ti"), F.when(k % 4 != 0, (k % 31) / 1.0).alias("ts"), F.when(k % 5 != 0, (k % 27) / 1.0).alias("st"), (k % 2 == 0).alias("complete"),
    )
    c = F.col
    s = D.element_scores(c("fam"), c("len"), c("orf"), c("hit"), c("tl"), c("ti"), c("ts"), c("st"), c("complete"))
    return x.withColumn("s", s).select("okey", "s.boundary_score", "s.tsd_score", "s.architecture_score", "s.length_score", "s.composite_score", "s.status")


@query(f"""
WITH {SQL_EVIDENCE}, x AS (SELECT okey, p, ident, ['complete', 'partial', 'pseudo'][1 + okey % 3] AS status, ['Novel_candidate', 'Remote', 'Known-like', 'Uncertain', 'Negative'][1 + okey % 5] AS cat FROM strong)
SELECT okey, CASE WHEN status = 'complete' AND cat IN ('Novel_candidate', 'Remote') THEN 'High_Confidence_Novel_IS' WHEN status = 'complete' AND cat = 'Known-like' THEN 'High_Confidence_Known_IS'
  WHEN status <> 'complete' AND cat IN ('Novel_candidate', 'Remote') THEN 'Candidate_Novel_IS' WHEN status = 'complete' THEN 'Confirmed_Standard_IS' ELSE 'Standard_IS' END AS dual_category,
  round(0.5 * p + 0.5 * (coalesce(ident, 0) / 100), 6) AS dual_confidence,
  CASE WHEN p * 20 >= 10 AND coalesce(ident, 0) <= 5 AND p > 0.5 THEN 'GO' WHEN p * 20 >= 3 OR p * 30 >= 10 OR p > 0.5 THEN 'CONDITIONAL_GO' ELSE 'NO_GO' END AS gate FROM x""")
def dual_category(spark, d):
    e = evidence(spark, d)
    status = F.element_at(F.array(*map(F.lit, ("complete", "partial", "pseudo"))), (F.col("okey") % 3 + 1).cast("int"))
    cat = F.element_at(F.array(*map(F.lit, ("Novel_candidate", "Remote", "Known-like", "Uncertain", "Negative"))), (F.col("okey") % 5 + 1).cast("int"))
    i = F.coalesce("ident", F.lit(0.0))
    return e.select(
        "okey", D.dual_category(status, cat).alias("dual_category"), r(D.dual_confidence(F.col("p"), i / 100)).alias("dual_confidence"),
        D.go_status(F.col("p") * 20, i, F.col("p") - 0.5, F.col("p") * 30).alias("gate"),
    )


@query("""
WITH x AS (SELECT o_orderkey AS okey, 1000 + (o_orderkey * 13) % 3000 AS n, (o_orderkey * 7) % 400 AS os, 600 + (o_orderkey * 11) % 2500 AS oe0, o_orderkey % 6 <> 0 AS sup, o_orderkey % 4 = 0 AS comp, o_orderkey % 23 = 0 AS p5, o_orderkey % 29 = 0 AS p3 FROM orders),
y AS (SELECT *, least(oe0, n) AS oe, greatest(0, os - 60) AS s, least(n, least(oe0, n) + 60) AS e FROM x),
z AS (SELECT *, os <= 40 OR p5 AS al, oe >= n - 40 OR p3 AS ar FROM y),
w AS (SELECT *, al OR s <= 15 OR (NOT sup AND (os < 40 OR s <= 60)) AS l, ar OR e >= n - 15 OR (NOT sup AND (n - oe < 20 OR e >= n - 60)) AS r FROM z)
SELECT okey, CASE WHEN (al AND ar) OR (l AND r) THEN 'edge_both_truncated' WHEN l THEN 'edge_5p_truncated' WHEN r THEN 'edge_3p_truncated' WHEN comp OR sup THEN 'complete' ELSE 'internal_partial' END AS truncation FROM w""")
def truncation_class(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(k.alias("okey"), (1000 + (k * 13) % 3000).alias("n"), ((k * 7) % 400).alias("os"), (600 + (k * 11) % 2500).alias("oe0"), (k % 6 != 0).alias("sup"), (k % 4 == 0).alias("comp"), (k % 23 == 0).alias("p5"), (k % 29 == 0).alias("p3"))
    x = x.withColumn("oe", F.least("oe0", "n"))
    x = x.withColumn("s", F.greatest(F.lit(0), F.col("os") - 60)).withColumn("e", F.least(F.col("n"), F.col("oe") + 60))
    t = D.touches_edges(F.col("os"), F.col("oe"), F.col("n"), F.col("p5"), F.col("p3"))
    c = D.truncation_class(t["left"], t["right"], F.col("os"), F.col("oe"), F.col("s"), F.col("e"), F.col("n"), F.lit(40), F.lit(20), F.col("sup"), F.col("comp"))
    return x.select("okey", c.alias("truncation"))


# --- sequences ----------------------------------------------------------------------------------------------------


@query(f"""
WITH s AS (SELECT doc_id, {SQL_DNA} AS seq FROM documents)
SELECT doc_id, sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_sha256, round(CASE WHEN seq = '' THEN 0.5 ELSE (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) END, 6) AS gc FROM s""")
def revcomp_gc(spark, d):
    s = texts(spark, d).select("doc_id", dna(F.col("text")).alias("seq"))
    return s.select("doc_id", F.sha2(S.reverse_complement(F.col("seq")), 256).alias("rc_sha256"), r(S.gc_fraction(F.col("seq"))).alias("gc"))


@query(f"""
WITH s AS (SELECT doc_id, {SQL_DNA} AS seq FROM documents), k AS (SELECT substr(seq, i, 6) AS kmer FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 4)) AS i) WHERE length(seq) >= 6)
SELECT kmer, count(*) AS n FROM k WHERE length(replace(kmer, kmer[1], '')) > 0 GROUP BY kmer""")
def kmer_counts(spark, d):
    k = texts(spark, d).select(F.explode(S.kmers(dna(F.col("text")), 6)).alias("kmer"))
    return k.filter(~S.is_homopolymer(F.col("kmer"))).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH s AS (SELECT doc_id, {SQL_DNA} AS seq FROM documents), t AS (SELECT doc_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s)
SELECT doc_id, CAST(len(list_filter(range(1, length(seq) + 1), lambda i: seq[i] <> rc[i])) AS BIGINT) AS mismatches FROM t""")
def hamming(spark, d):
    s = texts(spark, d).select("doc_id", dna(F.col("text")).alias("seq"))
    return s.select("doc_id", S.hamming(F.col("seq"), S.reverse_complement(F.col("seq"))).cast("long").alias("mismatches"))


@query(f"""
WITH {SQL_CONTIGS}, m AS (SELECT unnest(range(-3, 4)) AS v), g AS (SELECT a.v AS dl, b.v AS dr, unnest(range(2, 15)) AS k FROM m a CROSS JOIN m b),
x AS (SELECT doc_id, dl, dr, k, ts + dl AS l, te + dr AS r, substr(seq, CAST(ts + dl - k + 1 AS BIGINT), k) AS a, substr(seq, CAST(te + dr + 1 AS BIGINT), k) AS b FROM contigs CROSS JOIN g
  WHERE ts + dl - 14 >= 0 AND te + dr + 14 <= n AND te + dr > ts + dl),
y AS (SELECT *, hamming(a, b) AS mm FROM x), z AS (SELECT *, CASE WHEN mm = 0 THEN k * 2.5::DOUBLE WHEN mm = 1 AND k >= 6 THEN (k - 1) * 1.8::DOUBLE END - 1.5::DOUBLE * abs(dl) - 1.5::DOUBLE * abs(dr) AS score FROM y)
SELECT doc_id, CAST(l AS INT) AS "left", CAST(r AS INT) AS "right", a AS repeat, CAST(k AS INT) AS length, CAST(mm AS INT) AS mismatches, round_even(score, 2) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, dl, dr, k) AS rn FROM z WHERE score > -1) WHERE rn = 1""")
def tsd_search(spark, d):
    return boundaries.direct_repeats(contigs(spark, d), "seq", "ts", "te", ("doc_id",))


def _boundary_sql(up: int, down: int, most: int, k: int, keep: int, total: str, result: str) -> str:
    """Ends by repeats: seeds, their growth on a budget of three mismatches, the kept ones, the direct repeat of each, and the best by ``total``."""
    return f"""
WITH {SQL_CONTIGS}, f AS (SELECT *, greatest(0, ts - {up}) AS a, substr(seq, greatest(0, ts - {up}) + 1, ts - greatest(0, ts - {up})) AS x, substr(seq, te + 1, least(n, te + {down}) - te) AS y FROM contigs),
g AS (SELECT *, translate(y, 'ACGT', 'TGCA') AS yc FROM f WHERE least(length(x), length(y)) >= 8),
lw AS (SELECT doc_id, u, word, row_number() OVER (PARTITION BY doc_id, word ORDER BY u) AS turn FROM (
  SELECT doc_id, u, substr(x, u + 1, {k}) AS word FROM g, LATERAL (SELECT unnest(range(0, length(x) - {k - 1})) AS u)) WHERE length(replace(word, word[1], '')) > 0),
rw AS (SELECT doc_id, d, reverse(substr(yc, d + 1, {k})) AS word FROM g, LATERAL (SELECT unnest(range(0, length(y) - {k - 1})) AS d)),
sd AS (SELECT g.*, lw.u, rw.d FROM lw JOIN rw USING (doc_id, word) JOIN g USING (doc_id) WHERE lw.turn <= 4),
o1 AS (SELECT *, least(u, length(y) - d - {k}, {most - k}) AS room FROM sd),
o2 AS (SELECT *, list_filter(range(0, room), lambda i: x[u - i] <> yc[d + {k + 1} + i]) AS odd FROM o1),
o3 AS (SELECT doc_id, a, ts, te, n, seq, x, yc, u, d, coalesce(odd[4], room) AS outward, least(3, len(odd)) AS bad FROM o2),
i1 AS (SELECT *, least(length(x) - u - {k}, d, {most - k} - outward) AS room FROM o3),
i2 AS (SELECT *, list_filter(range(0, room), lambda i: x[u + {k + 1} + i] <> yc[d - i]) AS odd FROM i1),
i3 AS (SELECT *, {k} + outward + coalesce(odd[4 - bad], room) AS size, bad + least(3 - bad, len(odd)) AS wrong, a + u - outward AS first, te + d + {k} + outward AS last FROM i2),
i4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first, last ORDER BY d, u) AS copy FROM i3 WHERE size >= 8),
i5 AS (SELECT *, (size - wrong) / size AS share, (size - wrong) * 2.0::DOUBLE - wrong * 2.5::DOUBLE AS score FROM i4 WHERE copy = 1),
li AS (SELECT doc_id, list([{{'first': first, 'last': last, 'size': size, 'wrong': wrong, 'score': score}}] ORDER BY score DESC, round(share, 3) * size DESC, d, u) AS found FROM i5 WHERE share >= 0.65 GROUP BY doc_id),
kp AS (SELECT doc_id, list_reduce(found, lambda acc, c: CASE WHEN len(acc) < {keep} AND len(list_filter(acc, lambda o: abs(o.first - c[1].first) <= 3 AND abs(o.last - c[1].last) <= 3)) = 0 THEN list_concat(acc, c) ELSE acc END) AS kept FROM li),
t AS (SELECT doc_id, place, kept[place].first AS first, kept[place].last AS last, kept[place].size AS size, kept[place].score AS score FROM kp, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS place)),
m AS (SELECT unnest(range(-3, 4)) AS v), mv AS (SELECT p.v AS dl, q.v AS dr, unnest(range(2, 15)) AS w FROM m p CROSS JOIN m q),
e1 AS (SELECT t.doc_id, place, dl, dr, w, first + dl AS l, last + dr AS r, substr(seq, CAST(first + dl - w + 1 AS BIGINT), w) AS p, substr(seq, CAST(last + dr + 1 AS BIGINT), w) AS q
  FROM t JOIN contigs USING (doc_id) CROSS JOIN mv WHERE first + dl - 14 >= 0 AND last + dr + 14 <= n AND last + dr > first + dl),
e2 AS (SELECT *, hamming(p, q) AS mm FROM e1), e3 AS (SELECT *, CASE WHEN mm = 0 THEN w * 2.5::DOUBLE WHEN mm = 1 AND w >= 6 THEN (w - 1) * 1.8::DOUBLE END - 1.5::DOUBLE * abs(dl) - 1.5::DOUBLE * abs(dr) AS s FROM e2),
e4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY s DESC, dl, dr, w) AS rn FROM e3 WHERE s > -1) WHERE rn = 1),
j AS (SELECT t.*, coalesce(e4.l, first) AS l, coalesce(e4.r, last) AS r, e4.p AS tsd, coalesce(round_even(e4.s, 2), 0.0) AS ds, ts, te, n FROM t LEFT JOIN e4 USING (doc_id, place) JOIN contigs USING (doc_id) WHERE first <= ts AND last >= te),
z AS (SELECT *, {total} AS total FROM j),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, place) AS rn FROM z) WHERE rn = 1)
SELECT {result} FROM contigs c LEFT JOIN b USING (doc_id)"""


def _distance_sql(away: str, low: int, high: int) -> str:
    return f"(greatest(0, {low} - ({away})) * 0.1::DOUBLE + greatest(0, ({away}) - {high}) * 0.08::DOUBLE)"


@query(_boundary_sql(
    450, 400, 45, 6, 8, f"score + 2.2::DOUBLE * ds - ({_distance_sql('ts - first', 40, 300)} + {_distance_sql('last - te', 20, 250)})",
    """doc_id, CAST(CASE WHEN total > 5 THEN l ELSE greatest(0, c.ts - 170) END AS INT) AS "start", CAST(CASE WHEN total > 5 THEN r ELSE least(c.n, c.te + 135) END AS INT) AS "end",
  coalesce(total > 5 AND (least(0.98, greatest(0.40, total / 65.0)) >= 0.45 OR size >= 10 OR tsd IS NOT NULL), false) AS complete,
  CASE WHEN total > 5 THEN CAST(printf('%.4f', least(0.98, greatest(0.40, total / 65.0))) AS DOUBLE) ELSE 0.25 END AS confidence, CAST(CASE WHEN total > 5 THEN size ELSE 0 END AS INT) AS tir_length,
  CASE WHEN total > 5 THEN score ELSE 0.0 END AS tir_score, CASE WHEN total > 5 THEN coalesce(tsd, '') ELSE '' END AS tsd"""))
def tir_search(spark, d):
    out = boundaries.predict_boundaries(contigs(spark, d), "seq", "ts", "te", "family", "plan_a", ("doc_id",))
    return out.select("doc_id", "start", "end", "complete", "confidence", F.coalesce("tir.length", F.lit(0)).alias("tir_length"), F.coalesce("tir.score", F.lit(0.0)).alias("tir_score"), F.coalesce("tsd.sequence", F.lit("")).alias("tsd"))


@query(_boundary_sql(
    500, 500, 50, 7, 6,
    """0.50::DOUBLE * least(1.0, score / 45.0) + 0.35::DOUBLE * least(1.0, ds / 20.0) + CASE WHEN last - first BETWEEN 600 AND 3500 THEN 0.15::DOUBLE * 1.0 WHEN last - first BETWEEN 400 AND 6000 THEN 0.15::DOUBLE * 0.6 ELSE 0.15::DOUBLE * 0.2 END""",
    """doc_id, CAST(coalesce(l, greatest(0, c.ts - 100)) AS INT) AS "start", CAST(coalesce(r, least(c.n, c.te + 80)) AS INT) AS "end", coalesce(total >= 0.5, false) AS complete, CAST(printf('%.4f', coalesce(total, 0.15)) AS DOUBLE) AS confidence"""))
def canonical_boundaries(spark, d):
    out = boundaries.predict_boundaries(contigs(spark, d), "seq", "ts", "te", "family", "plan_b", ("doc_id",))
    return out.select("doc_id", "start", "end", "complete", "confidence")


def _first_marked(pattern: str, low: int, high: int) -> str:
    """The place, in ``up``, of the first of the matches of a pattern, taken from the left without overlap, that begins ``low`` to ``high`` bases before its end; null without one."""
    marked = f"regexp_replace(up, '{pattern}', '#' || repeat('.', {len(pattern) - 1}), 'g')"
    return f"list_filter(range(0, length(up)), lambda i: ({marked})[i + 1] = '#' AND length(up) - i BETWEEN {low} AND {high})[1]"


def _pick_sql(patterns, low: int, high: int) -> str:
    """(at, name) of the first pattern with such a match, as a struct."""
    tries = ", ".join(f"CASE WHEN {_first_marked(p, low, high)} IS NOT NULL THEN {{'at': {_first_marked(p, low, high)}, 'name': '{p}'}} END" for p in patterns)
    return f"coalesce({tries})"


@query(f"""
WITH {SQL_CONTIGS}, w AS (SELECT *, substr(seq, te + 1, 300) AS dn, substr(seq, greatest(0, ts - 250) + 1, ts - greatest(0, ts - 250)) AS up FROM contigs),
g AS (SELECT stem, unnest(range(3, 8)) AS loop FROM (SELECT unnest(range(5, 10)) AS stem)),
x AS (SELECT doc_id, dn, stem, loop, unnest(range(0, length(dn) - 2 * stem - loop + 1)) AS i FROM w CROSS JOIN g WHERE length(dn) >= 2 * stem + loop),
a AS (SELECT *, substr(dn, i + 1, stem) AS one, substr(dn, i + stem + loop + 1, stem) AS two FROM x),
h AS (SELECT *, stem * 2.5::DOUBLE - hamming(translate(one, 'ACGT', 'TGCA'), reverse(two)) * 3.0::DOUBLE + length(regexp_replace(one, '[^GC]', '', 'g')) / stem * 2.0::DOUBLE - abs(loop - 4) * 0.5::DOUBLE AS score
  FROM a WHERE hamming(translate(one, 'ACGT', 'TGCA'), reverse(two)) <= 1),
b AS (SELECT *, i + 2 * stem + loop AS stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, stem, i, loop) AS rn FROM h) WHERE rn = 1),
t AS (SELECT *, substr(dn, stop + 1, 20) AS rest FROM b),
r AS (SELECT doc_id, score, stop + CASE WHEN length(rest) >= 4 THEN coalesce(list_filter(range(0, length(rest) - 1), lambda j: rest[j + 1:j + 2] IN ('TT', 'TA', 'AA'))[1] + 2, 6) ELSE 6 END AS past,
  one || '-' || substr(dn, i + stem + 1, loop) || '-' || two AS shown FROM t),
l AS (SELECT *, {_pick_sql(boundaries.K.IS200_START, 30, 200)} AS pick FROM w),
f AS (SELECT l.doc_id, CASE WHEN pick IS NULL THEN greatest(0, ts - 65) ELSE greatest(0, ts - 250) + pick.at END AS "start", CASE WHEN score IS NULL THEN least(n, te + 65) ELSE te + past END AS "end",
  round(coalesce(score, 5.0) + CASE WHEN pick IS NULL THEN 4.0 ELSE 8.0 END, 2) AS total, coalesce(shown, 'unresolved') AS shown, coalesce(pick.name, 'predicted') AS motif_left FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", round(least(0.95, greatest(0.40, total / 25.0)), 4) AS confidence, 'hairpin_stem_loop:' || shown AS feature_type, motif_left, CAST(NULL AS VARCHAR) AS motif_right, total AS stability_score FROM f""")
def hairpins(spark, d):
    g = contigs(spark, d).withColumn("family", F.lit("IS200/IS605"))
    return boundaries.predict_boundaries(g, "seq", "ts", "te", "family", "plan_a", ("doc_id",)).select("doc_id", "start", "end", "confidence", "structure.*")


def _motif_sql(patterns, column, shift):
    at = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN length(regexp_extract({column}, '^(.*?)({p})', 1))" for p in patterns)
    size = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN length(regexp_extract({column}, '{p}'))" for p in patterns)
    return f"CASE {at} END", f"CASE {size} END"


def _ter_sql() -> str:
    tries = ", ".join(f"CASE WHEN regexp_matches(dn, '{p}') THEN {{'stop': length(regexp_extract(dn, '^(.*?)({p})', 1)) + length(regexp_extract(dn, '{p}')), 'name': regexp_extract(dn, '{p}')}} END" for p in boundaries.K.IS91_TER)
    return f"coalesce({tries})"


@query(f"""
WITH {SQL_CONTIGS}, w AS (SELECT *, substr(seq, te + 1, 300) AS dn, substr(seq, greatest(0, ts - 250) + 1, ts - greatest(0, ts - 250)) AS up FROM contigs),
f AS (SELECT *, {_ter_sql()} AS ter, {_pick_sql(boundaries.K.IS91_ORI, 40, 180)} AS ori FROM w)
SELECT doc_id, CAST(CASE WHEN ori IS NULL THEN greatest(0, ts - 90) ELSE greatest(0, ts - 250) + ori.at END AS INT) AS "start", CAST(CASE WHEN ter IS NULL THEN least(n, te + 120) ELSE te + ter.stop END AS INT) AS "end",
  round(least(0.95, greatest(0.45, (CASE WHEN ter IS NULL THEN 5.0 ELSE 15.0 END + CASE WHEN ori IS NULL THEN 5.0 ELSE 10.0 END) / 25.0)), 4) AS confidence,
  coalesce(ori.name, 'predicted_ori') AS motif_left, coalesce(ter.name, 'predicted_ter') AS motif_right FROM f""")
def rolling_circle(spark, d):
    """Ends of elements by origin and terminus motifs."""
    g = contigs(spark, d).withColumn("family", F.lit("IS91"))
    out = boundaries.predict_boundaries(g, "seq", "ts", "te", "family", "plan_a", ("doc_id",))
    return out.select("doc_id", "start", "end", "confidence", "structure.motif_left", "structure.motif_right")


_END_AT, _END_SIZE = _motif_sql(boundaries.K.IS110_END, "dn", 0)
_START_AT, _ = _motif_sql(boundaries.K.IS110_START, "up", 0)


@query(f"""
WITH {SQL_CONTIGS}, w AS (SELECT doc_id, n, ts, te, least(n, te + 200) AS a, greatest(0, ts - 160) AS b, substr(seq, CAST(least(n, te + 200) + 1 AS BIGINT), least(n, te + 380) - least(n, te + 200)) AS dn,
  substr(seq, CAST(greatest(0, ts - 160) + 1 AS BIGINT), greatest(0, ts - 40) - greatest(0, ts - 160)) AS up FROM contigs),
m AS (SELECT *, {_END_AT} AS ea, {_END_SIZE} AS es, {_START_AT} AS sa FROM w)
SELECT doc_id, CAST(CASE WHEN sa IS NULL THEN greatest(0, ts - 85) ELSE b + sa END AS INT) AS "start", CAST(CASE WHEN ea IS NULL THEN least(n, te + 280) ELSE a + ea + es END AS INT) AS "end",
  CASE WHEN sa IS NULL THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END + CASE WHEN ea IS NULL THEN 5.0::DOUBLE ELSE 12.0::DOUBLE END AS stability FROM m""")
def is110_motifs(spark, d):
    c = F.col
    a, b = F.least(c("n"), c("te") + 200), F.greatest(F.lit(0), c("ts") - 160)
    w = contigs(spark, d).select(
        "doc_id", "n", "ts", "te", a.alias("a"), b.alias("b"), S.interval_sequence(c("seq"), a, F.least(c("n"), c("te") + 380)).alias("dn"), S.interval_sequence(c("seq"), b, F.greatest(F.lit(0), c("ts") - 40)).alias("up")
    )
    e, s = S.first_motif(c("dn"), boundaries.K.IS110_END), S.first_motif(c("up"), boundaries.K.IS110_START)
    m = w.select("doc_id", "n", "ts", "te", "a", "b", e.alias("e"), s.alias("s"))
    return m.select(
        "doc_id", F.coalesce(c("b") + c("s.start"), F.greatest(F.lit(0), c("ts") - 85)).cast("int").alias("start"), F.coalesce(c("a") + c("e.end"), F.least(c("n"), c("te") + 280)).cast("int").alias("end"),
        (F.when(c("s").isNull(), 5.0).otherwise(10.0) + F.when(c("e").isNull(), 5.0).otherwise(12.0)).alias("stability"),
    )


@query(f"""
WITH {SQL_CONTIGS}, u AS (SELECT doc_id, substr(seq, greatest(0, ts - 200) + 1, ts - greatest(0, ts - 200)) AS s FROM contigs), v AS (SELECT doc_id, substr(seq, te + 1, 200) AS s FROM contigs),
a AS (SELECT doc_id, i - 1 AS pos, substr(s, i, 7) AS w FROM u, LATERAL (SELECT unnest(range(1, length(s) - 5)) AS i)), b AS (SELECT doc_id, i - 1 AS pos, substr(s, i, 7) AS w FROM v, LATERAL (SELECT unnest(range(1, length(s) - 5)) AS i)),
a4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS rn FROM a WHERE length(replace(w, w[1], '')) > 0) WHERE rn <= 4)
SELECT a4.doc_id AS id, CAST(a4.pos AS INT) AS left_pos, CAST(b.pos AS INT) AS right_pos FROM a4 JOIN b ON a4.doc_id = b.doc_id AND a4.w = reverse(translate(b.w, 'ACGT', 'TGCA'))""")
def kmer_seed_join(spark, d):
    c = contigs(spark, d)
    a = F.greatest(F.lit(0), F.col("ts") - 200)
    left = c.select(F.col("doc_id").alias("id"), S.interval_sequence(F.col("seq"), a, F.col("ts")).alias("seq"))
    right = c.select(F.col("doc_id").alias("id"), S.interval_sequence(F.col("seq"), F.col("te"), F.col("te") + 200).alias("seq"))
    return similarity.seed_matches(left, right, 7)


@query(f"""
WITH p AS (SELECT doc_id, {SQL_PROTEIN} AS aa FROM documents), t AS (SELECT doc_id, aa, lower(aa) AS raw, length(aa) AS n FROM p),
u AS (SELECT doc_id, aa, n, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 AND i < n AND raw[i] IN ('d', 'e') AND raw[i + 1] IN ('d', 'e') THEN 'd' ELSE raw[i] END), '') AS tok FROM t),
v AS (SELECT *, len(list_filter(range(1, n - 2), lambda i: tok[i:i + 3] IN ({", ".join(f"'{m}'" for m in S.FOLD_MOTIFS)}))) AS hits, len(list_filter(range(1, n - 1), lambda i: aa[i] IN ('D', 'E') AND tok[i] IN ('d', 'e', 'p'))) AS acid FROM u),
w AS (SELECT *, least(1.0, hits / greatest(n - 3, 1) * 15.0::DOUBLE) AS dens, least(1.0, acid / greatest(1.0, n * 0.05::DOUBLE)) AS dde FROM v)
SELECT doc_id, sha256(tok) AS tokens_sha256, round(CASE WHEN n < 4 THEN 0.5 ELSE 1 / (1 + exp(-(6.0::DOUBLE * (0.5::DOUBLE * dens + 0.5::DOUBLE * dde - 0.45::DOUBLE)))) END, 6) AS score,
  round(CASE WHEN n < 4 THEN 0.5 ELSE least(1.0, greatest(0.1, dens * 0.8::DOUBLE + 0.2::DOUBLE)) END, 6) AS similarity FROM w""")
def threedi_score(spark, d):
    p = texts(spark, d).select("doc_id", protein(F.col("text")).alias("aa")).withColumn("tok", S.structure_tokens(F.col("aa")))
    p = p.withColumn("x", S.structure_scores(F.col("aa"), F.col("tok")))
    return p.select("doc_id", F.sha2("tok", 256).alias("tokens_sha256"), r("x.score").alias("score"), r("x.similarity").alias("similarity"))


@query(f"""
WITH p AS (SELECT doc_id, {SQL_PROTEIN} AS aa FROM documents), t AS (SELECT doc_id, aa, lower(aa) AS raw, length(aa) AS n FROM p),
u AS (SELECT doc_id, aa, n, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 AND i < n AND raw[i] IN ('d', 'e') AND raw[i + 1] IN ('d', 'e') THEN 'd' ELSE raw[i] END), '') AS tok FROM t)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, n + 1), lambda i: aa[i] || tok[i]), ' ')) AS pairs_sha256,
  round(1 / (1 + exp(-(5.0::DOUBLE * (coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN aa[i] IN ('D', 'E') AND tok[i] IN ('d', 'e', 'p') THEN 2.0 WHEN aa[i] IN ('V', 'L', 'I', 'A') AND tok[i] IN ('v', 'l', 'i', 'a') THEN 1.0
    WHEN aa[i] IN ('K', 'R') AND tok[i] IN ('k', 'r', 'p') THEN 1.0 ELSE 0.0 END)), 0) / greatest(n, 1) - 0.35::DOUBLE)))), 6) AS score FROM u""")
def bimodal_score(spark, d):
    p = texts(spark, d).select("doc_id", protein(F.col("text")).alias("aa")).withColumn("tok", S.structure_tokens(F.col("aa")))
    return p.select("doc_id", F.sha2(S.bimodal_tokens(F.col("aa"), F.col("tok")), 256).alias("pairs_sha256"), r(S.bimodal_score(F.col("aa"), F.col("tok"))).alias("score"))


# --- learning -----------------------------------------------------------------------------------------------------

_WEIGHTS = [((i * 37) % 11 - 5) / 100 for i in range(64)]
_MEANS = [((i * 13) % 7 - 3) / 50 for i in range(64)]
_SCALES = [0.0 if i == 5 else 0.5 + (i % 5) / 10 for i in range(64)]


@query("""
SELECT vec_id, round(1 / (1 + exp(-(0.25 + list_sum(list_transform(range(64), lambda i: (CAST(embedding[i + 1] AS DOUBLE) - ((i * 13) % 7 - 3) / 50) / (CASE WHEN i = 5 THEN 1.0 ELSE 0.5 + (i % 5) / 10 END) * (((i * 37) % 11 - 5) / 100)))))), 6) AS score FROM embeddings""")
def linear_scorer(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", r(learning.linear_score(F.col("embedding"), _MEANS, _SCALES, _WEIGHTS, 0.25)).alias("score"))


@query()
def logistic_fit(spark, d):
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").withColumn("y", (F.col("label") < 5).cast("int"))
    (w, b), (mean, scale) = learning.fit_logistic(v, "embedding", "y")
    return v.select("vec_id", "y", r(learning.linear_score(F.col("embedding"), mean, scale, w, b), 4).alias("score"))


# --- scan ---------------------------------------------------------------------------------------------------------


def _scan_inputs(spark, d):
    c = texts(spark, d).select(F.col("doc_id").cast("string").alias("contig_id"), dna(F.col("text")).alias("sequence"))
    genes = materialize(scan.find_genes(c), "genes")
    k = F.length("protein")
    hits_ = genes.select("gene_id", F.when(k % 2 == 0, "IS3").otherwise("IS110").alias("family"), (k / 2.0).alias("bits"), F.pow(F.lit(10.0), -k / 10.0).alias("evalue"))
    return c, genes, hits_


@query()
def scan_contigs(spark, d):
    return scan.annotate(*_scan_inputs(spark, d), primary="best")


@query()
def scan_fragments(spark, d):
    return scan.annotate(*_scan_inputs(spark, d), primary="first", edges=True)


@query(f"WITH {_ISLANDS} SELECT event_id, user_id, CAST(island AS BIGINT) AS island FROM i")
def stream_event_islands(spark, d):
    """The islands again, incrementally: users dealt to files, a file a batch."""
    import uuid

    from mobilome.storage import shared_dir
    from mobilome.streaming.scans import incremental

    root = f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    source = event_intervals(spark, d)
    source.repartition(4, "user_id").write.parquet(f"{root}/in")
    work = lambda batch: intervals.islands(batch, "user_id", "start", "end", "event_type", 250, ("event_id",)).select("event_id", "user_id", "island")
    incremental(spark, f"{root}/in", source.schema, work, f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.schema("event_id long, user_id long, island long").option("recursiveFileLookup", "true").parquet(f"{root}/out")


@query(f"WITH {_ISLANDS} SELECT event_id, user_id, CAST(island AS BIGINT) AS island FROM i")
def stream_cut_islands(spark, d):
    """The islands once more, from files cut by place: every user's events come over several files, and the open end is keyed state."""
    import uuid

    from mobilome.storage import shared_dir
    from mobilome.streaming.keyed import stream_islands

    root = f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    source = event_intervals(spark, d).select("event_id", "user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "event_type")
    cuts = source.agg(F.percentile_approx("start", [0.2, 0.4, 0.6, 0.8])).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else F.col("start") >= low) & (F.lit(True) if high is None else F.col("start") < high)
        source.filter(inside).repartition(2, "user_id").write.mode("append").parquet(f"{root}/in")
    stream_islands(spark, f"{root}/in", source.schema, "user_id", "start", "end", "event_type", 250, f"{root}/out", f"{root}/check", ("event_id",)).awaitTermination()
    return spark.read.schema("event_id long, user_id long, start long, end long, event_type string, island long").parquet(f"{root}/out").select("event_id", "user_id", "island")


# --- evaluation ---------------------------------------------------------------------------------------------------


@query(f"""
WITH {SQL_INTERVALS}, p AS (SELECT * FROM iv WHERE event_type = 'click'), t AS (SELECT * FROM iv WHERE event_type = 'view'),
m AS (SELECT p.event_id AS pred_id, t.event_id AS truth_id, t."start" AS ts, greatest(abs(p."start" - t."start"), abs(p."end" - t."end")) AS err,
    (least(p."end", t."end") - greatest(p."start", t."start")) / greatest(p."end" - p."start", t."end" - t."start") AS ov
  FROM p JOIN t ON p.user_id = t.user_id AND p."start" < t."end" AND t."start" < p."end"),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY ov DESC, ts, truth_id) AS rn FROM m) WHERE rn = 1 AND ov >= 0.4),
s AS (SELECT count(DISTINCT truth_id) AS tp, count(DISTINCT pred_id) AS matched, coalesce(avg(err), 999.0) AS mean_error, coalesce(quantile_cont(err, 0.5), 999.0) AS median_error FROM b),
k AS (SELECT *, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM t) AS n_true FROM s)
SELECT n_pred, n_true, tp, n_pred - matched AS fp, n_true - tp AS fn, round(coalesce(tp / nullif(tp + n_pred - matched, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n_true, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + n_pred - matched + n_true - tp, 0), 0), 6) AS f1, round(mean_error, 6) AS mean_error, median_error::DOUBLE AS median_error FROM k""")
def scan_evaluation(spark, d):
    iv = event_intervals(spark, d).withColumnRenamed("event_id", "id")
    p, t = iv.filter("event_type = 'click'"), iv.filter("event_type = 'view'")
    out = evaluation.scan_summary(p, t, intervals.overlap_matches(p, t, 720, 0.4, "user_id"))
    return out.withColumns({c: r(c) for c in ("precision", "recall", "f1", "mean_error")})


@query("""
WITH x AS (SELECT ['IS3', 'IS110', 'IS1', 'IS91'][1 + o_orderkey % 4] AS family, o_orderkey % 5 AS a, o_orderkey % 13 AS b, o_orderkey % 3 = 0 AS ht, o_orderkey % 2 = 0 AS tt, o_orderkey % 7 < 3 AS hs, o_orderkey % 5 < 2 AS ts FROM orders),
y AS (SELECT *, family IN ('IS110', 'IS91') AS sp, greatest(a, b) AS w FROM x)
SELECT family, count(*) AS n, round(avg((w = 0)::INT), 6) AS exact, round(avg((w <= 3)::INT), 6) AS within_3, round(avg((w <= 10)::INT), 6) AS within_10, round(avg((a + b) / 2), 6) AS mean_error, quantile_cont(w, 0.5)::DOUBLE AS median_error,
  round(coalesce(2 * count(*) FILTER (NOT sp AND ht AND tt) / nullif(2 * count(*) FILTER (NOT sp AND ht AND tt) + count(*) FILTER (NOT sp AND ht AND NOT tt) + count(*) FILTER (NOT sp AND NOT ht AND tt), 0), 0), 6) AS tir_f1,
  round(coalesce(2 * count(*) FILTER (NOT sp AND hs AND ts) / nullif(2 * count(*) FILTER (NOT sp AND hs AND ts) + count(*) FILTER (NOT sp AND hs AND NOT ts) + count(*) FILTER (NOT sp AND NOT hs AND ts), 0), 0), 6) AS tsd_f1,
  round(coalesce(count(*) FILTER (sp AND (ht OR hs)) / nullif(count(*) FILTER (sp), 0), 0), 6) AS hallucinated FROM y GROUP BY family""")
def boundary_evaluation(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        F.element_at(F.array(*map(F.lit, ("IS3", "IS110", "IS1", "IS91"))), (k % 4 + 1).cast("int")).alias("family"), (k + k % 5).alias("start"), k.alias("true_start"), (k + 900 - k % 13).alias("end"), (k + 900).alias("true_end"),
        (k % 3 == 0).alias("has_tir"), (k % 2 == 0).alias("true_tir"), (k % 7 < 3).alias("has_tsd"), (k % 5 < 2).alias("true_tsd"),
    )
    out = evaluation.boundary_summary(x, ("family",))
    return out.withColumns({c: r(c) for c in ("exact", "within_3", "within_10", "mean_error", "tir_f1", "tsd_f1", "hallucinated")})


_BASE = "CAST('0x' || substr(md5(md5(CAST(doc_id AS VARCHAR)) || '{s}' || ':' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_PICK = "(SELECT CASE WHEN u < (1 - gc) / 2 THEN 'A' WHEN u < (1 - gc) / 2 + gc / 2 THEN 'C' WHEN u < (1 - gc) / 2 + gc THEN 'G' ELSE 'T' END FROM (SELECT {b} AS u))"


@query(f"""
WITH s AS (SELECT doc_id, {SQL_DNA} AS seq FROM documents), g AS (SELECT doc_id, seq, CASE WHEN seq = '' THEN 0.5::DOUBLE ELSE (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) END AS gc FROM s),
n AS (SELECT *, unnest(range(1, 31)) AS i FROM g), u AS (SELECT *, {_BASE.format(s="l")} AS ul, {_BASE.format(s="r")} AS ur FROM n),
f AS (SELECT doc_id, seq, string_agg({_PICK.format(b="ul")}, '' ORDER BY i) AS l, string_agg({_PICK.format(b="ur")}, '' ORDER BY i) AS r FROM u GROUP BY doc_id, seq)
SELECT doc_id, sha256(l || seq || right(l, 5) || r) AS contig_sha256, 30 AS true_start, CAST(30 + length(seq) AS INT) AS true_end, right(l, 5) AS true_tsd FROM f""")
def synthetic_contigs(spark, d):
    docs = texts(spark, d).select("doc_id", dna(F.col("text")).alias("seq"))
    out = evaluation.synthetic_contigs(docs, "doc_id", "seq", 30, 5)
    return out.select("doc_id", F.sha2("contig", 256).alias("contig_sha256"), "true_start", "true_end", "true_tsd")


def _register() -> None:
    from mobilome.plans import files, more, searches

    for module in (files, more, searches):
        QUERIES.update(module.QUERIES)
        ORACLE.update(module.ORACLE)


_register()
