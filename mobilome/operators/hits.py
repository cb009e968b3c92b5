"""Alignment hits: best hit per query, homology classes and leakage audits.

Hit tables have (query, target, fident, qcov, tcov, evalue, bits, line_no); identity and
coverages are fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.storage import discard, materialize

#: A query without a hit.
NO_HIT = {"score": 0.0, "target_id": "None", "pident": 0.0, "coverage": 0.0, "evalue": 999.0}


#: Links that one task of greedy clustering holds on average, and tasks that the links of one vertex may lie in.
TASK_LINKS, SPREAD = 500_000, 8


def best_hit(hits: DataFrame, query: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Per query the row with the largest ``order``; end it with a tie-breaker such as the negated line number."""
    return hits.groupBy(query).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("b")).select(query, "b.*")


def predictions(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query: its best hit by bit score, or the no-hit row."""
    best = best_hit(hits, "query", [F.col("bits"), -F.col("line_no")], ["target", "fident", "qcov", "evalue", "bits"])
    joined = queries.select(F.col("seq_id")).join(best, F.col("seq_id") == F.col("query"), "left")
    return joined.select(
        "seq_id",
        F.coalesce("bits", F.lit(NO_HIT["score"])).alias("score"), F.coalesce("target", F.lit(NO_HIT["target_id"])).alias("target_id"),
        F.coalesce(F.col("fident") * 100, F.lit(NO_HIT["pident"])).alias("pident"), F.coalesce(F.col("qcov") * 100, F.lit(NO_HIT["coverage"])).alias("coverage"),
        F.coalesce("evalue", F.lit(NO_HIT["evalue"])).alias("evalue"),
    )


def violates(rule: str, identity: float = 0.30, coverage: float = 0.80) -> Column:
    """Leakage rules: "either" (either coverage, identity above), "both" (both coverages, at least), "ambiguous"."""
    f, q, t = F.col("fident"), F.col("qcov"), F.col("tcov")
    if rule == "either":
        return (f > identity) & (F.greatest(q, t) >= coverage)
    if rule == "both":
        return (f >= identity) & (q >= coverage) & (t >= coverage)
    return (f >= 0.25) & ((q >= 0.50) | (t >= 0.50))


#: Edge rules of the clustering schemes.
SCHEMES = {
    "A": lambda: violates("either"),
    "B": lambda: violates("both"),
    "C": lambda: (F.col("fident") >= 0.30) & (F.col("qcov") >= 0.80) & (F.col("tcov") >= 0.50),
    "D": lambda: (F.col("fident") >= 0.30) & (F.col("qcov") >= 0.80) & (F.col("tcov") >= 0.80),
    "E": lambda: (F.col("fident") >= 0.30) & (F.col("tcov") >= 0.80),
}


def scheme_edges(hits: DataFrame) -> DataFrame:
    """(scheme, query, target) of every scheme's edges, in one pass over the hits."""
    names = F.array_compact(F.array(*[F.when(rule(), F.lit(n)) for n, rule in SCHEMES.items()]))
    return hits.filter("query <> target").select(F.explode(names).alias("scheme"), "query", "target")


def leakage_summary(hits: DataFrame, rule: str = "either", identity: float = 0.30, coverage: float = 0.80) -> DataFrame:
    """One row: violating hits, queries concerned, largest identity among all hits, and whether the audit passes."""
    bad = violates(rule, identity, coverage)
    return hits.agg(
        F.count_if(bad).alias("violations"), F.count_distinct(F.when(bad, F.col("query"))).alias("leaked_queries"),
        F.coalesce(F.max("fident"), F.lit(0.0)).alias("max_identity"), (F.count_if(bad) == 0).alias("passed"),
    )


def homology_classes(queries: DataFrame, hits: DataFrame, identity: float = 0.30, coverage: float = 0.80) -> DataFrame:
    """Per query, hit or not: the best full-length hits by identity and by bits, the best local identity, and its class."""
    full = (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage)
    hit = F.struct("target", "fident", "bits", "qcov", "tcov")
    best = hits.groupBy("query").agg(
        F.max_by(hit, F.when(full, F.struct(F.col("fident"), F.col("bits"), -F.col("line_no")))).alias("by_identity"),
        F.max_by(hit, F.when(full, F.struct(F.col("bits"), F.col("fident"), -F.col("line_no")))).alias("by_bits"),
        F.max("fident").alias("best_local"),
        F.count_if(full).alias("n_full"),
    )
    joined = queries.select("seq_id").join(best, F.col("seq_id") == F.col("query"), "left")
    some, i, b = F.coalesce(F.col("n_full") > 0, F.lit(False)), F.col("by_identity"), F.col("best_local")
    kind = (
        F.when(some & (i["fident"] >= 0.999) & (i["qcov"] >= 0.999) & (i["tcov"] >= 0.999), "L1_EXACT")
        .when(some & (i["fident"] >= identity), "L2_CLOSE")
        .when(some & (i["fident"] < 0.20), "REMOTE_20_STRICT")
        .when(some, "REMOTE_30_STRICT")
        .when(b >= identity, "L3_DOMAIN_ONLY")
        .otherwise("NO_FULL_LENGTH_HOMOLOG")
    )
    return joined.select(
        "seq_id", kind.alias("homology_class"),
        F.when(some, i["target"]).alias("identity_target"), F.when(some, i["fident"]).alias("max_identity"),
        F.when(some, F.col("by_bits.target")).alias("bits_target"), F.when(some, F.col("by_bits.fident")).alias("bits_identity"),
        b.alias("best_local_identity"),
    )


def best_similarity(hits: DataFrame) -> DataFrame:
    """Per query its best hit by bits, then smaller e-value, then earlier line."""
    return best_hit(hits, "query", [F.col("bits"), -F.col("evalue"), -F.col("line_no")], ["target", "fident", "qcov", "tcov", "evalue", "bits"])


def nearest_identity(hits: DataFrame) -> DataFrame:
    """Per query the largest identity and the target that has it, the earlier line of equals."""
    return hits.groupBy("query").agg(F.max("fident").alias("max_identity"), F.max_by("target", F.struct(F.col("fident"), -F.col("line_no"))).alias("target"))


def reciprocal_audit(queries: DataFrame, hits: DataFrame, coverage: float = 0.80, exact: float = 0.99) -> DataFrame:
    """Per query (seq_id, label) its best local hit and its best hit of reciprocal coverage, both by bits, and a homology class.

    Reciprocal coverage is the smaller of both coverages.
    """
    both = F.least("qcov", "tcov")
    hit = F.struct("target", "fident", "qcov", "tcov", both.alias("rcov"), "bits", "evalue")
    by_bits = F.struct(F.col("bits"), -F.col("line_no"))
    best = hits.groupBy("query").agg(F.max_by(hit, by_bits).alias("local"), F.max_by(hit, F.when(both >= coverage, by_bits)).alias("strict"), F.count_if(both >= coverage).alias("n_strict"))
    joined = queries.select("seq_id", "label").join(best, F.col("seq_id") == F.col("query"), "left")
    some = F.coalesce(F.col("n_strict") > 0, F.lit(False))
    i = F.col("strict.fident")
    kind = (
        F.when(F.col("local").isNull(), "NO_HOMOLOG_FOUND").when(~some, "DOMAIN_OVERLAP").when((i >= exact) & (F.col("strict.rcov") >= exact), "L1_EXACT")
        .when(i >= 0.30, "L2_CLOSE").when(i >= 0.20, "REMOTE_30").otherwise("REMOTE_20")
    )
    return joined.select(
        "seq_id", "label", F.coalesce("local.target", F.lit(-1)).alias("nearest"), F.coalesce("local.fident", F.lit(0.0)).alias("local_identity"), F.coalesce("local.bits", F.lit(0.0)).alias("bits"),
        F.when(some, i).otherwise(0.0).alias("strict_identity"), kind.alias("homology_class"),
    )


def audit_counts(audited: DataFrame) -> DataFrame:
    """Per class of ``reciprocal_audit`` the queries, and those of them that are positives."""
    return audited.groupBy("homology_class").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("label") == 1).alias("positives"))


def greedy_links(vertices: DataFrame, edges: DataFrame, id_col: str, priority: list[Column]) -> tuple[DataFrame, DataFrame, int]:
    """(v, place) and (x, y): vertices with places that grow from the first in order to the last, links both ways by place, and in how many parts these lie.

    Places are numbers in the order of a sort, not without gaps.  The number of parts follows the links, so a task holds as many whatever the input.
    """
    pairs = materialize(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b"), "greedy-pairs")
    parts = 1 + 2 * pairs.count() // TASK_LINKS
    best = vertices.select(F.col(id_col).alias("v"), F.struct(*priority, (-F.col(id_col)).alias("_low")).alias("r")).groupBy("v").agg(F.max("r").alias("r"))
    order = materialize(best.sort(F.desc("r")).select("v", F.monotonically_increasing_id().alias("place")), "greedy-order")
    # Cut by the smaller side: a join that shuffles follows it.
    place = order.repartition(parts, "v")
    linked = pairs.union(pairs.select("b", "a")).join(place.select(F.col("v").alias("a"), F.col("place").alias("x")), "a")
    linked = linked.join(place.select(F.col("v").alias("b"), F.col("place").alias("y")), "b").select("x", "y", F.pmod(F.xxhash64("y"), F.lit(SPREAD)).alias("share"))
    # With its share among what is distinct, this keeps the partitions.
    linked = materialize(linked.repartition(parts, "x", "share").distinct().select("x", "y"), "greedy-links")
    discard(pairs)
    return order, linked, parts


def greedy_clusters(vertices: DataFrame, edges: DataFrame, id_col: str, priority: list[Column], most: int = 200) -> DataFrame:
    """(id, representative) of greedy clustering: taken in order of ``priority`` (larger first, then smaller id), a vertex
    that no representative has taken represents itself and takes all its free neighbours.

    Rounds over links: a free vertex that comes before all its free neighbours represents, and its neighbours are free no more.  At the
    end every other vertex joins the first representative next to it.  The result is that of going
    through the vertices one by one.  Each round is written, so lost executors cost one round.
    """
    order, linked, parts = greedy_links(vertices, edges, id_col, priority)
    free, rounds = order.select("place"), []
    while len(rounds) < most and not free.isEmpty():
        cut = free.repartition(parts, "place")
        live = linked.join(cut.select(F.col("place").alias("x")), "x", "left_semi").join(cut.select(F.col("place").alias("y")), "y", "left_semi")
        first = live.groupBy("x").agg(F.min("y").alias("next"))
        chosen = materialize(free.join(first, F.col("place") == F.col("x"), "left").filter("next IS NULL OR place < next").select("place"), "greedy-chosen")
        rounds.append(chosen)
        taken = live.join(chosen.repartition(parts, "place").select(F.col("place").alias("y")), "y", "left_semi").select("x")
        before, free = free, materialize(free.join(chosen.union(taken).distinct(), "place", "left_anti"), "greedy-free")
        discard(before)
    if not free.isEmpty():
        raise RuntimeError(f"clusters are open after {most} rounds")
    chosen = rounds[0] if rounds else order.select("place")
    for more in rounds[1:]:
        chosen = chosen.union(more)
    own = linked.join(chosen.repartition(parts, "place").select(F.col("place").alias("y")), "y", "left_semi").groupBy("x").agg(F.min("y").alias("y"))
    own = own.join(chosen.select(F.col("place").alias("x")), "x", "left_anti")
    own = own.join(order.select(F.col("place").alias("x"), F.col("v").alias("a")), "x").join(order.select(F.col("place").alias("y"), F.col("v").alias("to")), "y").select("a", "to")
    return vertices.select(F.col(id_col)).join(own, F.col(id_col) == F.col("a"), "left").select(id_col, F.coalesce("to", id_col).alias("representative"))


def family_clusters(rows: DataFrame, family: str, cluster: str) -> DataFrame:
    """Per family its members and its distinct clusters, the largest family first."""
    return rows.groupBy(family).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(cluster).alias("clusters")).orderBy(F.col("members").desc(), family)
