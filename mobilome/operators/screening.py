"""Protein screening: quality control, evidence contracts and the routed, fused result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.functions import decisions as D
from mobilome.functions.sequence import invalid_letters
from mobilome.operators.joins import join_answers
from mobilome.storage import materialize

LETTERS = "ABCDEFGHIKLMNOPQRSTUVWXYZ"


def protein_qc(proteins: DataFrame, least: int = 50, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) proteins of (protein_id, sequence).

    Sequences are put in upper case, a stop at the end is cut and stops inside become X.
    Rejected rows carry every reason: duplicate id, empty, letters, length.
    """
    upper = F.upper(F.regexp_replace("sequence", r"\s+", ""))
    cut = F.regexp_replace(upper, r"\*+$", "")
    rows = proteins.select(
        "protein_id", upper.alias("raw"), F.replace(cut, F.lit("*"), F.lit("X")).alias("sequence"),
    )
    copies = proteins.groupBy(F.col("protein_id").alias("pid")).agg(F.count(F.lit(1)).alias("copies"))
    n = F.length("sequence")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("copies") > 1, "duplicate_id"), F.when(F.coalesce(n, F.lit(0)) == 0, "empty"),
            F.when(F.size(invalid_letters(F.col("sequence"), LETTERS)) > 0, "invalid_residue"), F.when(~n.between(least, most), "length"),
        )
    )
    status = F.when(F.col("raw") != F.col("sequence"), "stop_symbol_normalized").otherwise("ok")
    checked = rows.join(copies, F.col("protein_id").eqNullSafe(F.col("pid"))).select("protein_id", "sequence", n.alias("length"), status.alias("qc_status"), reasons.alias("reasons"))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def evidence_faults(hit: Column, fields: list[Column], percents: list[Column], evalue: Column) -> Column:
    """Names of the contract rules that a row of search evidence breaks."""
    present = F.size(F.array_compact(F.array(*[f.cast("string") for f in fields])))
    outside = F.exists(F.array(*[p.cast("double") for p in percents]), lambda p: ~p.between(0.0, 100.0))
    return F.array_compact(
        F.array(
            F.when(hit & (present < len(fields)), "hit_with_missing_field"), F.when(~hit & (present > 0), "no_hit_with_field"),
            F.when(F.coalesce(outside, F.lit(False)), "percent_out_of_range"), F.when(evalue < 0, "negative_evalue"),
        )
    )


def attach_evidence(stage1: DataFrame, search: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stage-1 rows with best sequence and profile hits, absent ones null, whether any hit, whether strong.

    Search identities and coverages come as fractions and leave as percent.
    """
    s = search.select(
        F.col("query").alias("s_id"), F.col("target").alias("mmseqs_target"), (F.col("fident") * 100).alias("mmseqs_identity_percent"),
        (F.col("qcov") * 100).alias("mmseqs_query_coverage_percent"), F.col("evalue").alias("mmseqs_evalue"), F.col("bits").alias("mmseqs_bits"),
    )
    h = profiles.select(F.col("query").alias("h_id"), F.col("profile").alias("hmmer_profile"), F.col("evalue").alias("hmmer_evalue"), F.col("bits").alias("hmmer_bits"))
    joined = stage1.join(s, F.col("protein_id") == F.col("s_id"), "left").join(h, F.col("protein_id") == F.col("h_id"), "left")
    return joined.select(
        stage1["*"], "mmseqs_target", "mmseqs_identity_percent", "mmseqs_query_coverage_percent", "mmseqs_evalue", "mmseqs_bits",
        "hmmer_profile", "hmmer_evalue", "hmmer_bits", (F.col("s_id").isNotNull() | F.col("h_id").isNotNull()).alias("any_hit"),
        D.strong_homology(F.col("mmseqs_evalue"), F.col("mmseqs_identity_percent"), F.col("mmseqs_query_coverage_percent"), F.col("hmmer_evalue")).alias("strong"),
    )


def screen(evidence: DataFrame, score: str, fast: Column, similarity: Column, full: Column) -> DataFrame:
    """Route every row, look at structure scores only where the route asks for them, and fuse."""
    p = F.col(score)
    routed = evidence.withColumn("route", D.route(p, F.col("strong"))["route"])
    routed = routed.withColumn("fast_score", F.when(D.needs_fast_structure(F.col("route")), fast)).withColumn("fast_similarity", F.when(D.needs_fast_structure(F.col("route")), similarity))
    routed = routed.withColumn("rescue", D.rescue_route(F.col("route"), F.col("fast_score"), F.col("fast_similarity")))
    routed = routed.withColumn("full_score", F.when(D.needs_full_structure(F.col("route"), F.col("rescue"), F.col("fast_score")), full))
    fused = D.fuse(p, F.col("fast_score"), F.col("full_score"), F.col("mmseqs_identity_percent"), F.col("mmseqs_query_coverage_percent"), F.col("any_hit"), F.col("strong"))
    return routed.withColumn("f", fused).select("*", "f.*").drop("f")


#: Length of the pieces by which loose keys look for the ids that hold them.
PIECE = 8


def holding_ids(keys: DataFrame, key: str, ids: DataFrame, id_col: str, piece: int = PIECE) -> DataFrame:
    """(key, id) of all ids that hold a key as a substring; empty keys hold nowhere.

    Keys and ids meet by equality of pieces: of a key's pieces of length ``piece`` (itself, if it is shorter) the one that
    the fewest ids hold stands for it, so that few ids are looked at for each key.
    """
    spark = keys.sparkSession
    # Few bytes make many pieces, so they are dealt by number, not by size.
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    k = keys.select(F.col(key).alias("key")).filter(F.length("key") > 0).repartition(width, "key").distinct()
    k = k.withColumn("size", F.least(F.length("key"), F.lit(piece)))
    sizes = sorted(r["size"] for r in k.select("size").distinct().collect())  # at most ``piece`` numbers

    def pieces(text: Column, size: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size)))

    held = ids.select(F.col(id_col).alias("id")).repartition(width, "id").distinct().select("id", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")) if sizes else None
    if held is None:
        return k.select("key", F.lit(None).cast(ids.schema[id_col].dataType).alias("id")).limit(0)
    held = materialize(held.filter(F.length("id") >= F.col("n")).select("id", F.explode(pieces(F.col("id"), F.col("n"))).alias("piece")), "id-pieces")
    often = held.groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    asked = k.select("key", F.explode(pieces(F.col("key"), F.col("size"))).alias("piece"))
    met = asked.join(often, "piece", "left").groupBy("key").agg(F.min_by(F.struct("piece", "times"), F.struct(F.coalesce("times", F.lit(0)), "piece")).alias("p"))
    rare = met.filter("p.times IS NOT NULL").select("key", F.col("p.piece").alias("piece"))
    return rare.join(held, "piece").filter(F.contains("id", "key")).select("key", "id")


def closed_loop(elements: DataFrame, screened: DataFrame, order: str = "protein_id") -> DataFrame:
    """Elements with the category of their protein, found under "<element>_tpase", the element, or the gene id, in
    that order; else under the first protein, by ``order``, whose id contains either, empty ids being contained in none.  A hit score above 1 is normalised.
    """
    result = F.struct("final_category", "transposase_score")
    # One row a protein id, the first of equals.
    p = screened.groupBy("protein_id").agg(F.min(F.struct(F.col(order).alias("_order"), result.alias("hit"))).alias("_p"))
    p = materialize(p.select("protein_id", "_p.*"), "loop-proteins")
    keys = F.array(F.concat("element_id", F.lit("_tpase")), F.col("element_id"), F.col("tpase_gene_id"))
    asked = materialize(elements.select("element_id", F.posexplode(keys).alias("rank", "key")).filter("key IS NOT NULL"), "loop-keys")
    # A key that many elements share is looked up once, and its elements stay where they are.
    often = asked.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    answers = materialize(often.join(p, F.col("key") == F.col("protein_id"), "left").select("key", "times", "hit"), "loop-answers")
    met = join_answers(asked, answers, "key", "times").filter("hit IS NOT NULL")
    exact = materialize(met.groupBy("element_id").agg(F.min(F.struct("rank", "hit"))["hit"].alias("hit")), "loop-exact")
    open_ = elements.join(exact, "element_id", "left_anti").select("element_id", F.explode(F.array("element_id", "tpase_gene_id")).alias("key")).filter(F.length("key") > 0)
    open_ = materialize(open_, "loop-open")
    # The first protein of each key, so that the elements of a key never meet all the proteins that hold it.
    held = holding_ids(open_, "key", p, "protein_id").join(p, F.col("id") == F.col("protein_id"))
    firsts = held.groupBy("key").agg(F.min(F.struct("_order", "protein_id", "hit")).alias("first"))
    often = open_.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("times"))
    firsts = materialize(often.join(firsts, F.col("k") == F.col("key"), "left").select(F.col("k").alias("key"), "times", "first"), "loop-firsts")
    loose = join_answers(open_, firsts, "key", "times").filter("first IS NOT NULL").groupBy("element_id").agg(F.min("first")["hit"].alias("hit"))
    found = elements.join(exact.unionByName(loose), "element_id", "left")
    fallback = F.least(F.lit(1.0), F.when(F.col("tpase_score") > 1, F.col("tpase_score") / 150.0).otherwise(F.col("tpase_score")))
    category = F.coalesce("hit.final_category", F.lit("Uncertain"))
    return found.select(
        elements["*"], category.alias("protein_category"), D.dual_category(F.col("status"), category).alias("dual_category"),
        D.rounded(D.dual_confidence(F.col("composite_score"), F.coalesce("hit.transposase_score", fallback)), 4).alias("dual_confidence"),
    )


# The columns of the three result layouts, in order.
STAGE1_COLUMNS = (
    "protein_id", "length", "sequence_sha256", "qc_status", "profile", "model_key", "classifier_id", "tpase_score", "top_family", "family_score",
    "final_category", "routing_stage", "notes",
)
COMBINED_COLUMNS = (
    *STAGE1_COLUMNS, "mmseqs_hit", "mmseqs_target_id", "mmseqs_identity_percent", "mmseqs_alignment_length", "mmseqs_query_coverage_percent",
    "mmseqs_target_coverage_percent", "mmseqs_evalue", "mmseqs_bitscore", "hmmer_hit", "hmmer_profile_id", "hmmer_full_evalue", "hmmer_full_bitscore",
    "hmmer_domain_evalue", "hmmer_domain_bitscore", "route", "reason_code",
)
RESEARCH_COLUMNS = (
    *COMBINED_COLUMNS, "prostt5_evaluated", "prostt5_score", "prostt5_structure_similarity", "predicted_3di", "structure_evaluated", "mean_plddt",
    "foldseek_hit", "foldseek_target_id", "foldseek_score", "foldseek_evalue", "saprot_score", "transposase_score", "novelty_score",
)


def flattened(records: DataFrame, layout: str = "research") -> DataFrame:
    """Nested records (stage1, search, profile, routing, structure, fusion) as the flat columns of a layout, in its order.

    In the research layout the fused category, stage and notes take the place of the first ones.
    """
    columns = {"stage1": STAGE1_COLUMNS, "combined": COMBINED_COLUMNS, "research": RESEARCH_COLUMNS}[layout]
    fused = ("final_category", "routing_stage", "notes", "transposase_score", "novelty_score")
    parts = {
        **{c: f"stage1.{c}" for c in STAGE1_COLUMNS}, **{c: f"search.{c}" for c in COMBINED_COLUMNS[13:21]}, **{c: f"profile.{c}" for c in COMBINED_COLUMNS[21:27]},
        **{c: f"routing.{c}" for c in COMBINED_COLUMNS[27:]}, **{c: f"structure.{c}" for c in RESEARCH_COLUMNS[29:40]},
    }
    if layout == "research":
        parts |= {c: f"fusion.{c}" for c in fused}
    return records.select(*[F.col(parts[c]).alias(c) for c in columns])
