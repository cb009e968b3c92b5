"""Scoring and decision rules as column expressions.  The numbers are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families without terminal repeats, and expected element lengths by family.
NON_CANONICAL = ("IS200/IS605", "IS91", "IS110", "IS607")
EXPECTED_LENGTH = {
    "IS1": (650, 1200),
    "IS3": (1100, 1600),
    "IS4": (1200, 1800),
    "IS5": (800, 1600),
    "IS6": (750, 1100),
    "IS21": (1800, 3200),
    "IS30": (1000, 1400),
    "IS66": (2200, 3500),
    "IS91": (1500, 2200),
    "IS110": (1100, 1600),
    "IS200/IS605": (600, 2000),
    "IS256": (1200, 1600),
    "IS481": (900, 1300),
    "IS630": (1000, 1400),
    "IS701": (1200, 1700),
    "IS982": (900, 1200),
    "IS1182": (1300, 1900),
    "IS1380": (1400, 2000),
    "IS1595": (650, 1000),
}
DEFAULT_LENGTH = (700, 3200)
LOW, HIGH = 0.35, 0.70
STRONG_EVALUE, STRONG_IDENTITY, STRONG_COVERAGE = 1e-5, 30.0, 80.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, places: int) -> Column:
    """Half-even rounding of the value without floating-point noise, so that ties fall alike in any engine."""
    return F.bround(F.round(x, 12), places)


def lookup(key: Column, table: dict, field: int, default) -> Column:
    """A small constant table as an expression."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v[field]))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def hit_score(bitscore: Column) -> Column:
    """Transposase score of a profile hit."""
    return F.least(F.lit(1.0), bitscore / 150.0)


def element_scores(
    family: Column, length: Column, orf_length: Column, hit: Column, tir_length: Column, tir_identity: Column,
    tsd_score: Column, stability: Column, complete: Column,
) -> Column:
    """struct of the five part scores, coding density, composite score and status of an element.

    Absent evidence is null.
    """
    length = F.greatest(F.lit(1), length)
    canonical = ~family.isin(*NON_CANONICAL)
    tpase = clamp(hit, 0.0, 1.0)
    boundary = F.when(
        canonical, F.coalesce(tir_identity * F.least(F.lit(1.0), tir_length / 20.0), F.lit(0.15))
    ).otherwise(F.coalesce(clamp(stability / 22.0, 0.2, 1.0), F.lit(0.20)))
    tsd = F.when(canonical, F.coalesce(F.least(F.lit(1.0), tsd_score / 18.0), F.lit(0.05))).otherwise(1.0)
    density = F.least(F.lit(1.0), orf_length / length)
    arch = (
        F.when(density.between(0.50, 0.95), 1.0).when((density >= 0.35) & (density < 0.50), 0.70).when(density > 0.95, 0.85).otherwise(0.40)
    )
    low = lookup(family, EXPECTED_LENGTH, 0, DEFAULT_LENGTH[0])
    high = lookup(family, EXPECTED_LENGTH, 1, DEFAULT_LENGTH[1])
    size = (
        F.when(length.between(low, high), 1.0)
        .when((length >= low * 0.7) & (length <= high * 1.3), 0.75)
        .when((length >= low * 0.5) & (length <= high * 1.8), 0.50)
        .otherwise(0.25)
    )
    score = rounded(clamp(0.35 * tpase + 0.25 * boundary + 0.15 * tsd + 0.15 * arch + 0.10 * size, 0.0, 1.0), 4)
    status = F.when((score >= 0.65) & complete, "complete").when(score >= 0.38, "partial").otherwise("pseudo")
    return F.struct(
        rounded(tpase, 4).alias("tpase_score"), rounded(boundary, 4).alias("boundary_score"), rounded(tsd, 4).alias("tsd_score"),
        arch.alias("architecture_score"), size.alias("length_score"), rounded(density, 3).alias("coding_density"),
        score.alias("composite_score"), status.alias("status"),
    )


def strong_homology(mm_evalue: Column, mm_identity: Column, mm_coverage: Column, hmm_evalue: Column) -> Column:
    """Whether either search alone is strong; identity and coverage in percent, absent hits null."""
    mm = (mm_evalue <= STRONG_EVALUE) & (mm_identity >= STRONG_IDENTITY) & (mm_coverage >= STRONG_COVERAGE)
    return F.coalesce(mm, F.lit(False)) | F.coalesce(hmm_evalue <= STRONG_EVALUE, F.lit(False))


def stage1_category(score: Column, threshold: Column) -> Column:
    """A first score alone never makes a positive."""
    return F.when(score >= threshold, "Uncertain").otherwise("Negative")


def route(score: Column, strong: Column) -> Column:
    """struct(route, reason) after homology evidence."""
    def to(where: str, why: str) -> Column:
        return F.struct(F.lit(where).alias("route"), F.lit(why).alias("reason"))

    return (
        F.when((score < LOW) & strong, to("UNCERTAIN", "conflict"))
        .when(score < LOW, to("REJECT", "low_score"))
        .when((score >= HIGH) & strong, to("ACCEPT_KNOWN", "strong_homology"))
        .when(score >= HIGH, to("STAGE2A", "no_strong_homology"))
        .otherwise(to("UNCERTAIN", "intermediate"))
    )


def rescue_route(initial: Column, score: Column, similarity: Column) -> Column:
    """Route after the fast structure stage; without its score the first route stays."""
    return (
        F.when(score.isNull(), initial)
        .when((score >= HIGH) | (similarity >= HIGH), "STAGE2A")
        .when((score < LOW) & (similarity < LOW), "REJECT")
        .otherwise("STAGE2B")
    )


def needs_fast_structure(initial: Column) -> Column:
    return initial.isin("STAGE2A", "UNCERTAIN")


def needs_full_structure(initial: Column, rescued: Column, score: Column) -> Column:
    return (rescued == "STAGE2B") | ((initial == "STAGE2A") & (score >= 0.60))


def fuse(p: Column, fast: Column, full: Column, identity: Column, coverage: Column, any_hit: Column, strong: Column) -> Column:
    """struct(transposase_score, novelty_score, final_category, routing_stage, notes) from all evidence.

    ``fast`` and ``full`` are structure scores or null; identity and coverage are
    percent or null.
    """
    h = F.coalesce(identity, F.lit(0.0)) / 100.0 * (F.coalesce(coverage, F.lit(0.0)) / 100.0)
    s = F.when(fast.isNotNull() & full.isNotNull(), (fast + full) / 2).otherwise(F.coalesce(fast, full))
    with_structure = (
        F.when(strong, 0.40 * p + 0.35 * s + 0.20 * h + 0.08).when(any_hit, 0.50 * p + 0.42 * s + 0.08 * h).otherwise(0.5 * p + 0.5 * s)
    )
    without = F.when(strong, F.greatest(p, 0.70 * p + 0.30)).otherwise(p)
    score = rounded(clamp(F.when(s.isNotNull(), with_structure).otherwise(without), 0.0, 1.0), 4)
    confidence = F.greatest(p, F.coalesce(s, F.lit(0.0)), score)
    penalty = F.least(F.lit(1.0), F.when(any_hit, h * 1.2).otherwise(0.0))
    penalty = F.when(strong, F.greatest(F.lit(0.85), penalty)).otherwise(penalty)
    novelty = F.when(score < LOW, 0.0).otherwise(rounded(clamp(confidence * (1 - penalty), 0.0, 1.0), 4))

    def final(category: str, stage: str, notes: str) -> Column:
        return F.struct(F.lit(category).alias("final_category"), F.lit(stage).alias("routing_stage"), F.lit(notes).alias("notes"))

    known = F.coalesce(s, F.lit(-1.0))
    verdict = (
        F.when((score >= HIGH) & strong, final("Known-like", "fusion_known_like", "high_confidence_strong_homology"))
        .when((score >= HIGH) & any_hit & (known >= 0.55), final("Remote", "fusion_remote", "high_confidence_weak_homology_supported"))
        .when(
            (score >= HIGH) & (~any_hit | (h < 0.05)) & (known >= 0.65),
            final("Novel_candidate", "fusion_novel_candidate", "high_confidence_structural_support_zero_homology"),
        )
        .when((score >= HIGH) & (known >= 0.55), final("Remote", "fusion_remote", "high_confidence_structural_support"))
        .when(score >= HIGH, final("Uncertain", "fusion_uncertain", "high_score_unverified_structure"))
        .when((score < LOW) & strong, final("Uncertain", "fusion_conflict", "plm_negative_homology_positive_conflict"))
        .when(score < LOW, final("Negative", "fusion_negative", "low_transposase_confidence"))
        .otherwise(final("Uncertain", "fusion_intermediate", "intermediate_multimodal_confidence"))
    )
    return F.struct(
        score.alias("transposase_score"), novelty.alias("novelty_score"), verdict["final_category"].alias("final_category"),
        verdict["routing_stage"].alias("routing_stage"), verdict["notes"].alias("notes"),
    )


def dual_category(status: Column, category: Column) -> Column:
    """Category of an element from the status of its DNA and the category of its protein."""
    whole, new = status == "complete", category.isin("Novel_candidate", "Remote")
    return (
        F.when(whole & new, "High_Confidence_Novel_IS")
        .when(whole & (category == "Known-like"), "High_Confidence_Known_IS")
        .when(~whole & new, "Candidate_Novel_IS")
        .when(whole, "Confirmed_Standard_IS")
        .otherwise("Standard_IS")
    )


def dual_confidence(composite: Column, tpase: Column) -> Column:
    return 0.5 * composite + 0.5 * tpase


def touches_edges(start: Column, end: Column, contig_length: Column, partial_5p: Column, partial_3p: Column) -> Column:
    """struct(left, right): whether an element reaches a contig's ends."""
    return F.struct(((start <= 40) | partial_5p).alias("left"), ((end >= contig_length - 40) | partial_3p).alias("right"))


def truncation_class(
    at_left: Column, at_right: Column, orf_start: Column, orf_end: Column, start: Column, end: Column, contig_length: Column,
    least_up: Column, least_down: Column, supported: Column, complete: Column,
) -> Column:
    """Truncation of an element.

    An ORF at a contig's end, or a boundary within 15 bases of it, cuts that
    side off.  Without ``supported`` (inverted repeats of 8 or more, or a
    structure), so does an ORF nearer to the end than its family's least distance
    or a boundary within 60 bases.
    """
    left = at_left | (start <= 15) | ~supported & ((orf_start < least_up) | (start <= 60))
    right = (
        at_right | (end >= contig_length - 15) | ~supported & ((contig_length - orf_end < least_down) | (end >= contig_length - 60))
    )
    return (
        F.when(at_left & at_right, "edge_both_truncated")
        .when(left & right, "edge_both_truncated")
        .when(left, "edge_5p_truncated")
        .when(right, "edge_3p_truncated")
        .when(complete | supported, "complete")
        .otherwise("internal_partial")
    )


def final_status(truncation: Column, composite_status: Column, bitscore: Column) -> Column:
    """complete or partial by truncation; pseudo only if the composite says so and the hit is weak besides."""
    return (
        F.when((composite_status == "pseudo") & (bitscore < 30), "pseudo")
        .when(truncation == "complete", "complete")
        .otherwise("partial")
    )


def fold_score(n: Column, radius: Column, plddt: Column) -> Column:
    """struct(bitscore, evalue, hit) of a fold from its radius of gyration against the expected one; nulls below ten residues.

    Bits are rounded to one place before they are judged, the e-value to eight.
    """
    expected = 2.8 * F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(0.33))
    ratio = F.least(radius, expected) / F.greatest(radius, expected)
    bits = rounded(100.0 * ratio * plddt / 100.0 + 20.0, 1)
    evalue = F.round(F.greatest(F.lit(1e-30), F.pow(F.lit(10.0), -bits / 15.0)), 8)
    enough = n >= 10
    return F.struct(
        F.when(enough, bits).alias("bitscore"), F.when(enough, evalue).alias("evalue"),
        F.coalesce(enough & (bits >= 40), F.lit(False)).alias("hit"),
    )


def go_status(remote_gain: Column, challenge_fpr: Column, interval_low: Column, orphan_gain: Column) -> Column:
    """Verdict from gains in percentage points, the challenge false-positive rate in percent and the interval's lower end."""
    return (
        F.when((remote_gain >= 10.0) & (challenge_fpr <= 5.0) & (interval_low > 0.0), "GO")
        .when((remote_gain >= 3.0) | (orphan_gain >= 10.0) | (interval_low > 0.0), "CONDITIONAL_GO")
        .otherwise("NO_GO")
    )
