"""Row filters and classifiers of dataset preparation: roles, lengths, organisms, keywords, input shape, strict maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Organism terms that exclude a protein (plain substrings), keywords that exclude, and keywords of the hard and easy tiers.
EXCLUDED_ORGANISMS = (
    "human", "homo sapiens", "mus musculus", "mouse", "rat", "rattus", "drosophila", "arabidopsis", "caenorhabditis", "saccharomyces", "yeast",
    "danio rerio", "zebrafish", "xenopus", "gallus gallus", "chicken",
)
EXCLUDED_KEYWORDS = ("transposase", "transposable element", "insertion sequence", "mobile element", "isfinder")
HARD_KEYWORDS = (
    "integrase", "recombinase", "resolvase", "invertase", "nuclease", "helicase", "rnase h", "dna repair", "plasmid", "phage", "endonuclease",
)
EASY_KEYWORDS = (
    "ribosomal protein", "atp synthase", "dna-directed rna polymerase", "glyceraldehyde-3-phosphate dehydrogenase", "enolase", "elongation factor",
    "tryptophan synthase", "pyruvate kinase", "phosphoglycerate kinase",
)
# Classes of hard negatives, tried in this order as whole words, and the words that exclude.
CHALLENGE_CLASSES = (
    ("ruvc_nuclease", "ruvc|crossover junction endodeoxyribonuclease ruvc"),
    ("rnase_h", "ribonuclease h|rnase h"),
    ("tyrosine_recombinase", "tyrosine recombinase|xerc|xerd|site-specific recombinase xer"),
    ("serine_recombinase", "serine recombinase|resolvase|invertase|cin invertase|gin invertase"),
    ("phage_integrase", "phage integrase|prophage integrase|integrase family protein"),
    ("dna_repair_nuclease", r"exodeoxyribonuclease|recj|uvrc|uvrb|endodeoxyribonuclease\s+[ivx]+|dna repair protein"),
    ("helicase", "dna helicase|uvrd|recq|recd|recb|pcrb helicase"),
    ("huh_endonuclease", "rolling-circle replication initiator|rep protein|rep-associated|mob protein"),
    ("plasmid_partition", "plasmid partition|parb|para|plasmid segregation"),
)
CHALLENGE_EXCLUDED = "transposase|transposable element|insertion sequence|isfinder|pseudogene"
#: Contigs shorter than this are fragments, and so many records are looked at.
GENOME_LENGTH, PEEKED = 100_000, 5


def has_role(role: Column, wanted: str = "transposase") -> Column:
    return F.coalesce(F.lower(role) == wanted, F.lit(False))


def length_band(sequence: Column, least: int = 80, most: int = 1500) -> Column:
    return F.coalesce(F.length(sequence).between(least, most), F.lit(False))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any of the terms as a plain substring, whatever the case; null holds none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(lower, t))


def allowed_organism(organism: Column) -> Column:
    return ~contains_any(organism, EXCLUDED_ORGANISMS)


def keyword_tier(description: Column, hard: Sequence[str] = HARD_KEYWORDS, easy: Sequence[str] = EASY_KEYWORDS) -> Column:
    """hard, easy or general: the first tier of which a keyword occurs."""
    return F.when(contains_any(description, hard), "hard").when(contains_any(description, easy), "easy").otherwise("general")


def negative_pools(proteins: DataFrame, description: str, organism: str, sequence: str, least: int = 80, most: int = 1500) -> DataFrame:
    """Candidates for negatives with ``pool``: in the length band, of an allowed organism, without an excluding keyword."""
    kept = proteins.filter(length_band(F.col(sequence), least, most) & allowed_organism(F.col(organism)) & ~contains_any(F.col(description), EXCLUDED_KEYWORDS))
    return kept.withColumn("pool", keyword_tier(F.col(description)))


def challenge_class(description: Column) -> Column:
    """The first class whose words occur; null for none and for excluded descriptions."""
    found = F.when(F.coalesce(description, F.lit("")).rlike(rf"(?i)\b({CHALLENGE_EXCLUDED})\b"), F.lit(None).cast("string"))
    for name, words in CHALLENGE_CLASSES:
        found = found.when(description.rlike(rf"(?i)\b({words})\b"), name)
    return found


def is_fragmented(contigs: DataFrame, order: Sequence[str], sequence: str = "sequence") -> bool:
    """Whether an input is a draft or a metagenome: more than one of the first five records, or any of them short."""
    first = contigs.select(*order, F.length(sequence).alias("_n")).orderBy(*order).limit(PEEKED)
    row = first.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.min("_n"), F.lit(0)).alias("least")).first()
    return row["k"] > 1 or (row["k"] == 1 and row["least"] < GENOME_LENGTH)


def strict_map(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of their key; a key that is missing from the table is an error that names it."""
    t = table.select(F.col(table_key).alias("_key"), F.col(value).alias(value), F.lit(True).alias("_met"))
    joined = rows.join(t, F.col(key) == F.col("_key"), "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.when(F.col("_met"), F.col(value)).otherwise(missing)).drop("_key", "_met")


def enriched_family(metadata: Column, header: Column | None = None) -> Column:
    """A DNA record's family is its metadata's, else its header's; a protein's is its metadata's, else Unknown."""
    known = F.nullif(F.trim(metadata), F.lit(""))
    return F.coalesce(known, header) if header is not None else F.coalesce(known, F.lit("Unknown"))


def homology_strata(identity: Column, kind: Column) -> dict[str, Column]:
    """The strata of remote homology; an absent identity counts as none."""
    i = F.coalesce(identity, F.lit(0.0))
    return {
        "Overall": F.lit(True), "Remote30": i < 0.30, "Remote20": i < 0.20,
        "NoFullLength": F.coalesce(kind.isin("NO_FULL_LENGTH_HOMOLOG", "L3_DOMAIN_ONLY"), F.lit(False)),
    }


def selected_names(test: DataFrame, validation: DataFrame, proteins: DataFrame, special: str = "IS200/IS605") -> DataFrame:
    """Distinct names of elements to be tested: those of test positives, and of validation positives of a special family."""
    names = proteins.select("tpase_id", "is_name")

    def of(split: DataFrame) -> DataFrame:
        return split.select("seq_id").join(names, F.col("seq_id") == F.col("tpase_id")).select("is_name")

    positive = F.col("label") == 1
    return of(test.filter(positive)).union(of(validation.filter(positive & (F.col("family") == special)))).distinct()


def capped_by_family(elements: DataFrame, family: str, id_col: str, most: int = 400, special: Sequence[str] = (), special_most: int = 60, seed: str = "42") -> DataFrame:
    """At most ``most`` elements where there are more, spread over families: max(10, most / families) each, ``special_most`` of a special one.

    This is a sampling operator: members are taken in MD5 order.
    """
    from mobilome.operators.datasets import ranked

    total = elements.count()
    if total <= most:
        return elements
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    placed = ranked(elements.withColumn("_order", order), [F.col(family), F.col("_order"), F.col(id_col)], "_place")
    first = placed.groupBy(F.col(family).alias("_f")).agg(F.min("_place").alias("_first"))
    each = max(10, most // max(1, first.count()))
    quota = F.when(F.col(family).isin(*special), special_most).otherwise(each) if special else F.lit(each)
    joined = placed.join(first, F.col(family).eqNullSafe(F.col("_f")))
    return joined.filter(F.col("_place") - F.col("_first") < quota).drop("_order", "_place", "_f", "_first")
