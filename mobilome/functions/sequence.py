"""Scalar functions over DNA, protein and structure strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base complements, and the residue motifs of the structure alphabet.
COMPLEMENT_FROM = "ACGTUacgtuNn"
COMPLEMENT_TO = "TGCAATGCAANn"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
FOLD_MOTIFS = ("dpdc", "dpdv", "vldv", "vdev", "llaa", "aakv", "lala", "dvde", "devh", "vhll", "dpdp", "pdpd", "avld", "vldk")
PROTEIN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DNA_DIGITS = "ACGT"


def normalised_sha256(s: Column) -> Column:
    """SHA-256 of the sequence in upper case without white space."""
    return F.sha2(F.regexp_replace(F.upper(s), r"\s+", ""), 256)


def upper_sha256(s: Column) -> Column:
    """SHA-256 of the sequence in upper case, white space kept."""
    return F.sha2(F.upper(s), 256)


def reverse_complement(s: Column) -> Column:
    """Lower-case bases come out in upper case; n stays n."""
    return F.reverse(F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO))


def gc_fraction(s: Column) -> Column:
    """Share of G and C; 0.5 for an empty sequence."""
    gc = F.length(s) - F.length(F.translate(F.upper(s), "GC", ""))
    return F.when(F.length(s) == 0, F.lit(0.5)).otherwise(F.try_divide(gc.cast("double"), F.length(s)))


def letters_of(s: Column) -> Column:
    """The characters of a string as an array.

    Taking a character of a long string by its place means counting from the
    start each time; an array does not.
    """
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, left to right, in one pass; none for shorter sequences."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def is_homopolymer(s: Column) -> Column:
    """Whether at most one letter occurs."""
    return F.length(F.replace(s, F.substr(s, F.lit(1), F.lit(1)), F.lit(""))) == 0


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences differ, over the shorter length."""
    differs = F.zip_with(letters_of(a), letters_of(b), lambda x, y: x != y)
    return F.size(F.filter(differs, lambda d: d))


def interval_sequence(s: Column, start: Column, end: Column) -> Column:
    """The stretch [start, end) of a sequence, 0-based."""
    return F.substr(s, start + 1, F.greatest(end - start, F.lit(0)))


def clean_family(s: Column) -> Column:
    """A family name with everything but letters and digits turned into underscores."""
    return F.regexp_replace(s, r"[^\p{Alnum}]", "_")


def strip_model_prefix(s: Column) -> Column:
    return F.replace(s, F.lit("Tpase_"), F.lit(""))


def md5_seed(s: Column) -> Column:
    """A number from the first eight hex digits of the MD5, the same in any engine."""
    return F.conv(F.substr(F.md5(s), F.lit(1), F.lit(8)), 16, 10).cast("long")


def random_dna(seed: Column, n: int, gc: Column) -> Column:
    """n bases with the given GC share, drawn from MD5 digits of seed and place."""
    def base(i: Column) -> Column:
        u = md5_seed(F.concat_ws(":", seed, i.cast("string"))) / F.lit(4294967296.0)
        at = (F.lit(1.0) - gc) / 2
        return F.when(u < at, "A").when(u < at + gc / 2, "C").when(u < at + gc, "G").otherwise("T")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), base), "")


def structure_tokens(protein: Column) -> Column:
    """Structure letters of a protein: residues in lower case, anything else a; d or e before d or e is d."""
    plain = F.lower(F.regexp_replace(F.upper(protein), f"[^{RESIDUES}]", "A"))
    # The first and the last residue have no neighbour on both sides and stay as they are.
    inner = F.regexp_replace(plain, r"(?<=.)[de](?=[de])", "d")
    return inner


def structure_scores(protein: Column, tokens: Column) -> Column:
    """struct(score, similarity) of a fold from motif density and acidic residues."""
    n = F.length(protein)
    windows = kmers(tokens, 4)
    hits = F.size(F.filter(windows, lambda w: w.isin(*FOLD_MOTIFS)))
    density = F.least(F.lit(1.0), F.try_divide(hits.cast("double"), F.greatest(n - 3, F.lit(1))) * 15.0)
    # The last two residues do not count.
    inner = F.substr(F.upper(protein), F.lit(1), F.greatest(n - 2, F.lit(0)))
    acid = F.size(
        F.filter(F.zip_with(letters_of(inner), letters_of(tokens), lambda a, t: a.isin("D", "E") & t.isin("d", "e", "p")), lambda x: x)
    )
    acidic = F.least(F.lit(1.0), acid / F.greatest(F.lit(1.0), n * F.lit(0.05)))
    score = sigmoid(F.lit(6.0) * (F.lit(0.5) * density + F.lit(0.5) * acidic - F.lit(0.45)))
    similarity = F.least(F.lit(1.0), F.greatest(F.lit(0.1), density * 0.8 + 0.2))
    short = F.length(tokens) < 4
    return F.struct(
        F.when(short, 0.5).otherwise(score).alias("score"), F.when(short, 0.5).otherwise(similarity).alias("similarity")
    )


def _pairs(protein: Column, tokens: Column, pair) -> Column:
    """``pair`` of residue and structure letter at every place of the shorter string."""
    both = F.zip_with(letters_of(protein), letters_of(tokens), pair)
    return F.filter(both, lambda x: x.isNotNull())


def bimodal_tokens(protein: Column, tokens: Column) -> Column:
    """Residue and structure letter side by side, in pairs joined by spaces, over the shorter length."""
    return F.array_join(_pairs(protein, tokens, lambda a, t: F.concat(a, t)), " ")


def bimodal_score(protein: Column, tokens: Column) -> Column:
    """Agreement of residues and structure letters: +2 acidic, +1 hydrophobic, +1 basic, averaged, through a sigmoid."""
    n = F.least(F.length(protein), F.length(tokens))

    def gain(a: Column, t: Column) -> Column:
        return (
            F.when(a.isin("D", "E") & t.isin("d", "e", "p"), 2.0)
            .when(a.isin("V", "L", "I", "A") & t.isin("v", "l", "i", "a"), 1.0)
            .when(a.isin("K", "R") & t.isin("k", "r", "p"), 1.0)
            .otherwise(0.0)
        )

    total = F.aggregate(_pairs(protein, tokens, gain), F.lit(0.0), lambda acc, x: acc + x)
    return sigmoid(F.lit(5.0) * (total / F.greatest(n, F.lit(1)) - F.lit(0.35)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bit_sigmoid(bits: Column, middle: float = 30.0, scale: float = 10.0) -> Column:
    """A bit score as a chance: one half at ``middle``."""
    return sigmoid((bits - F.lit(middle)) / F.lit(scale))


def invalid_letters(s: Column, allowed: str) -> Column:
    """The distinct letters of a sequence that are not allowed, in order."""
    letters = F.array_distinct(F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != ""))
    return F.array_sort(F.array_except(letters, F.array(*[F.lit(c) for c in allowed])))


def model_input(s: Column, layout: str) -> Column:
    """A protein as a model wants it: "standard", "hashed" (every residue followed by #) or "spaced"."""
    if layout == "hashed":
        return F.regexp_replace(s, "(.)", "$1#")
    if layout == "spaced":
        return F.array_join(F.split(s, ""), " ")
    return s


def inverted_repeat_length(note: Column) -> Column:
    """Length in an inverted-repeat note: of "a/b" the b, else the first number; only above 3; else null."""
    text = F.trim(note)
    number = F.coalesce(
        F.nullif(F.regexp_extract(text, r"^\s*\d+\s*/\s*(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")),
    ).try_cast("int")
    return F.when(number > 3, number)


def direct_repeat_length(note: Column, default: Column) -> Column:
    """Length in a direct-repeat note if between 2 and 20, else the family's default."""
    number = F.nullif(F.regexp_extract(F.trim(note), r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(number.between(2, 20), number).otherwise(default)


def primary_orf(note: Column, length: Column) -> Column:
    """struct(start, end, strand) of the longest "aa (a - b)" of a note, 0-based; else 15 % to 85 % of the element."""
    pattern = r"(\d+)\s*\(\s*(\d+)\s*-\s*(\d+)\s*\)"

    def column(group: int) -> Column:
        return F.transform(F.regexp_extract_all(note, F.lit(pattern), F.lit(group)), lambda x: x.cast("int"))

    listed = F.arrays_zip(column(1).alias("aa"), column(2).alias("a"), column(3).alias("b"))
    ordered = F.transform(
        listed,
        lambda o, i: F.struct(
            o["aa"].alias("aa"), (-i).alias("turn"), (F.least(o["a"], o["b"]) - 1).alias("start"),
            F.greatest(o["a"], o["b"]).alias("end"), F.when(o["a"] <= o["b"], "+").otherwise("-").alias("strand"),
        ),
    )
    best = F.array_max(ordered)
    fallback = F.struct(
        F.floor(length * 0.15).cast("int").alias("start"), F.floor(length * 0.85).cast("int").alias("end"), F.lit("+").alias("strand")
    )
    found = F.struct(best["start"].alias("start"), best["end"].alias("end"), best["strand"].alias("strand"))
    return F.when(best.isNull(), fallback).otherwise(found)


def first_motif(s: Column, patterns: tuple[str, ...]) -> Column:
    """struct(start, end, text) of the first of ordered patterns that occurs, 0-based, null if none does."""
    found = None
    for p in patterns:
        at = F.regexp_instr(s, F.lit(p))
        text = F.regexp_extract(s, f"({p})", 1)
        hit = F.struct((at - 1).alias("start"), (at - 1 + F.length(text)).alias("end"), text.alias("text"), F.lit(p).alias("pattern"))
        found = F.when(at > 0, hit) if found is None else found.when(at > 0, hit)
    return found


def first_motif_in_band(s: Column, motifs: tuple[str, ...], anchor: Column, low: int, high: int) -> Column:
    """Leftmost 0-based place of the first ordered plain motif whose distance from ``anchor`` is within the band."""

    def leftmost(m: str) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(s) - len(m), F.lit(0)))
        return F.array_min(F.filter(places, lambda i: (F.substr(s, i + 1, F.lit(len(m))) == m) & (anchor - i).between(low, high)))

    return F.coalesce(*map(leftmost, motifs))
