"""Similarity search by shared words or k-mers, as hit tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.functions.sequence import kmers
from mobilome.operators.components import connected_components
from mobilome.operators.portions import portions
from mobilome.storage import materialize

#: One text in so many is looked at for grams that are common; those found so often there are, and at most so many are held.
COMMON_SAMPLE, COMMON_TIMES, COMMON_MOST = 16, 3, 100_000
#: Leading grams that two texts share at least, where they have as many.
LEADING = 3


def _plain(text: Column) -> Column:
    """The words of a text in lower case, with one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def word_grams(text: Column, n: int) -> Column:
    """Distinct n-grams of a text's words, space-joined, in one pass; the whole sequence if it is shorter."""
    plain = _plain(text)
    grams = F.regexp_extract_all(plain, F.lit(rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{n - 1}}})(?![^ ]))"), F.lit(1))
    whole = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(plain))
    return F.when(F.size(grams) == 0, whole).otherwise(F.array_distinct(grams))


def gram_hits(queries: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(query, target, shared, fident, qcov, tcov) of pairs that share a gram; both inputs have (id, text).

    Identity is the shared grams over those of the smaller side, coverages are
    over each side.  Grams meet by equality of 128-bit digests; a gram that is frequent on both sides is a skewed
    key that adaptive execution splits, and pairs are summed by pair.
    """
    def exploded(df: DataFrame, p: str) -> DataFrame:
        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in portions(batches, "plain"):
                found = [_gram_digests(t, n) for t in pdf["plain"]]
                yield pd.DataFrame({"id": pdf["id"], "n": [len(g) for g in found], "gram": found})

        kind = df.schema["id"].dataType.simpleString()
        rows = df.select("id", _plain(F.col("text")).alias("plain")).mapInPandas(grams, f"id {kind}, n int, gram array<binary>")
        return rows.select(F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), F.explode("gram").alias(f"{p}_gram"))

    q, t = exploded(queries, "q"), exploded(targets, "t")
    shared = q.join(t, F.col("q_gram") == F.col("t_gram")).groupBy("q_id", "t_id", "q_n", "t_n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select(
        F.col("q_id").alias("query"), F.col("t_id").alias("target"), "shared", (F.col("shared") / F.least("q_n", "t_n")).alias("fident"),
        (F.col("shared") / F.col("q_n")).alias("qcov"), (F.col("shared") / F.col("t_n")).alias("tcov"),
    )


def equal_signature_edges(rows: DataFrame, id_col: str, signature: Column) -> DataFrame:
    """Edges from every row to the least id of its signature: a star for each group, never all of its pairs."""
    keyed = rows.select(F.col(id_col).alias("id"), signature.alias("sig"))
    least = keyed.groupBy("sig").agg(F.min("id").alias("dst"))
    return keyed.join(least, "sig").filter("id <> dst").select(F.col("id").alias("src"), "dst")


def _each_gram(plain: str, n: int, digest) -> list:
    """``digest`` of the bytes of every gram of ``word_grams``, repeats included, of a text as ``_plain`` gives it."""
    if not plain:
        return []
    text = plain.encode("utf-8", "surrogatepass")
    ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text))
    starts = np.append(0, ends[:-1] + 1)
    k = min(n, len(ends))
    return [digest(text[i:j]) for i, j in zip(starts[: len(ends) - k + 1].tolist(), ends[k - 1 :].tolist())]


def _gram_digests(plain: str, n: int) -> list[bytes]:
    """Distinct 128-bit digests of the grams."""
    return list(set(_each_gram(plain, n, xxhash.xxh3_128_digest)))


def _gram_hashes(plain: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the grams."""
    return np.unique(np.array(_each_gram(plain, n, xxhash.xxh64_intdigest), np.uint64).view(np.int64))


def _leading_grams(texts: DataFrame, sample: DataFrame, n: int, coverage: float) -> DataFrame:
    """(id, n, gram): the grams of each text of which two texts that cover each other share LEADING at least.

    Texts that share a part ``coverage`` of the larger one's grams share LEADING, or all shared ones if fewer, of the
    first n - ceil(coverage n) + LEADING in any order that is one for all texts.  Common grams come last in it, so
    that few texts meet under one; which grams ``sample`` finds common bears on the work, never on the result.
    """
    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches, "plain"):
            yield pd.DataFrame({"gram": np.concatenate([_gram_hashes(t, n) for t in pdf["plain"]] or [np.zeros(0, np.int64)])})

    often = sample.select("plain").mapInPandas(every, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= COMMON_TIMES)
    common = np.array(sorted(x.gram for x in often.orderBy(F.desc("times"), "gram").limit(COMMON_MOST).collect()), np.int64)

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches, "plain"):
            first, size = [], []
            for t in pdf["plain"]:
                g = _gram_hashes(t, n)
                at = np.searchsorted(common, g)
                late = common[np.minimum(at, len(common) - 1)] == g if len(common) else np.zeros(len(g), bool)
                first.append(np.concatenate((g[~late], g[late]))[: len(g) - math.ceil(coverage * len(g) - 1e-9) + LEADING])
                size.append(len(g))
            yield pd.DataFrame({"id": pdf["id"], "n": size, "gram": first})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "plain").mapInPandas(leading, f"id {kind}, n int, gram array<long>").select("id", "n", F.explode("gram").alias("gram"))


def similar_text_edges(docs: DataFrame, n: int = 5, identity: float = 0.3, coverage: float = 0.8) -> DataFrame:
    """Edges (src, dst) that connect all whole texts whose grams meet both thresholds; ``docs`` has (id, text).

    Identity and coverages are those of ``gram_hits``, over 64-bit hashes of the grams.  Texts with the same
    words are one class, linked as a star.  Classes that share leading grams are compared, first with the
    least class of each gram, then with each other unless these edges connect them already: a large
    group of near copies costs its members, not its pairs.  Texts without words are one class; null ids have no edge.
    """
    rows = docs.filter("id IS NOT NULL").select("id", _plain(F.col("text")).alias("plain"))
    key = F.md5("plain")
    copies = materialize(equal_signature_edges(rows, "id", key), "gram-copies")
    lowest = rows.groupBy(key.alias("k")).agg(F.min("id").alias("low"))
    texts = rows.join(lowest, (F.col("id") == F.col("low")) & (key == F.col("k")), "left_semi")
    leading = materialize(_leading_grams(texts, rows.filter(F.pmod(F.xxhash64("id"), F.lit(COMMON_SAMPLE)) == 0), n, coverage), "gram-leading")
    repeated = leading.groupBy("gram").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min_by("n", "id").alias("least_n")).filter("least <> most")
    shared = materialize(leading.join(repeated.select(F.col("gram").alias("g"), "least", "least_n"), F.col("gram") == F.col("g")).drop("g"), "gram-shared")

    @F.pandas_udf("boolean")
    def met(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b):
            x, y = _gram_hashes(x, n), _gram_hashes(y, n)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both > 0 and both / min(len(x), len(y)) >= identity and both / max(len(x), len(y)) >= coverage)
        return pd.Series(found, dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        most = F.max(F.greatest("src_n", "dst_n"))
        enough = F.least(F.lit(LEADING), F.ceil(most * F.lit(coverage) - 1e-9))
        long = pairs.filter(F.least("src_n", "dst_n") / F.greatest("src_n", "dst_n") >= coverage)
        counted = long.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"), enough.alias("enough"))
        pairs = materialize(counted.filter("times >= enough").select("src", "dst"), "gram-pairs")
        ids = pairs.select(F.col("src").alias("i")).union(pairs.select("dst")).distinct()
        own = materialize(rows.join(ids, F.col("id") == F.col("i"), "left_semi").distinct(), "gram-texts")
        x, y = own.select(F.col("id").alias("x"), F.col("plain").alias("x_text")), own.select(F.col("id").alias("y"), F.col("plain").alias("y_text"))
        joined = pairs.join(x, F.col("src") == F.col("x")).join(y, F.col("dst") == F.col("y"))
        return joined.filter(met("x_text", "y_text")).select("src", "dst")

    near = shared.filter("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst"), F.col("n").alias("src_n"), F.col("least_n").alias("dst_n"))
    stars = materialize(verified(near), "gram-stars")
    reached = connected_components(stars)
    rooted = shared.join(reached, F.col("id") == F.col("node"), "left").select("id", "n", "gram", F.coalesce("component", "id").alias("root"))
    x, y = rooted.alias("x"), rooted.alias("y")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= coverage)
    rest = x.join(y, (F.col("x.gram") == F.col("y.gram")) & apart)
    rest = rest.select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), F.col("x.n").alias("src_n"), F.col("y.n").alias("dst_n"))
    return copies.union(stars).union(verified(rest))


def seed_matches(left: DataFrame, right: DataFrame, k: int, keep: int = 4) -> DataFrame:
    """Places (id, left_pos, right_pos) at which k-mers of two flanks of one item are reverse complements.

    Inputs have (id, seq).  Homopolymers do not seed, and of a left k-mer's places only
    the first ``keep`` count.
    """
    from mobilome.functions.sequence import is_homopolymer, reverse_complement

    def exploded(df: DataFrame, p: str) -> DataFrame:
        e = df.select(F.col("id").alias(f"{p}_id"), F.posexplode(kmers(F.col("seq"), k)).alias(f"{p}_pos", f"{p}_word"))
        return e.filter(~is_homopolymer(F.col(f"{p}_word")))

    a = exploded(left, "l").groupBy("l_id", "l_word").agg(F.slice(F.array_sort(F.collect_list("l_pos")), 1, keep).alias("at"))
    a = a.select("l_id", "l_word", F.explode("at").alias("left_pos"))
    b = exploded(right, "r").withColumn("r_word", reverse_complement(F.col("r_word")))
    joined = a.join(b, (F.col("l_id") == F.col("r_id")) & (F.col("l_word") == F.col("r_word")))
    return joined.select(F.col("l_id").alias("id"), "left_pos", F.col("r_pos").alias("right_pos"))
