"""Spelling variants: words one edit apart, and the frequent form that each rare one stands for.

Words are counted in one pass over whole texts; a task adds up its own words before anything is shuffled.  A word of length
l is cut evenly into two segments, of l // 2 code points and the rest.  One edit leaves a segment as it is, so two words of
length l that differ by a replacement share a segment at its place, and a word that is one longer holds a segment of the
shorter either at the same place or, if it is the second, one further on.  Words are indexed under their two segments and
probe the index with two segments of their own length and two of one less; a pair counts under its first shared segment only, so
no pair comes twice, and it is verified by its edit distance.

Under a segment that more than ``tile`` words share, the index is dealt over tiles and the probes are repeated to each of them, so that no
task meets all of its words.  Candidates are verified where they meet and links are summed by word at once; nothing collects a
word's neighbours.  Forms have at least ``ratio`` times the count of their word, so chains of forms are short; they are
followed by doubling.

Defined results: a null text has no words; a null id counts as an empty one in the deletion rule; a very long text is read
whole; repeated rows count as often as they occur; of near words with the same count the smallest in code-point order is the
form; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.storage import discard, materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Every so many-th run of a document, by hash, loses a code point.
DELETED = 199
#: Words of one segment that a tile of the index holds on average.
TILE = 2_000
#: Words whose candidates one task verifies on average: they are few bytes and much work, so Spark would put too many together.
TASK_WORDS = 15_000
#: Distinct words that a task adds up before it passes them on.
HELD_WORDS = 1_000_000


def _words(least: int, deleted: int):
    run_of = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)

    def passed_on(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                # Lower-casing bytes changes A-Z alone.
                found = Counter(run_of.findall(text.encode().lower().decode()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                cut = [(w, h) for w in found if not (h := zlib.crc32(w.encode(), start)) % deleted]
                for w, h in cut:
                    n, at = found.pop(w), h % len(w)
                    if len(w) > least:
                        held[w[:at] + w[at + 1 :]] += n
                held.update(found)
            if len(held) > HELD_WORDS:
                yield passed_on(held)
                held = Counter()
        yield passed_on(held)

    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED
) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur at least ``least_count`` times, after the deletion rule."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_words(least_length, deleted), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _keys(word: str, of_length: Column, shift: Column | int) -> Column:
    """Hashes of the two segments that words of ``of_length`` have, the second read ``shift`` further on."""
    half = (of_length / 2).cast("int")
    first = F.substring(F.col(word), F.lit(1), half)
    second = F.substring(F.col(word), half + 1 + shift, of_length)
    return F.array(F.xxhash64(of_length, F.lit(0), first), F.xxhash64(of_length, F.lit(1), second))


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, n_a, b, n_b): every two words that differ by one inserted, deleted or replaced code point, each pair once.

    ``words`` has each word once and is read several times: pass a written table.
    """
    length = F.length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys("word", length, 0)).alias("key"))
    probe = words.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(_keys("word", length, 0), _keys("word", length - 1, 1))).alias("key")
    )
    crowded = index.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > tile)
    tiles = crowded.select("key", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    n_tiles = F.coalesce("tiles", F.lit(1))
    dealt = index.join(tiles, "key", "left").select("a", "n_a", "key", F.pmod(F.xxhash64("a"), n_tiles).cast("int").alias("tile"))
    asked = probe.join(tiles, "key", "left").select("b", "n_b", "key", F.explode(F.sequence(F.lit(0), n_tiles - 1)).alias("tile"))
    parts = 1 + words.count() // TASK_WORDS
    met = dealt.repartition(parts, "key", "tile").join(asked.repartition(parts, "key", "tile"), ["key", "tile"])
    size_a, size_b = F.length("a"), F.length("b")
    half = (size_a / 2).cast("int")
    first = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    second = F.substring(F.col("a"), half + 1, size_a) == F.substring(F.col("b"), half + 1 + size_b - size_a, size_a)
    ordered = (size_b == size_a + 1) | ((size_b == size_a) & (F.col("a") < F.col("b")))
    # Which segment brought the pair together: the first if it is shared, so that the second counts only where the first is not.
    by_first = F.col("key") == F.xxhash64(size_a, F.lit(0), F.substring("a", F.lit(1), half))
    found = met.filter(ordered & F.when(by_first, first).otherwise(second & ~first))
    return found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root): the last form of each word; ``forms`` has (word, form), and ``most`` is the largest count of a form.

    Counts grow by ``ratio`` from form to form, so no chain is longer than the logarithm of ``most``, and each round doubles what is followed.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    longest = 1 + math.log(max(most, 1), ratio)
    for _ in range(math.ceil(math.log2(longest + 1))):
        after = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, current = current, materialize(current.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(before)
    return current


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    ratio: int = RATIO, deleted: int = DELETED, tile: int = TILE,
) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    ``n_near`` is how many words are near; ``form`` is the most frequent of them, null unless it occurs ``ratio`` times as often as the word;
    ``root`` is the last form that forms lead to, the word itself without one.
    """
    words = materialize(count_words(docs, id_col, text_col, least_length, least_count, deleted), "words")
    pairs = near_pairs(words, tile)
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("near")),
        )
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "near"))
    near = (
        pairs.select(ends.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))
    )
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        ),
        "near",
    )
    most = known.agg(F.max("form_n")).first()[0]
    last = roots(known.filter(F.col("form").isNotNull()), most or 1, ratio)
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(tables.read(spark, sf_dir, "documents"))
