"""Multiple alignment of many families at once, level by level.

A family's members are ordered by how many of their words the others hold, so that like stands beside like, and neighbours are merged pair by
pair: a level aligns the groups of all families, two by two, and halves their number.  A group is known by its columns' counts alone; members carry
the column of each residue and only learn, level by level, where their group's columns went.  So no family, however many members
it has, is ever one row or one group: what is aligned is as long as a sequence.

Defined results: null families, ids and sequences take no part; a family of one member is its sequence; letters are taken in upper case; repeated rows are
members of their own; equal worths are ordered by id; empty inputs give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.functions import alignment_kernels as A
from mobilome.functions.sequence import kmers
from mobilome.operators.datasets import ranked
from mobilome.storage import discard, materialize

#: Letters of the words that members are ordered by, and pairs of groups that one task merges on average.
WORD, TASK_PAIRS = 3, 200
_GROUP = "family string, number long, counts binary"


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(-1, 22).copy()


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, where a's columns went, where b's went) of two aligned groups."""
    at, to, _ = A.column_path(A.column_scores(a, b))
    where_a, where_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    place = i = j = 0
    for x, y in [*zip(at.tolist(), to.tolist()), (len(a), len(b))]:
        for where, start, stop in ((where_a, i, x), (where_b, j, y)):
            where[start:stop] = np.arange(place, place + stop - start)
            place += stop - start
        if x < len(a) and y < len(b):
            where_a[x] = where_b[y] = place
            place += 1
        i, j = x + 1, y + 1
    counts = np.zeros((place, 22))
    counts[where_a] += a
    counts[where_b] += b
    sizes = a.sum(1).max(initial=0) + b.sum(1).max(initial=0)
    counts[:, 21] += sizes - counts.sum(1)
    return counts, where_a, where_b


def _single(sequence: str) -> np.ndarray:
    counts = np.zeros((len(sequence), 22))
    counts[np.arange(len(sequence)), A.encoded(sequence)] = 1
    return counts


def ordered_members(proteins: DataFrame, family: str, id_col: str, sequence: str, k: int = WORD) -> DataFrame:
    """(family, id, sequence, place): members in the order of their mean share of words, from 0 within the family."""
    rows = proteins.select(F.col(family).cast("string").alias("family"), F.col(id_col).cast("string").alias("id"), F.upper(F.col(sequence)).alias("sequence"))
    rows = materialize(rows.filter("family IS NOT NULL AND id IS NOT NULL AND sequence <> ''").withColumn("row", F.monotonically_increasing_id()), "alignment-members")
    own = rows.select("family", "row", F.explode(F.array_distinct(kmers(F.col("sequence"), k))).alias("word"))
    shared = own.groupBy("family", "word").agg(F.count(F.lit(1)).alias("n"))
    worth = own.join(shared, ["family", "word"]).groupBy("row").agg(F.round(F.sum("n") / F.count(F.lit(1)), 9).alias("worth"))
    named = rows.join(worth, "row", "left").select("family", "id", "row", F.coalesce("worth", F.lit(0.0)).alias("worth"))
    placed = ranked(named, [F.col("family"), F.desc("worth"), F.col("id"), F.col("row")], "_seat")
    first = placed.groupBy(F.col("family").alias("_f")).agg(F.min("_seat").alias("_first"))
    places = placed.join(first, F.col("family") == F.col("_f")).select("row", (F.col("_seat") - F.col("_first")).alias("place"))
    return rows.join(places, "row").select("family", "id", "sequence", "place")


def align_families(proteins: DataFrame, family: str, id_col: str, sequence: str, k: int = WORD) -> DataFrame:
    """(family, id, aligned): every member over the columns of its family's alignment, with - for gaps."""
    members = ordered_members(proteins, family, id_col, sequence, k)
    positions = F.sequence(F.lit(0), F.length("sequence") - 1).cast("array<long>")
    current = materialize(members.withColumn("number", F.col("place")).withColumn("columns", positions), "alignment-columns")

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"family": pdf["family"], "number": pdf["place"], "counts": [_single(s).tobytes() for s in pdf["sequence"]]})

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                counts, where_a, where_b = merged(_unpacked(r.left), _unpacked(r.right))
                rows.append((r.family, r.pair, counts.tobytes(), where_a, where_b))
            yield pd.DataFrame(rows, columns=["family", "pair", "counts", "where_left", "where_right"])

    groups = materialize(current.select("family", "place", "sequence").mapInPandas(begun, _GROUP), "alignment-groups")
    while True:
        pairs = groups.filter("number % 2 = 1").count()
        if not pairs:
            break
        even, odd = groups.filter("number % 2 = 0"), groups.filter("number % 2 = 1")
        pair = F.expr("number div 2").alias("pair")
        both = even.select("family", pair, F.col("counts").alias("left")).join(odd.select("family", pair, F.col("counts").alias("right")), ["family", "pair"])
        both = both.repartition(1 + pairs // TASK_PAIRS, "family", "pair")
        done = materialize(both.mapInPandas(level, "family string, pair long, counts binary, where_left array<long>, where_right array<long>"), "alignment-level")
        # Where the columns of each group that was merged went.
        sides = [done.select(F.col("family").alias("_f"), (F.col("pair") * 2 + side).alias("_n"), F.col(name).alias("went")) for side, name in ((0, "where_left"), (1, "where_right"))]
        moved = current.join(sides[0].union(sides[1]), (F.col("family") == F.col("_f")) & (F.col("number") == F.col("_n")), "left")
        columns = F.when(F.col("went").isNull(), F.col("columns")).otherwise(F.transform("columns", lambda c: F.get("went", c.cast("int"))))
        before, current = current, materialize(moved.select("family", "id", "sequence", "place", F.expr("number div 2").alias("number"), columns.alias("columns")), "alignment-columns")
        alone = even.join(done.select("family", F.col("pair").alias("_p")), (even["family"] == done["family"]) & (F.expr("number div 2") == F.col("_p")), "left_anti")
        left, groups = groups, materialize(done.select("family", F.col("pair").alias("number"), "counts").union(alone.select("family", F.expr("number div 2"), "counts")), "alignment-groups")
        for spent in (before, left, done):
            discard(spent)
    widths = groups.select("family", (F.length("counts") / (22 * 8)).cast("int").alias("width"))

    @F.pandas_udf("string")
    def row(sequence: pd.Series, columns: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for s, c, w in zip(sequence, columns, width):
            letters = np.full(w, "-", "<U1")
            letters[np.asarray(c)] = list(s)
            out.append("".join(letters))
        return pd.Series(out)

    return current.join(widths, "family").select("family", "id", row("sequence", "columns", "width").alias("aligned"))


def pair_scores(aligned: DataFrame) -> DataFrame:
    """(family, members, columns, conserved): the size of each alignment, and the columns in which all members have the same residue."""
    letters = aligned.select("family", "id", F.posexplode(F.split("aligned", "")).alias("column", "letter"))
    counts = letters.groupBy("family", "column").agg(F.count(F.lit(1)).alias("n"), F.min("letter").alias("low"), F.max("letter").alias("high"))
    return counts.groupBy("family").agg(F.max("n").alias("members"), F.count(F.lit(1)).alias("columns"), F.count_if((F.col("low") == F.col("high")) & (F.col("low") != "-")).alias("conserved"))
