"""SimHash near-dedup with Golay-code keys.

A fingerprint has three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most 4 bits, then by the pigeonhole principle either one segment is
equal and another differs in at most 2 bits, or every segment differs, two of
them in one bit each (so that a half of each is equal) and the third in at most
2.  A key is the equal part together with a fuzzy key of the third segment: a
Golay codeword near it, of which segments within 2 bits share at least one.
Distinct fingerprints are joined on these keys, verified, and a pair is kept
only under the first kind of key that must find it.

Defined results: a null text is empty; a text without words has fingerprint
zero and is linked like any other; with fewer words than a shingle has, the whole sequence is
the one shingle; very long texts are hashed whole, SLAB shingles at a time; null ids are never a ``component_id``
unless the component has no other; repeated rows are answered alike; an empty table gives an empty result.
A bit that exactly half of the hashes set is 0; of a component the smallest id stands for all.  Other columns than the id and the text, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilome.llm import golay, tables
from mobilome.operators.components import connected_components
from mobilome.operators.joins import join_answers
from mobilome.storage import materialize

MAX_BITS = 4
SEED = 42
#: Shift and width of each segment, and of its two halves.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = (((0, 11), (11, 11)), ((22, 11), (33, 10)), ((43, 11), (54, 10)))
#: Shingles of one text that are held at a time.
SLAB = 65_536
#: Fingerprints of one key that are joined pair by pair at most, and members of one tile beyond that, on average.
CROWD, TILE = 64, 2_048


def _kinds() -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(parts that must be equal, segment that may differ in 2 bits) of each kind of key."""
    kinds = [((SEGMENTS[i],), j) for i in range(3) for j in range(3) if i != j]
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        kinds += [((a, b), k) for a in HALVES[i] for b in HALVES[j]]
    return kinds


KINDS = _kinds()


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit majority of the hashes of all shingles of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - k + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, SLAB):
        z = min(n, a + SLAB)
        hashes = np.fromiter(
            (digest(joined[i:j], SEED) for i, j in zip(starts[a:z].tolist(), ends[a + k - 1 : z + k - 1].tolist())),
            np.uint64,
            z - a,
        )
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint (int64), and the place of the fingerprint of each key."""
    x = fps.view(np.uint64)

    def part(shift: int, width: int) -> np.ndarray:
        return (x >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)

    near = [golay.keys(part(*s)) for s in SEGMENTS]
    keys, places = [], []
    for kind, (equal, fuzzy) in enumerate(KINDS):
        exact = np.zeros(len(x), np.int64)
        for shift, width in equal:
            exact = exact << width | part(shift, width)
        i, j = np.nonzero(near[fuzzy] >= 0)
        keys.append((kind << 34) | exact[i] << 12 | near[fuzzy][i, j])
        places.append(i)
    return np.concatenate(keys), np.concatenate(places)


def _first_kind(differ: Column) -> Column:
    """The first kind of key under which two fingerprints that differ so meet for certain."""

    def bits(shift: int, width: int) -> Column:
        mask = ((1 << width) - 1) << shift
        return F.bit_count(differ.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    found = None
    for kind, (equal, fuzzy) in enumerate(KINDS):
        meets = bits(*SEGMENTS[fuzzy]) <= 2
        for part in equal:
            meets = meets & (bits(*part) == 0)
        found = F.when(meets, kind) if found is None else found.when(meets, kind)
    return found


def _keyed(distinct: DataFrame) -> DataFrame:
    """(key, fp): every fingerprint under all its keys."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for a in range(0, len(fps), 4096):
                keys, place = bucket_keys(fps[a : a + 4096])
                yield pd.DataFrame({"key": keys, "fp": fps[a : a + 4096][place]})

    return distinct.select("fp").mapInPandas(explode, "key long, fp long")


def local_trees(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """(n, 2) edges of a forest that joins what links of at most MAX_BITS join.

    ``a`` and ``b`` are distinct fingerprints (uint64); links inside ``a`` if
    ``b`` is None, else those between ``a`` and ``b``.  A row of ``a`` is compared with all of ``b`` at
    once, but it leaves one edge for each tree that it joins, never one for each link.
    """
    other = a if b is None else b
    both = a if b is None else np.concatenate((a, b))
    shift = 0 if b is None else len(a)
    label = np.arange(len(both))
    edges: list[tuple[int, int]] = []
    for i in range(len(a)):
        first = i + 1 if b is None else 0
        near = np.flatnonzero(np.bitwise_count(other[first:] ^ a[i]) <= MAX_BITS) + first + shift
        near = near[label[near] != label[i]]
        if len(near):
            trees, place = np.unique(label[near], return_index=True)
            edges += [(i, k) for k in near[place].tolist()]
            label[np.isin(label, trees)] = label[i]
    return both[np.array(edges, np.int64).reshape(-1, 2)]


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Trees of the links between two tiles of one key, or inside one tile."""
    i, j = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
    fps, tile = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["tile"].to_numpy()
    found = local_trees(np.sort(fps)) if i == j else local_trees(np.sort(fps[tile == i]), np.sort(fps[tile == j]))
    found = found.view(np.int64)
    return pd.DataFrame({"src": found[:, 0], "dst": found[:, 1]})


def links(distinct: DataFrame, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that differ in at most MAX_BITS bits; they join all that such links join.

    ``distinct`` has the column fp, each value once.  Under a key of at most
    ``crowd`` fingerprints every pair is a row, so a fingerprint has fewer than ``crowd`` of them
    a key.  The members of a larger key are dealt into tiles; every pair
    of tiles is compared whole, and leaves a forest, fewer edges than it has members.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(distinct.select("fp").repartition(parts, "fp"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A fingerprint becomes about 96 rows, which the size of the table does not show: never broadcast them.
    # Few keys have two members, so all that follows reads a small table.
    met = materialize(keyed.hint("merge").join(sizes, "key"), "simhash-met")
    small, large = met.filter(F.col("n") <= crowd), met.filter(F.col("n") > crowd)
    x, y = small.alias("x"), small.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    match = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(differ) <= MAX_BITS)
        & (_first_kind(differ) == F.shiftright("x.key", 34))
    )
    pairs = x.join(y, match).select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    grid = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    dealt = large.select("key", "fp", F.pmod(F.xxhash64("fp"), grid).cast("int").alias("tile"), grid.alias("g"))
    paired = dealt.select("key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select(
        "key", "fp", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")
    )
    return pairs.unionByName(paired.groupBy("key", "ti", "tj").applyInPandas(_tile_links, "src long, dst long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = materialize(links(classes), "simhash-links")
    # A class is known by its smallest id (null last), so that the least class of a component carries the answer.
    name = F.struct(F.col("low").isNull().alias("none"), "low", "fp")
    named = classes.select("fp", name.alias("name"))
    linked = (
        found.join(named.withColumnsRenamed({"fp": "src", "name": "a"}), "src")
        .join(named.withColumnsRenamed({"fp": "dst", "name": "b"}), "dst")
        .select("a", "b")
    )
    stars = connected_components(linked, "a", "b").select(F.col("node.fp").alias("fp"), F.col("component.low").alias("least"))
    owner = classes.join(stars.withColumn("linked", F.lit(True)), "fp", "left").select(
        "fp", "n", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("component_id")
    )
    return join_answers(rows, materialize(owner, "simhash-owner"), "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.read(spark, sf_dir, "documents"))
