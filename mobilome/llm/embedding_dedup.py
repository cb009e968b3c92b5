"""Embedding near-dedup: exhaustive tiled comparison in PCA order.

Equal vectors of one label are one class, so that copies cost nothing.  Vectors
are rotated so that leading dimensions hold most of their length.  The classes
of a label are dealt into tiles of bounded size and every pair of tiles is one
group; within it, products of leading dimensions are accumulated for all pairs,
what the remaining dimensions can add is bounded by the product of suffix norms
(Cauchy-Schwarz), and a pair is dropped when it cannot reach the threshold any
more.  Survivors are decided by the cosine of the given vectors in double precision.

Only counts and one tree of links per local component leave a tile pair; never
all pairs of a group.

Vectors are scaled by a power of two before anything is squared, which changes
no digit, so that very small and very large components neither vanish nor
overflow.

Defined results: a vector whose label is null, or that is null, empty, zero or
holds a null or non-finite component, links with nothing; vectors of unequal
length never link, and length is bounded by the d x d moments alone; equal rows count as other vectors of each other; null ids
are never a ``component_id`` unless the component has no other; an empty table
gives an empty result.  A cosine of exactly the threshold is a link; of equal vectors the smallest id stands for all.  Other columns than the three
named, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables
from mobilome.operators.components import connected_components
from mobilome.operators.joins import join_answers
from mobilome.storage import materialize

THRESHOLD = 0.93
#: Most classes in a tile, on average; a task holds two tiles.
TILE = 4096
#: Rows of one tile that are compared with the other tile at a time.
SLAB = 256
#: Dimensions that are accumulated in the first step; each step doubles them.
LEADING = 8
#: Pairs that are decided at a time.
DECIDED = 65_536
#: Slack of the bound against rounding.
EPSILON = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` times powers of two, so that the largest component of each lies in [0.5, 1)."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, an orthogonal matrix whose first columns hold most of the unit vectors' energy.

    The second moments of all vectors are summed in the cluster; only the
    matrix itself, length x length, comes to the driver.
    """

    def moments(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, own in pdf["embedding"].groupby(pdf["dim"]):
                x = scaled(np.array(own.tolist(), np.float64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                held[d] = held.get(d, 0) + x.T @ x
        for d, m in held.items():
            yield pd.DataFrame({"dim": int(d), "cell": np.arange(m.size), "value": m.ravel()})

    cells = (
        classes.select("dim", "embedding")
        .mapInPandas(moments, "dim int, cell int, value double")
        .groupBy("dim", "cell")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    axes = {}
    for d, own in cells.groupby("dim"):
        m = np.zeros(int(d) * int(d))
        m[own["cell"]] = own["value"]
        assert np.isfinite(m).all(), "moments of unit vectors are finite"
        axes[int(d)] = np.linalg.eigh(m.reshape(int(d), int(d)))[1][:, ::-1]
    return axes


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, axes: np.ndarray):
    """Yield (i, j): rows of ``a`` and ``b`` (float64) whose cosine is at least ``threshold``."""
    a, b = scaled(a), scaled(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    d = a.shape[1]
    cuts = [0]
    while cuts[-1] < d:
        cuts.append(min(d, max(LEADING, 2 * cuts[-1])))

    def suffix(r: np.ndarray) -> dict[int, np.ndarray]:
        energy = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]
        return {c: np.sqrt(energy[:, c]) if c < d else np.zeros(len(r)) for c in cuts}

    sa, sb = suffix(ra), suffix(rb)
    for lo in range(0, len(a), SLAB):
        hi = min(len(a), lo + SLAB)
        part = np.zeros((hi - lo, len(b)))
        pairs = None
        for x, y in zip(cuts[:-1], cuts[1:]):
            if pairs is None:
                part += ra[lo:hi, x:y] @ rb[:, x:y].T
                open_ = part + np.outer(sa[y][lo:hi], sb[y]) >= threshold - EPSILON
                if open_.sum() * 8 <= open_.size:  # few are left: go on pair by pair
                    i, j = np.nonzero(open_)
                    pairs, part = (i + lo, j), part[i, j]
            else:
                i, j = pairs
                for k in range(0, len(i), DECIDED):
                    s = slice(k, k + DECIDED)
                    part[s] += np.einsum("nd,nd->n", ra[i[s], x:y], rb[j[s], x:y])
                keep = part + sa[y][i] * sb[y][j] >= threshold - EPSILON
                pairs, part = (i[keep], j[keep]), part[keep]
        if pairs is None:
            i, j = np.nonzero(open_)
            pairs = (i + lo, j)
        for k in range(0, len(pairs[0]), DECIDED):
            i, j = (p[k : k + DECIDED] for p in pairs)
            cosine = np.einsum("nd,nd->n", a[i], b[j]) / (na[i] * nb[j])
            yield i[cosine >= threshold], j[cosine >= threshold]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of linked places; ``label`` points to each component's least place."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label[:] = up


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        pdf = pdf.sort_values(["tile", "cid"])
        x = np.array(pdf["embedding"].tolist(), np.float64)
        tile, count = pdf["tile"].to_numpy(), pdf["n"].to_numpy(np.int64)
        cut = int((tile == i).sum())
        first, second = (x, x) if i == j else (x[:cut], x[cut:])
        shift = 0 if i == j else cut
        links = np.zeros(len(x), np.int64)
        label = np.arange(len(x))
        for p, q in close_pairs(first, second, threshold, axes[x.shape[1]]):
            q = q + shift
            if i == j:
                p, q = p[p < q], q[p < q]
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            _hook(label, p, q)
        cid = pdf["cid"].to_numpy(np.int64)
        some = links > 0
        return pd.DataFrame({"cid": cid[some], "links": links[some], "root": cid[label][some]})

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each vector as doubles, null for one that links with nothing."""
    for batch in batches:
        column = batch.column("embedding")
        length = np.asarray(column.value_lengths().fill_null(0))
        # A null component is as unsound as one that is not a number.
        flat = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0
        end = np.cumsum(length)
        bad, some = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(flat), flat != 0))
        sound = (bad[end] == bad[end - length]) & (some[end] > some[end - length])
        found = [
            hashlib.blake2b(flat[z - n : z].tobytes(), digest_size=16).digest() if ok else None
            for z, n, ok in zip(end.tolist(), length.tolist(), sound.tolist())
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["vec_id", "embedding", "label", "key"])


def similar_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile: int = TILE,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Equal vectors share a 128-bit digest, so that only one vector a class is shuffled and rows meet their answer by key.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed = rows.mapInArrow(_keys, f"{fields}, key binary")
    keyed = keyed.withColumn("key", F.when(F.col("label").isNotNull(), F.hex("key")))
    classes = materialize(
        keyed.filter("key IS NOT NULL")
        .groupBy("label", "key")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
        .select("label", "key", "embedding", F.size("embedding").alias("dim"), "low", "n")
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    grid = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("g"))
    dealt = classes.join(grid, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    paired = dealt.select("label", "dim", "tile", "cid", "n", "embedding", other).select(
        "label", "dim", "tile", "cid", "n", "embedding",
        F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"),
    )
    found = materialize(
        paired.groupBy("label", "dim", "ti", "tj").applyInPandas(
            _compare(threshold, principal_axes(classes)), "cid long, links long, root long"
        ),
        "vector-links",
    )
    # A class is known by its smallest id (null last), so that the least class of a component carries the answer.
    name = F.struct(F.col("low").isNull().alias("none"), "low", "cid")
    named = classes.select("cid", name.alias("name"))
    edges = (
        found.select("cid", "root").filter("cid <> root").join(named.withColumnRenamed("name", "a"), "cid")
        .join(named.withColumnsRenamed({"cid": "root", "name": "b"}), "root")
        .select("a", "b")
    )
    stars = connected_components(edges, "a", "b").select(F.col("node.cid").alias("cid"), F.col("component.low").alias("least"))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    answers = (
        classes.select("cid", "label", "key", "low", "n")
        .join(stars.withColumn("joined", F.lit(True)), "cid", "left")
        .join(linked, "cid", "left")
        .select(
            F.struct("label", "key").alias("vector"), "n",
            F.when(F.col("joined"), F.col("least")).otherwise(F.col("low")).alias("component_id"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    narrow = materialize(keyed.select("vec_id", F.when(F.col("key").isNotNull(), F.struct("label", "key")).alias("vector")), "vector-rows")
    met = join_answers(narrow.filter("vector IS NOT NULL"), materialize(answers, "vector-answers"), "vector", "n")
    alone = narrow.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        met.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(tables.read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, reach.component_id, v.vec_id = reach.component_id AS kept
FROM v JOIN reach ON reach.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
