"""Similarity search and clusters by alignment: neighbourhood words, two hits on a diagonal, affine-gap extension, statistics.

Words of the targets meet the words that score well against words of the queries, every tile of queries with every tile of targets in one task;
hits of a pair are summed there by diagonal and stretch, and only pairs with two hits that do not overlap on
one diagonal, within a stretch, are aligned: in batches, around their hits, by the kernels of ``alignment_kernels``.

Defined results: null ids and null or empty sequences have no hits; letters are taken in upper case, and those that are no residue match nothing; of a
pair's alignments the best one is its hit (ties: the one that starts first); repeated rows of one id and sequence count once; an empty side gives no
hits; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.functions import alignment_kernels as A
from mobilome.functions.sequence import kmers
from mobilome.operators.components import connected_components
from mobilome.operators.datasets import cluster_table
from mobilome.operators.hits import scheme_edges
from mobilome.storage import materialize

HIT_COLUMNS = "fident double, alnlen int, qcov double, tcov double, score int, q_start int, q_end int, t_start int, t_end int"
#: Letters of a word, what a neighbour scores at least, and how far apart two hits of a diagonal may be.
WORD, NEAR, STRETCH = 4, 17, 40
#: Diagonals that a gap may move by in one region, residues around the hits that are aligned, and regions of a pair.
REGION, MARGIN, REGIONS = 64, 300, 2
#: Residues of a tile of the word search on either side, on average, and partitions of its tiles at most.
TILE_RESIDUES, MOST_TILES = 75_000, 20_000
#: Residues of a tile at least, where sides are too small for tiles of that size on all cores.
LEAST_RESIDUES = 5_000
_SEED_NAMES = ["query", "target", "diagonal", "stretch", "q_first", "q_last", "hits"]
_SEED_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
#: Pairs that are aligned at a time.
TASK_PAIRS = 2_000
#: Words of a protein by which it meets others first, and how many of those meet in a tile.
SKETCHES, GROUP = 4, 500


def _words(side: DataFrame, name: str, k: int) -> DataFrame:
    """(id, pos, word) of words with more than two different letters."""
    found = side.select(F.col("id").alias(name), F.posexplode(kmers(F.col("sequence"), k)).alias(f"{name}_pos", "word"))
    letters = F.size(F.array_distinct(F.split("word", "")))
    return found.filter(letters > 2)


def _clean(side: DataFrame, id_col: str, sequence: str) -> DataFrame:
    rows = side.select(F.col(id_col).alias("id"), F.upper(F.col(sequence)).alias("sequence"))
    return rows.filter("id IS NOT NULL AND sequence IS NOT NULL AND sequence <> ''").distinct()


def _tiled(queries: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_i`` and ``_j``: every tile of queries meets every tile of targets, in partitions of tiles."""
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # Small sides are cut finer, so that all cores have tiles.
    residues = [int(side.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]) for side in (queries, targets)]
    n_q, n_t = (1 + max(r // TILE_RESIDUES, min(r // LEAST_RESIDUES, math.isqrt(8 * cores))) for r in residues)
    # No fewer than joins have, or the grouping would shuffle once more, into few tasks.
    parts = min(max(n_q * n_t, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TILES)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("*", own(n_q).alias("_i"), all_of(n_t).alias("_j")).repartition(parts, "_i", "_j")
    t = targets.select("*", all_of(n_q).alias("_i"), own(n_t).alias("_j")).repartition(parts, "_i", "_j")
    return q, t


def _met(q: DataFrame, t: DataFrame, run: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``run`` of every tile of (id, sequence, label, _i, _j): ids, sequences, the first place of each id, and labels as numbers, of either side."""
    # Names and columns of their own, since both sides may be one table.
    label = lambda side: F.col("label") if "label" in side.columns else F.lit(None).cast("string")
    q, t = (side.select(F.col("id").alias(f"{c}_id"), F.col("sequence").alias(f"{c}_sequence"), label(side).alias(f"{c}_label"), "_i", "_j") for c, side in (("q", q), ("t", t)))

    def by_id(side: pa.Table) -> tuple[pa.Table, np.ndarray]:
        side = side.rename_columns(["id", "sequence", "label", "_i", "_j"])
        names = list(map(repr, side.column("id").to_pylist()))
        order = sorted(range(len(names)), key=names.__getitem__)
        first = [i for i, x in enumerate(order) if not i or names[x] != names[order[i - 1]]]
        return side.take(pa.array(order, pa.int64())), np.repeat(np.array(first, np.int64), np.diff([*first, len(order)]))

    def tile(one: pa.Table, other: pa.Table) -> pa.Table:
        (one, own_q), (other, own_t) = by_id(one), by_id(other)
        ids = [side.column("id").combine_chunks() for side in (one, other)]
        seqs = [side.column("sequence").to_pylist() for side in (one, other)]
        known: dict = {}
        labels = tuple(np.array([known.setdefault(x, len(known)) for x in side.column("label").to_pylist()], np.int64) for side in (one, other))
        return run(ids, seqs, (own_q, own_t), labels)

    return q.groupBy("_i", "_j").cogroup(t.groupBy("_i", "_j")).applyInArrow(tile, schema)


def seed_diagonals(queries: DataFrame, targets: DataFrame, k: int = WORD, near: int | None = NEAR, stretch: int = STRETCH, apart: Column | None = None) -> DataFrame:
    """(query, target, diagonal, hits, q_first, q_last, ...): stretches of diagonals with two hits that do not overlap.

    Every tile of queries meets every tile of targets in one task, so hits are never shuffled, whatever their number; only sequences are.

    ``queries`` and ``targets`` have (id, sequence).  ``near`` is the least score of a neighbour word, None for equal words alone.  ``apart``
    is a condition on the columns query and target.
    """
    q, t = (side.select("id", "sequence").filter("id IS NOT NULL AND sequence IS NOT NULL") for side in (queries, targets))
    table = q.sparkSession.sparkContext.broadcast(_neighbour_table(q, k, near))
    kinds = [f"{name} {side.schema['id'].dataType.simpleString()}" for name, side in (("query", q), ("target", t))]
    schema = ", ".join([*kinds, "diagonal int, stretch long, q_first int, q_last int, hits long"])

    def run(ids, seqs, owners, labels) -> pa.Table:
        found = []
        if all(seqs):
            for x in A.stretches(*seqs, k, stretch, table.value, owners):
                cols = [ids[0].take(pa.array(x[0])), ids[1].take(pa.array(x[1])), *(pa.array(c, y) for c, y in zip(x[2:], _SEED_TYPES))]
                found.append(pa.table(cols, names=_SEED_NAMES))
        if not found:
            return pa.table([ids[0][:0], ids[1][:0], *(pa.array([], y) for y in _SEED_TYPES)], names=_SEED_NAMES)
        return pa.concat_tables(found)

    met = _met(*_tiled(q, t), run, schema)
    return met if apart is None else met.filter(apart)


def _neighbour_table(queries: DataFrame, k: int, near: int | None):
    """(codes of the words of the queries in order, where the neighbours of each begin, codes of all neighbours): at most 20^k words; None if equal words alone meet."""
    if near is None:
        return None

    @F.pandas_udf("binary")
    def close(words: pd.Series) -> pd.Series:
        return words.map(lambda w: A.neighbour_codes(w, near).astype("<i8").tobytes())

    code = F.udf(A.word_code, "long")
    words = _words(queries, "query", k).select("word").distinct().filter(F.col("word").rlike(f"^[{A.RESIDUES[:20]}]+$"))
    known = words.repartition(queries.sparkSession.sparkContext.defaultParallelism).select(code("word").alias("code"), close("word").alias("near")).toArrow()
    order = np.argsort(known.column("code").to_numpy())
    lists = [np.frombuffer(known.column("near")[int(i)].as_py(), "<i8") for i in order]
    begins = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return known.column("code").to_numpy()[order], begins, np.concatenate(lists) if lists else np.zeros(0, np.int64)


def two_hits(met: DataFrame, k: int = WORD, stretch: int = STRETCH) -> DataFrame:
    """The stretches of diagonals of (query, target, query_pos, target_pos) with two hits that do not overlap."""
    # A stretch is twice as long as its step, so any two hits within a step share one.
    step = F.floor(F.col("query_pos") / stretch)
    met = met.select("query", "target", (F.col("target_pos") - F.col("query_pos")).alias("diagonal"), "query_pos", F.explode(F.array(step - 1, step)).alias("stretch"))
    found = met.groupBy("query", "target", "diagonal", "stretch").agg(
        F.min("query_pos").alias("q_first"), F.max("query_pos").alias("q_last"), F.count_distinct("query_pos").alias("hits")
    )
    return found.filter(F.col("q_last") - F.col("q_first") >= k)


def regions(seeds: DataFrame, k: int = WORD, region: int = REGION, most: int = REGIONS) -> DataFrame:
    """(query, target, q_first, q_last, low, high): of every pair the neighbouring diagonals with the most hits, ``most`` of them.

    Diagonals are taken together in bands that overlap by half.
    """
    band = F.floor(F.col("diagonal") / region)
    dealt = seeds.withColumn("band", F.explode(F.array(band - 1, band)))
    found = dealt.groupBy("query", "target", "band").agg(
        F.min("q_first").alias("q_first"), (F.max("q_last") + k).alias("q_last"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("hits").alias("hits")
    )
    w = Window.partitionBy("query", "target").orderBy(F.desc("hits"), "band")
    # Two bands hold the same hits where these lie in their common half; such a region is aligned once.
    place = F.struct("q_first", "q_last", "low", "high")
    ranked = found.withColumns({"_r": F.row_number().over(w), "_again": place.eqNullSafe(F.lag(place).over(w))})
    return ranked.filter((F.col("_r") <= most) & ~F.col("_again")).drop("_r", "_again", "band", "hits")


def _found(
    q: DataFrame, t: DataFrame, table, residues: int, k: int, stretch: int, most_expected: float, apart: Column | None, skip: bool = False, margin: int = MARGIN
) -> DataFrame:
    """Hits of sides that are dealt to tiles (id, sequence, label, _i, _j); with ``skip``, of different labels alone.

    Regions of a pair are found in its tile and aligned behind it in the same task; neither pairs nor sequences are shuffled again.
    """
    kinds = [f"{name} {side.schema['id'].dataType.simpleString()}" for name, side in (("query", q), ("target", t))]
    parts = pa.list_(pa.struct([("q_size", pa.int32()), ("t_size", pa.int32()), ("q_from", pa.int32()), ("t_from", pa.int32()), ("q", pa.string()), ("t", pa.string())]))

    def run(ids, seqs, owners, labels) -> pa.Table:
        sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in seqs]
        # How many sequences each id has, by the place of its first.
        counts = [np.bincount(own, minlength=len(own)) for own in owners]
        tables = []
        for x in A.stretches(*seqs, k, stretch, table.value, owners, labels if skip else None) if all(seqs) else ():
            a, b, first, last, low, high = A.pair_regions(x[0], x[1], x[2], x[4], x[5], x[6], k, REGION, REGIONS)
            if not len(a):
                continue
            # All sequences of an id take part.
            n_b = counts[1][b]
            width = counts[0][a] * n_b
            row = np.repeat(np.arange(len(a)), width)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            i, j = a[row] + inside // n_b[row], b[row] + inside % n_b[row]
            q_from, t_from = np.maximum(0, first - margin)[row], np.maximum(0, first + low - margin)[row]
            q_to, t_to = np.minimum(sizes[0][i], (last + margin)[row]), np.minimum(sizes[1][j], (last + high + margin)[row])
            cut = [pa.array([seqs[side][n][u:v] for n, u, v in zip(at.tolist(), fro.tolist(), to.tolist())], pa.string()) for side, at, fro, to in ((0, i, q_from, q_to), (1, j, t_from, t_to))]
            flat = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in (sizes[0][i], sizes[1][j], q_from, t_from)), *cut], fields=list(parts.value_type))
            # One row a pair.
            new = np.flatnonzero(np.append(True, (np.diff(a[row]) != 0) | (np.diff(b[row]) != 0)))
            one, other = a[row][new], b[row][new]
            of_q = np.repeat(one - (np.cumsum(counts[0][one]) - counts[0][one]), counts[0][one]) + np.arange(counts[0][one].sum())
            lengths = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[0][one])), pa.int32()), pa.array(sizes[0][of_q], pa.int32()))
            regions = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), flat)
            tables.append(pa.table([ids[0].take(pa.array(one)), ids[1].take(pa.array(other)), lengths, regions], names=["query", "target", "lengths", "regions"]))
        if not tables:
            return pa.table([ids[0][:0], ids[1][:0], pa.array([], pa.list_(pa.int32())), pa.array([], parts)], names=["query", "target", "lengths", "regions"])
        return pa.concat_tables(tables)

    region = "struct<q_size: int, t_size: int, q_from: int, t_from: int, q: string, t: string>"
    pairs = _met(q, t, run, ", ".join([*kinds, "lengths array<int>", f"regions array<{region}>"]))
    pairs = pairs if apart is None else pairs.filter(apart)
    names = [c.split()[0] for c in HIT_COLUMNS.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TASK_PAIRS):
                batch = whole.slice(low, TASK_PAIRS)
                flat = batch.column("regions").flatten()
                of = np.repeat(np.arange(batch.num_rows), np.array(batch.column("regions").value_lengths()))
                q_size, t_size, q_from, t_from = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("q_size", "t_size", "q_from", "t_from"))
                texts, others = flat.field("q").to_pylist(), flat.field("t").to_pylist()
                found = A.align_pairs([A.encoded(s) for s in texts], [A.encoded(s) for s in others])
                if not found:
                    continue
                spans = np.array([(a.score, a.q_start, a.q_end, a.t_start, a.t_end, len(a.q_at)) for a in found], np.int64).T
                score, q_start, q_end, t_start, t_end = spans[0], spans[1] + q_from, spans[2] + q_from, spans[3] + t_from, spans[4] + t_from
                # Of a pair's alignments the best one, then the one that starts first.
                order = np.lexsort((t_start, q_start, -score, of))
                best = order[np.append(True, np.diff(of[order]) != 0)]
                same = np.array([np.count_nonzero(A.points(texts[i])[found[i].q_at] == A.points(others[i])[found[i].t_at]) for i in best.tolist()], np.int64)
                columns = (q_end - q_start + t_end - t_start - spans[5])[best]
                values = [same / np.maximum(1, columns), columns, ((q_end - q_start) / q_size)[best], ((t_end - t_start) / t_size)[best], *(x[best] for x in (score, q_start, q_end, t_start, t_end))]
                kept = batch.select(["query", "target", "lengths"]).take(pa.array(of[best]))
                yield pa.record_batch([*kept.columns, *(pa.array(v, pa.float64() if v.dtype.kind == "f" else pa.int32()) for v in values)], names=["query", "target", "lengths", *names])

    aligned = pairs.mapInArrow(align, ", ".join([*kinds, "lengths array<int>", HIT_COLUMNS]))
    rate, constant = A.statistics()
    bits = (F.lit(rate) * F.col("score") - F.log(F.lit(constant))) / F.log(F.lit(2.0))
    sized = aligned.select("query", "target", *names, bits.alias("bits"), F.explode("lengths").alias("_m"))
    expected = sized.withColumn("evalue", F.col("_m") * F.lit(float(residues)) * F.pow(F.lit(2.0), -F.col("bits"))).drop("_m")
    return expected.filter(F.col("evalue") <= most_expected)


def _prepared(queries: DataFrame, targets: DataFrame, id_col: str, sequence: str, k: int, near: int | None):
    """Clean sides, the broadcast table of neighbour words, and residues of all targets."""
    q = materialize(_clean(queries, id_col, sequence), "search-queries")
    t = q if queries is targets else materialize(_clean(targets, id_col, sequence), "search-targets")
    residues = t.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    return q, t, q.sparkSession.sparkContext.broadcast(_neighbour_table(q, k, near)), residues


def search(
    queries: DataFrame, targets: DataFrame, id_col: str = "id", sequence: str = "sequence", k: int = WORD, near: int | None = NEAR,
    most_expected: float = 1e-3, apart: Column | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """Hits (query, target, fident, alnlen, qcov, tcov, evalue, bits, score, spans) with at most ``most_expected`` expected by chance.

    Identity is over all columns of the alignment; the expected number is for one query against all residues of the targets.
    """
    q, t, table, residues = _prepared(queries, targets, id_col, sequence, k, near)
    return _found(*_tiled(q, t), table, residues, k, stretch, most_expected, apart)


def linking_edges(
    proteins: DataFrame, accepted: Callable[[DataFrame], DataFrame], id_col: str = "id", sequence: str = "sequence", k: int = WORD, near: int | None = NEAR,
    most_expected: float = 1e-3, apart: Column | None = None, stretch: int = STRETCH, node: Callable[[Column], Column] = lambda c: c, kind: Column | None = None,
) -> DataFrame:
    """(src, dst): hits of ``proteins`` against themselves that ``accepted`` keeps, as many as connect what all of them connect.

    A hit follows from its pair alone, so what is connected already needs no further one.  First every protein meets the least one of those, of
    each ``kind`` that ``apart`` tells apart, that share one of its words chosen by hash; then all pairs that these hits do not connect are searched.
    ``node`` gives the vertex of an id.
    """
    q, _, table, residues = _prepared(proteins, proteins, id_col, sequence, k, near)

    def edges(hits: DataFrame, label: str) -> DataFrame:
        return materialize(accepted(hits).select(node(F.col("query")).alias("src"), node(F.col("target")).alias("dst")), label)

    words = kmers(F.col("sequence"), k)
    chosen = F.array(*[F.array_min(F.transform(words, lambda w, n=n: F.xxhash64(F.concat(w, F.lit(str(n)))))) for n in range(SKETCHES)])
    dealt = q.withColumn("kind", F.lit(0) if kind is None else kind).select("*", F.posexplode(chosen).alias("_n", "_word")).filter("_word IS NOT NULL")
    # Hubs by id, with all sequences of theirs; groups of many members are cut.
    least = dealt.groupBy("_n", "_word", "kind").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_size"))
    groups = least.groupBy("_n", "_word").agg(F.sum("_size").alias("_size")).filter("_size > 1")
    groups = materialize(groups.select(F.xxhash64("_n", "_word").alias("_i"), "_n", "_word", (1 + F.floor(F.col("_size") / GROUP)).cast("int").alias("_cuts")), "search-groups")
    members = dealt.join(groups, ["_n", "_word"]).select("id", "sequence", "_i", F.pmod(F.xxhash64("id"), F.col("_cuts")).cast("int").alias("_j"))
    hubs = least.join(groups, ["_n", "_word"]).select("id", "_i", "_cuts").join(q, "id").select("id", "sequence", "_i", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_j"))
    hubs, members = materialize(hubs, "search-hubs"), materialize(members, "search-members")
    near_ones = [_found(*sides, table, residues, k, stretch, most_expected, apart) for sides in ((hubs, members), (members, hubs))]
    first = edges(near_ones[0].unionByName(near_ones[1]), "search-links").distinct()
    stars = materialize(connected_components(first), "search-stars")
    labelled = q.join(stars, node(F.col("id")) == F.col("node"), "left").select("id", "sequence", F.coalesce("component", node(F.col("id"))).alias("label"))
    labelled = materialize(labelled, "search-labelled")
    return first.unionByName(edges(_found(*_tiled(labelled, labelled), table, residues, k, stretch, most_expected, apart, True), "search-links"))


def best_hits(hits: DataFrame, most: int = 1, shards: int = 32) -> DataFrame:
    """The ``most`` best hits of every query by bits, then by target: first of each shard of the targets, then of what these keep."""
    order = F.desc("bits"), "target"
    sharded = hits.withColumn("_shard", F.pmod(F.xxhash64("target"), F.lit(shards)))
    for keys in (("query", "_shard"), ("query",)):
        sharded = sharded.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
    return sharded.drop("_shard")


def alignment_clusters(proteins: DataFrame, id_col: str, sequence: str, scheme: str = "A", **options) -> DataFrame:
    """(id, component): proteins connected by hits that meet a scheme of ``hits.scheme_edges``, copies included."""
    rows = proteins.select(F.col(id_col).alias("id"), F.col(sequence).alias("sequence"))
    key = F.md5(F.upper("sequence"))
    # Copies are one class, linked as a star; classes are searched against each other, each pair once.
    least = rows.filter("id IS NOT NULL AND sequence IS NOT NULL").groupBy(key.alias("k")).agg(F.min("id").alias("low"), F.any_value("sequence").alias("sequence"))
    least = materialize(least, "protein-classes")
    copies = rows.select("id", key.alias("k")).join(least, "k").filter("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst"))
    accepted = lambda hits: scheme_edges(hits).filter(F.col("scheme") == scheme)
    edges = linking_edges(least, accepted, "low", "sequence", apart=F.col("query") < F.col("target"), **options)
    stars = connected_components(edges.union(copies))
    ids = rows.filter("id IS NOT NULL").select("id").distinct()
    return ids.join(stars, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def named_clusters(proteins: DataFrame, id_col: str, sequence: str, scheme: str = "A", **options) -> DataFrame:
    """``cluster_table`` of the clusters: representative, size and name of every protein's cluster."""
    edges = alignment_clusters(proteins, id_col, sequence, scheme, **options).filter("id <> component").select(F.col("id").alias("src"), F.col("component").alias("dst"))
    return cluster_table(proteins.withColumn("_n", F.length(sequence)), edges, id_col, "_n").drop("_n")
