"""Dataset preparation: exact groups, cluster statistics, splits, negatives, folds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilome.operators.components import connected_components
from mobilome.storage import materialize


def exact_groups(rows: DataFrame, key: Column, family: str, prefer: Sequence[Column], id_col: str) -> DataFrame:
    """Per row: ``cluster`` (dense number of its key in key order), representative, group size and family conflict.

    The representative is the least row by ``prefer``, then by id.  Groups are
    aggregated before rows are joined to them, so that a key that a third of all
    rows share is never gathered.
    """
    keyed = rows.withColumn("_key", key)
    groups = keyed.groupBy("_key").agg(
        F.min_by(id_col, F.struct(*prefer, F.col(id_col))).alias("representative"), F.count(F.lit(1)).alias("group_size"),
        (F.coalesce(F.min(family) != F.max(family), F.lit(False))).alias("annotation_conflict"),
    )
    return keyed.join(groups, "_key").withColumn("is_representative", F.col(id_col) == F.col("representative")).withColumnRenamed("_key", "sequence_key")


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place ``name`` in a global order, from 1.

    The rows are dealt by ranges of the order and written once, sorted; a range's places are
    shifted by the sizes of those before, which is one number a range.  No single task sees all rows.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranked")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = dealt.withColumn("_part", part).join(F.broadcast(shift), "_part")
    return joined.withColumn(name, F.col("_shift") + inside + 1).drop("_at", "_part", "_shift")


def numbered(rows: DataFrame, order: Sequence[Column], template: str, name: str) -> DataFrame:
    """Ids such as tpase_000001 in a global order."""
    return ranked(rows, order, "_place").withColumn(name, F.format_string(template, F.col("_place"))).drop("_place")


def cluster_table(vertices: DataFrame, edges: DataFrame, id_col: str, length: str, prefix: str = "cluster30_") -> DataFrame:
    """Per vertex its cluster: representative (longest, then greatest id), and a name by size, then representative."""
    found = connected_components(edges)
    rooted = vertices.join(found, F.col(id_col) == F.col("node"), "left").withColumn("root", F.coalesce("component", F.col(id_col))).drop("node", "component")
    groups = rooted.groupBy("root").agg(F.max_by(id_col, F.struct(length, id_col)).alias("representative"), F.count(F.lit(1)).alias("cluster_size"))
    named = numbered(groups, [F.col("cluster_size").desc(), F.col("representative")], f"{prefix}%06d", "cluster_id")
    return rooted.join(named, "root").drop("root")


def cluster_statistics(clustered: DataFrame, cluster: str, family: str) -> DataFrame:
    """One row: sequences, clusters, singletons, their share, upper-middle median, largest, clusters of many families.

    The median comes from the counts of sizes, not from a list of all clusters.
    """
    groups = clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), (F.min(family) != F.max(family)).alias("mixed"))
    sizes = groups.groupBy("size").agg(F.count(F.lit(1)).alias("k"), F.count_if("mixed").alias("mixed"))
    up, whole = Window.partitionBy(F.lit(0)).orderBy("size"), Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(whole))
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("size")))
    return ranked.agg(
        F.sum(F.col("size") * F.col("k")).alias("n_sequences"), F.sum("k").alias("n_clusters"),
        F.sum(F.when(F.col("size") == 1, F.col("k")).otherwise(0)).alias("n_singletons"),
        (F.sum(F.when(F.col("size") == 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("singleton_fraction"),
        middle.alias("median_size"), F.max("size").alias("max_size"), F.sum("mixed").alias("n_mixed"),
    )


def family_purity(clustered: DataFrame, cluster: str, family: str, length: str, top: int = 20, names: int = 4) -> DataFrame:
    """The largest clusters: size, length range, most common families, share of the first, and a risk label."""
    per = clustered.groupBy(cluster, family).agg(F.count(F.lit(1)).alias("k"), F.min(length).alias("lo"), F.max(length).alias("hi"))
    groups = per.groupBy(cluster).agg(
        F.sum("k").alias("size"), F.min("lo").alias("min_length"), F.max("hi").alias("max_length"), F.count(F.lit(1)).alias("n_families"), F.max("k").alias("top_k")
    )
    largest = groups.orderBy(F.col("size").desc(), cluster).limit(top)
    w = Window.partitionBy(cluster).orderBy(F.col("k").desc(), family)
    common = per.join(F.broadcast(largest.select(cluster)), cluster, "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= names)
    listed = common.groupBy(cluster).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", family, "k"))), lambda x: F.concat_ws(":", x[family], x["k"].cast("string"))), ", ").alias("families")
    )
    share = F.col("top_k") / F.col("size")
    risk = F.when(F.col("n_families") == 1, "low").when(share >= 0.95, "moderate").otherwise("high")
    return largest.join(listed, cluster).select(cluster, "size", "min_length", "max_length", "n_families", "families", share.alias("top_share"), risk.alias("risk"))


def cluster_lists(clustered: DataFrame, cluster: str, id_col: str, family: str, most: int = 1_000) -> DataFrame:
    """(cluster, part, cluster_size, ids, families): the sorted ids and distinct families of every cluster, in lists of about ``most`` ids.

    A cluster of more than ``most`` is several parts, dealt by the hash of the id, so no list grows with the cluster.
    """
    sizes = clustered.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("cluster_size"))
    parts = F.ceil(F.col("cluster_size") / most)
    part = F.pmod(F.conv(F.substr(F.md5(F.col(id_col).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long"), parts)
    joined = clustered.join(sizes, F.col(cluster).eqNullSafe(F.col("_c"))).withColumn("part", part)
    return joined.groupBy(cluster, "part").agg(
        F.max("cluster_size").alias("cluster_size"), F.array_sort(F.collect_list(id_col)).alias("ids"), F.array_sort(F.collect_set(family)).alias("families")
    )


SPLITS = ("train", "val", "test")


class SplitLoads:
    """What the splits hold while runs of equal clusters are dealt to them.

    A split's price for the next cluster is how full it would be, plus half of how far it is over its share of each
    member's stratum.  Prices of one split never fall while clusters of one kind are dealt, so dealing them one by one, always to the
    cheapest split and to the earlier one among equals, takes the smallest prices of all splits' rising lists;
    ``deal`` finds the price at which a whole run is used up by bisection, and so how many each split takes.
    """

    def __init__(self, ratios: Sequence[float], size: int, strata: dict[str, int]):
        self.ratios, self.strata = ratios, strata
        self.target = [r * size for r in ratios]
        self.filled = [0] * len(ratios)
        self.held = [dict.fromkeys(strata, 0) for _ in ratios]

    def price(self, split: int, taken: int, size: int, members: Sequence[tuple[str, int]]) -> float:
        """The price of one more cluster after ``taken`` of the run."""
        over = 0.0
        for stratum, n in members:
            share = self.ratios[split] * self.strata[stratum]
            over += n * max(0.0, (self.held[split][stratum] + taken * n - share) / (share + 1))
        return (self.filled[split] + (taken + 1) * size) / (self.target[split] + 1e-5) + 0.5 * over

    def deal(self, run: int, size: int, members: Sequence[tuple[str, int]]) -> list[int]:
        """How many of ``run`` equal clusters each split takes; they are added to the loads."""
        splits = range(len(self.ratios))
        prices = [lambda taken, s=s: self.price(s, taken, size, members) for s in splits]
        below, above = -1.0, max(p(run - 1) for p in prices)
        # The least price up to which at least ``run`` clusters are taken; halving ends at neighbouring floats.
        while below < (middle := (below + above) / 2) < above:
            if sum(bisect_right(range(run), middle, key=p) for p in prices) >= run:
                above = middle
            else:
                below = middle
        takes = [bisect_left(range(run), above, key=p) for p in prices]
        for s in splits:
            tied = bisect_right(range(run), above, key=prices[s]) - takes[s]
            takes[s] += min(tied, run - sum(takes))
        for s in splits:
            self.filled[s] += takes[s] * size
            for stratum, n in members:
                self.held[s][stratum] += takes[s] * n
        return takes


def cluster_split(rows: DataFrame, cluster: str, stratum: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: str = "42") -> DataFrame:
    """``rows`` with ``split``; clusters are never divided.

    Clusters are dealt greedily, the largest first.  Clusters of the same size and the same counts by stratum are one signature; signatures of one
    size come in hash order, and of a signature's clusters the first in hash order train.  The driver
    holds one row a signature, however many clusters share it, and deals each run of equal clusters at once.  A null stratum counts as an empty one.
    """
    names = F.col(cluster).cast("string").alias("_cluster"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    counts = rows.select(*names).groupBy("_cluster", "stratum").agg(F.count(F.lit(1)).alias("n"))
    members = F.array_sort(F.collect_list(F.struct("stratum", "n")))
    # A cluster has one entry a stratum.
    kinds = counts.groupBy("_cluster").agg(F.sum("n").alias("size"), members.alias("members"))
    shown = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["stratum"], m["n"].cast("string"))), ",")
    kinds = materialize(kinds.withColumn("signature", shown), "cluster-kinds")
    hashed = [F.md5(F.concat_ws(":", F.lit(seed), F.col(c))) for c in ("signature", "_cluster")]
    runs = kinds.groupBy("signature", "size", "members").agg(F.count(F.lit(1)).alias("run")).orderBy(F.desc("size"), hashed[0], "signature").collect()
    strata: dict[str, int] = {}
    for r in runs:
        for m in r["members"]:
            strata[m["stratum"]] = strata.get(m["stratum"], 0) + m["n"] * r["run"]
    loads = SplitLoads(ratios, sum(r["size"] * r["run"] for r in runs), strata)
    cuts = [(r["signature"], *loads.deal(r["run"], r["size"], [tuple(m) for m in r["members"]])) for r in runs]
    dealt = rows.sparkSession.createDataFrame(cuts, "_signature string, train long, val long, test long")
    placed = ranked(kinds.select("_cluster", "signature"), [F.col("signature"), hashed[1], F.col("_cluster")], "_place")
    first = placed.groupBy(F.col("signature").alias("_signature")).agg(F.min("_place").alias("_first"))
    # As many rows as the driver held: every signature once.
    rules = F.broadcast(dealt.join(first, "_signature"))
    rank = F.col("_place") - F.col("_first")
    split = F.when(rank < F.col("train"), SPLITS[0]).when(rank < F.col("train") + F.col("val"), SPLITS[1]).otherwise(SPLITS[2])
    assigned = placed.join(rules, F.col("signature") == F.col("_signature")).select("_cluster", split.alias("split"))
    return rows.join(assigned, F.col(cluster).cast("string") == F.col("_cluster")).drop("_cluster")


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """How many distinct values two splits share; zero for disjoint ones."""
    return a.select(column).intersect(b.select(column)).agg(F.count(F.lit(1)).alias("shared"))


def stratified_split(rows: DataFrame, stratum: str, id_col: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: str = "42") -> DataFrame:
    """``rows`` with ``split`` by rank in MD5 order within the stratum against rounded cut-offs; test takes the rest.

    Only strata, orders and ids are ranked, in one global order by stratum, so a stratum that holds a third of all rows is many ranges,
    not one task.  What is found are two orders a stratum, where train and val end; the rows are then told apart where they lie.
    """
    order = F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("h"), F.col(id_col).alias("i"))
    narrow = rows.select(F.col(stratum).alias("_stratum"), order.alias("_order"))
    placed = ranked(narrow, [F.col("_stratum"), F.col("_order.h"), F.col("_order.i")], "_place")
    sizes = placed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    first, second = F.bround(F.col("_n") * F.lit(ratios[0])), F.bround(F.col("_n") * F.lit(ratios[1]))
    ends = sizes.select(F.col("_stratum").alias("_s"), (F.col("_first") + first - 1).alias("_train"), (F.col("_first") + first + second - 1).alias("_val"))
    # A cut-off of no rows lies before the stratum.
    at = placed.join(ends, (F.col("_place") == F.col("_train")) | (F.col("_place") == F.col("_val")))
    at = at.filter(F.col("_stratum").eqNullSafe(F.col("_s")))
    cuts = at.groupBy("_s").agg(F.max(F.when(F.col("_place") == F.col("_train"), F.col("_order"))).alias("_train_to"), F.max(F.when(F.col("_place") == F.col("_val"), F.col("_order"))).alias("_val_to"))
    joined = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    split = F.when(order <= F.col("_train_to"), "train").when(order <= F.col("_val_to"), "val").otherwise("test")
    return joined.withColumn("split", split).drop("_s", "_train_to", "_val_to")


def quotas(share: DataFrame, total: int, key: str, weight: str) -> DataFrame:
    """(``key``, want): ``total`` dealt in proportion to ``weight`` by largest remainders, the smaller key first among equals.

    The windows run over one row per key.
    """
    every = Window.partitionBy(F.lit(0))
    exact = F.col(weight) * total / F.sum(weight).over(every)
    floor = F.floor(exact).cast("long")
    left = F.lit(total) - F.sum("_floor").over(every)
    turn = F.row_number().over(every.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), key))
    dealt = share.withColumn("_exact", exact).withColumn("_floor", floor).withColumn("_left", left).withColumn("_turn", turn)
    return dealt.select(key, (F.col("_floor") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).alias("want"))


def sample_negatives(
    pool: DataFrame, positives: DataFrame, target: int, id_col: str, kind: str, length: str,
    hard: float = 0.5, matched: float = 0.3, width: int = 50, offsets: Sequence[int] = (0, -1, 1, -2, 2), seed: str = "42",
) -> DataFrame:
    """``target`` negatives: hard ones, length-matched general ones, and easy ones, with ``negative_type``.

    The length-matched ones are dealt to bins of length in proportion to the positives; what a bin lacks is asked of its
    neighbours in the order of ``offsets``, and what they lack is filled from the rest of the general pool
    in hash order.  As many are chosen as are asked for, unless the pools hold fewer.  Ranks in one global order
    replace drawing one by one, so no pool is gathered.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    n_hard, n_matched = int(hard * target), int(matched * target)
    asked_for = {"hard": n_hard, "easy": target - n_hard - n_matched}
    columns = pool.columns
    cell = F.when(F.col(kind) == "general", F.floor(F.col(length) / width))
    stock = pool.filter(F.col(kind).isin("hard", "easy", "general")).withColumn("_bin", cell).withColumn("_order", order)
    stock = ranked(stock, [F.col(kind), F.col("_bin"), F.col("_order"), F.col(id_col)], "_place")
    # From here on one row per kind and bin of lengths: bounded by the longest sequence, not by the pool.
    supply = stock.groupBy(F.col(kind).alias("_kind"), "_bin").agg(F.count(F.lit(1)).alias("left"), F.min("_place").alias("_first"))
    share = positives.groupBy(F.floor(F.col(length) / width).alias("_bin")).agg(F.count(F.lit(1)).alias("p"))
    need = quotas(share, n_matched, "_bin", "p")
    supply = materialize(supply, "negatives-supply")
    used = supply.filter("_kind = 'general'").select("_bin", "left", F.lit(0).cast("long").alias("used"))
    for o in offsets:
        asked = need.select((F.col("_bin") + o).alias("_bin"), F.col("want"), F.col("_bin").alias("_home"))
        room = F.coalesce(F.col("left") - F.col("used"), F.lit(0))
        met = materialize(asked.join(used, "_bin", "left").withColumn("got", F.least(F.col("want"), room)), "negatives-met")
        used = used.join(met.select("_bin", "got"), "_bin", "left").select("_bin", "left", (F.col("used") + F.coalesce("got", F.lit(0))).alias("used"))
        need = met.select(F.col("_home").alias("_bin"), (F.col("want") - F.col("got")).alias("want"))
    used = materialize(used.select(F.col("_bin").alias("_b"), "used"), "negatives-used")
    whole = F.when(F.col("_kind") == "hard", asked_for["hard"]).when(F.col("_kind") == "easy", asked_for["easy"])
    cells = supply.join(used, F.col("_bin") == F.col("_b"), "left").select("_kind", F.col("_bin").alias("_b"), "_first", F.coalesce("used", whole, F.lit(0)).alias("_most"))
    placed = stock.join(F.broadcast(cells), (F.col(kind) == F.col("_kind")) & F.col("_bin").eqNullSafe(F.col("_b")))
    placed = placed.withColumn("_rank", F.col("_place") - F.col("_first") + 1).drop("_place")
    picked = placed.filter(F.col("_rank") <= F.col("_most"))
    missing = n_matched - int(used.agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0])
    if missing > 0:
        rest = placed.filter((F.col(kind) == "general") & (F.col("_rank") > F.col("_most")))
        picked = picked.unionByName(ranked(rest, [F.col("_order"), F.col(id_col)], "_place").filter(F.col("_place") <= missing).drop("_place"))
    return picked.select(*columns, F.when(F.col(kind) == "general", "length_matched").otherwise(F.col(kind)).alias("negative_type"))


def leave_one_out_folds(rows: DataFrame, family: str, label: str, split: str, families: Sequence) -> DataFrame:
    """Each row once per fold with ``role``: a held-out family is tested with the test negatives, and trains nowhere."""
    folds = F.explode(F.array(*[F.lit(f) for f in families])).alias("fold")
    own, negative = F.col(family) == F.col("fold"), F.col(label) != 1
    role = F.when(own, "test").when(negative & (F.col(split) == "test"), "test").when(F.col(split) != "test", F.col(split))
    return rows.select("*", folds).withColumn("role", role).filter("role IS NOT NULL")
