"""Merging in rounds: single linkage with leaf selection (T2), average linkage.

Both are agglomerative, and in both a pair that is each other's nearest may be
merged at once, whatever happens elsewhere. So a round merges many pairs, and
the number of rounds follows the depth of the tree, not the number of merges.
State lives in written tables; the driver reads single numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators import similarity
from themeloom.operators.components import connected_components
from themeloom.session import stage

KEY = ("s", "x", "y")  # similarity, then minus the ends of the edge: every edge has a place of its own


def _trees(best: DataFrame) -> DataFrame:
    """(c, tree): clusters follow their best neighbour up to the pair that
    chose each other; the tree is named by that pair's lesser id."""
    other = best.select(F.col("c").alias("o"), F.col("o").alias("back"))
    mutual = F.col("back") == F.col("c")
    rows = stage(best.select("c", "o").join(other, "o")
                 .select("c", F.when(mutual, F.least("c", "o")).otherwise(F.col("o")).alias("tree"), mutual.alias("done")), "link-trees")
    while not rows.filter("not done").isEmpty():
        to = rows.select(F.col("c").alias("tree"), F.col("tree").alias("to"), F.col("done").alias("end"))
        met = rows.filter("not done").join(to, "tree").select("c", F.col("to").alias("tree"), F.col("end").alias("done"))
        rows = stage(rows.filter("done").unionByName(met), "link-trees")
    return rows.select("c", "tree")


def _strongest(links: DataFrame) -> DataFrame:
    """One link per pair of clusters (a < b): the strongest."""
    pair = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *KEY).filter("a <> b")
    return pair.groupBy("a", "b").agg(F.max(F.struct(*KEY)).alias("k")).select("a", "b", "k.*")


def _round(links: DataFrame, clusters: DataFrame, min_size: int) -> DataFrame:
    """The clusters that merge in this round: (c, tree, size, kind, whole) with
    ``kind`` that of the merged cluster (0 small, 1 group, 2 split) and
    ``whole``, the group that the cluster's members end in (null: they go on
    in the merged cluster; -1: in none)."""
    ends = links.select(F.col("a").alias("c"), F.col("b").alias("o"), *KEY).unionByName(
        links.select(F.col("b").alias("c"), F.col("a").alias("o"), *KEY))
    best = stage(ends.groupBy("c").agg(F.max(F.struct(*KEY, "o")).alias("m")).select("c", "m.*"), "link-best")
    tree = _trees(best)
    # links out of a tree: what is weaker than the strongest of them has to wait
    at = tree.select(F.col("c").alias("a"), F.col("tree").alias("ta"))
    bt = tree.select(F.col("c").alias("b"), F.col("tree").alias("tb"))
    out = links.join(at, "a").join(bt, "b").filter("ta <> tb").select("ta", "tb", F.struct(*KEY).alias("k"))
    leaving = (out.select(F.col("ta").alias("tree"), "k").unionByName(out.select(F.col("tb").alias("tree"), "k"))
               .groupBy("tree").agg(F.max("k").alias("leaving")))
    items = (best.join(tree, "c").join(clusters, "c").join(leaving, "tree", "left")
             .filter(F.col("leaving").isNull() | (F.struct(*KEY) > F.col("leaving"))))
    by = Window.partitionBy("tree").orderBy(*[F.desc(k) for k in KEY], "c")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("tree")
    items = (items
             .withColumn("grown", F.coalesce(F.max(F.col("kind") > 0).over(before), F.lit(False))
                         | (F.coalesce(F.sum("size").over(before), F.lit(0)) >= min_size))
             .withColumn("splits", (F.col("kind") == 2) | ((F.col("kind") > 0) & F.col("grown")))
             .withColumn("after", F.max("splits").over(by.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("was", F.coalesce(F.max("splits").over(before), F.lit(False)))
             .withColumn("total", F.sum("size").over(every))
             .withColumn("any", F.max(F.col("kind") > 0).over(every))
             .withColumn("split", F.max("splits").over(every))
             .withColumn("first", F.max(F.when(F.col("splits") & ~F.col("was"), F.col("grown"))).over(every)))
    kind = F.when(F.col("split"), 2).when(F.col("any") | (F.col("total") >= min_size), 1).otherwise(0)
    whole = (F.when(~F.col("split"), F.lit(None))
             .when(~F.col("after"), F.when(F.col("first"), F.col("tree")).otherwise(-1))
             .when(F.col("kind") == 1, F.col("c")).otherwise(-1))
    return items.select("c", "tree", "size", whole.cast("long").alias("whole"), kind.alias("kind"))


def leaf_groups(edges: DataFrame, min_size: int) -> DataFrame:
    """T2 leaves: ``(id, leaf)``, the finest groups of at least ``min_size``.

    As the threshold falls, points join by their strongest edges (src, dst,
    similarity; equal ones by src, then dst). A group is a cluster of at least
    ``min_size`` up to where it meets another such cluster; what is above such a
    meeting is not a group, and points that only join there, or never reach the
    size, are in none and not returned. Ids are numbers of zero or more;
    ``leaf`` is the id of one member. Edges may be a spanning forest or more."""
    edges = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("similarity").alias("s"))
    edges = edges.withColumns({"x": -F.col("a"), "y": -F.col("b")})
    links = stage(_strongest(edges), "links")
    points = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    members = stage(points.select("id", F.col("id").alias("c")), "link-members")
    clusters = stage(points.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("size"),
                                   F.lit(int(min_size <= 1)).alias("kind")), "link-clusters")
    ended = []
    while not links.isEmpty():
        merged = stage(_round(links, clusters, min_size), "link-round")
        now = members.join(merged.select("c", "tree", "whole"), "c", "left")
        ended.append(stage(now.filter("whole >= 0").select("id", F.col("whole").alias("leaf")), "link-leaves"))
        members = stage(now.filter("whole is null").select("id", F.coalesce("tree", "c").alias("c")), "link-members")
        joint = merged.groupBy(F.col("tree").alias("c")).agg(F.sum("size").alias("size"), F.max("kind").alias("kind"))
        clusters = stage(clusters.join(merged.select("c"), "c", "left_anti").unionByName(joint.select("c", "size", "kind")), "link-clusters")
        for end in ("a", "b"):
            links = (links.join(merged.select(F.col("c").alias(end), "tree"), end, "left")
                     .withColumn(end, F.coalesce("tree", end)).drop("tree"))
        links = stage(_strongest(links), "links")
    out = members.join(clusters.filter("kind = 1"), "c").select("id", F.col("c").alias("leaf"))
    for part in ended:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# average linkage
# ---------------------------------------------------------------------------

def _partners(groups: DataFrame, width: int, k: int, ship_bytes: int) -> DataFrame:
    """(g, o, height): each group's most similar other one, by the mean of the
    products of their members, which is the product of their mean vectors.
    The groups go to every task in parts of ``ship_bytes``."""
    parts = max(1, -(-k * width * 8 // ship_bytes))
    found = None
    for i in range(parts):
        held = groups.filter(F.pmod(F.xxhash64("g"), F.lit(parts)) == i).select("g", "mean").collect()
        if not held:
            continue
        shared = groups.sparkSession.sparkContext.broadcast((np.array([r.g for r in held], np.int64), np.array([r["mean"] for r in held])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            order = np.argsort(ids)
            ids, m = ids[order], m[order]
            for b in batches:
                for start in range(0, len(b), 512):
                    mine = b.iloc[start:start + 512]
                    g = mine["g"].to_numpy(np.int64)
                    sims = np.round(np.stack(mine["mean"].to_list()) @ m.T, 12)
                    sims[g[:, None] == ids[None, :]] = -np.inf
                    at = sims.argmax(axis=1)
                    best = sims[np.arange(len(g)), at]
                    ok = np.isfinite(best)
                    yield pd.DataFrame({"g": g[ok], "o": ids[at[ok]], "height": best[ok]})

        part = groups.select("g", "mean").mapInPandas(run, "g bigint, o bigint, height double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("g").agg(F.max(F.struct("height", (-F.col("o")).alias("o"))).alias("m")).select(
        "g", (-F.col("m.o")).alias("o"), F.col("m.height").alias("height"))


def average_merges(vectors: DataFrame, target: int, ship_bytes: int = similarity.SHIP_BYTES) -> DataFrame:
    """``(low, high, height)``: the merges that leave ``target`` groups of the
    unit vectors ``(g, v)`` under average linkage, highest first; ``low`` and
    ``high`` are the least members of the two sides.

    Every round merges all pairs that are each other's most similar (of equal
    ones the least ids), until as many merges as needed are at least as high as
    any that can follow."""
    groups = stage(vectors.select(F.col("g").cast("long"), F.col("v").alias("mean"), F.lit(1).cast("long").alias("n")), "linkage-groups")
    k = groups.count()
    need, left, step, merges = k - max(target, 1), k, 0, None
    width = groups.agg(F.max(F.size("mean"))).first()[0] or 1
    while need > 0 and left > 1:
        best = stage(_partners(groups, width, left, ship_bytes), "linkage-best")
        if merges is not None:
            top = best.agg(F.max("height")).first()[0]
            if merges.filter(F.col("height") >= top).count() >= need:
                break
        other = best.select(F.col("g").alias("o"), F.col("o").alias("back"))
        pairs = stage(best.join(other, "o").filter("back = g and g < o")
                      .select(F.col("g").alias("low"), F.col("o").alias("high"), "height", F.lit(step).alias("step")), "linkage-merges")
        merges = pairs if merges is None else merges.unionByName(pairs)
        a = groups.select(F.col("g").alias("low"), F.col("mean").alias("m1"), F.col("n").alias("n1"))
        b = groups.select(F.col("g").alias("high"), F.col("mean").alias("m2"), F.col("n").alias("n2"))
        total = F.col("n1") + F.col("n2")
        joint = pairs.join(a, "low").join(b, "high").select(
            F.col("low").alias("g"), F.zip_with("m1", "m2", lambda x, y: (x * F.col("n1") + y * F.col("n2")) / total).alias("mean"), total.alias("n"))
        gone = pairs.select(F.col("low").alias("g")).unionByName(pairs.select(F.col("high").alias("g")))
        groups = stage(groups.join(gone, "g", "left_anti").unionByName(joint), "linkage-groups")
        left, step = groups.count(), step + 1
    if merges is None:
        return vectors.sparkSession.createDataFrame([], "low bigint, high bigint, height double")
    # a merge never is higher than those it builds on; of equal ones these come first
    return merges.orderBy(F.desc("height"), "step", "low", "high").limit(need).select("low", "high", "height")


def merged_groups(vectors: DataFrame, target: int, ship_bytes: int = similarity.SHIP_BYTES) -> DataFrame:
    """``(g, group)`` after :func:`average_merges`; group is its least member."""
    merges = stage(average_merges(vectors, target, ship_bytes), "linkage-cut")
    edges = merges.select(F.col("low").alias("src"), F.col("high").alias("dst"))
    return connected_components(vectors.select(F.col("g").cast("long").alias("id")), edges).select(
        F.col("id").alias("g"), F.col("label").alias("group"))
