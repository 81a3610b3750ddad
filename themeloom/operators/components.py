"""Connected components by alternating large-star and small-star steps.

Each round links every node to the least node of its neighbourhood. The number
of rounds is known to be at most about the squared logarithm of the number of
nodes, and the loop ends only when a round changes nothing. Rows are pairs of
numbers; a node with very many neighbours is aggregated per task first, and its
rows meet a written table, so that Spark may split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import stage


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with ``m``, the least of u and all its v."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: numbers, any order,
    repeats and loops allowed); component is the least node reachable."""
    pairs = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(pairs.filter("u = v")).distinct(), "cc-large")
        small = _star(large)
        pairs = stage(small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "cc-small")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return (pairs.unionByName(pairs.select(F.col("v").alias("u"), "v"))
            .groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, label)`` of every node: the least id of its component over the
    edges ``(src, dst)``; a node without edges is its own."""
    found = star_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return (nodes.select(F.col(id_col).alias("id")).join(found.withColumnRenamed("node", "id"), "id", "left")
            .select("id", F.coalesce("component", "id").alias("label")))
