"""Exact top-k Hamming search by incremental multi-index hashing.

A code of ``m`` segments within distance ``m (r + 1) - 1`` of a query agrees
with it to within ``r`` bits in one segment at least. The index holds every
distinct code once per segment, keyed by the segment's bits. Round ``r`` looks
up the segment values at distance exactly ``r`` from each open query's and
verifies the codes found; a query closes when the distance of its k-th best is
covered by the radius. Every round works on the queries that are still open.

Copies of a code keep their ``k`` least ids, which is all that a top-k ordered
by (distance, id) can need, so a very common vector is one index row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import stage


def sign_segments(embedding: Column, dims: int, segments: int) -> list[Column]:
    """A bit per dimension (set where the value is 0 or more; null and NaN are
    not), packed into ``segments`` whole numbers."""
    width = math.ceil(dims / segments)
    if width > 20:
        raise ValueError("a segment holds 20 bits at most: take more segments")
    bit = lambda acc, x: acc * 2 + F.when((x >= 0) & ~F.isnan(x), 1).otherwise(0)
    return [F.aggregate(F.slice(embedding, i * width + 1, min(width, dims - i * width)), F.lit(0), bit)
            for i in range(segments)]


def _flips(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits with ``radius`` of them set, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda x: F.bit_count(x) == radius)


def _distance(segments: int) -> Column:
    parts = [F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"s{i}"))) for i in range(segments)]
    return sum(parts[1:], parts[0])


def hamming_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """query_id, rank, vec_id, distance: the ``k`` nearest codes of each row of
    ``queries`` (vec_id, embedding) among ``vectors`` (vec_id, embedding).

    Ranks follow (distance, vec_id); a query that is itself among the vectors
    finds itself. Rows without an id, without an embedding, or of another
    length than the longest have no code and take no part. Rows that repeat an
    id and code count once. With fewer than ``k`` vectors all are returned.
    """
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if not dims or dims < 1:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, distance int")
    width = math.ceil(dims / segments)
    names = [f"s{i}" for i in range(segments)]
    coded = lambda df: (df.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dims))
                        .select("vec_id", *[c.alias(n) for c, n in zip(sign_segments(F.col("embedding"), dims, segments), names)])
                        .distinct())
    of_code = Window.partitionBy(*names).orderBy("vec_id")
    ids = coded(vectors).withColumn("__n", F.row_number().over(of_code)).filter(F.col("__n") <= k)
    codes = stage(ids.groupBy(*names).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                  .withColumn("code", F.monotonically_increasing_id()), "hamming-codes")
    need = min(k, codes.agg(F.sum(F.size("ids"))).first()[0] or 0)
    index = stage(codes.select("code", *names, F.size("ids").alias("held"), F.element_at("ids", 1).alias("first"),
                               F.posexplode(F.array(*names)).alias("segment", "value")), "hamming-index")
    own = [f"q{i}" for i in range(segments)]
    asked = coded(queries).select("vec_id", *[F.col(n).alias(q) for n, q in zip(names, own)])
    # queries with the same code share their work; ``bound``: distance of the k-th best so far
    every = stage(asked.select(*own).distinct().withColumn("query", F.monotonically_increasing_id())
                  .withColumn("bound", F.lit(None).cast("int")), "hamming-queries")
    nearest = Window.partitionBy("query").orderBy("distance", "first")
    so_far = nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = stage(index.select(F.lit(0).cast("long").alias("query"), "code", "held", "first",
                              F.lit(0).alias("distance")).limit(0), "hamming-best")
    open_, closed = every, best
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for radius in range(width + 1):
        # few rows become very many: they are dealt out first, and the join is told
        # to build on the index, as Spark would take the probes for a small table
        probes = (open_.select("query", "bound", *own, F.posexplode(F.array(*own)).alias("segment", "__own"))
                  .repartition(tasks, "query", "segment")
                  .withColumn("value", F.explode(F.transform(_flips(width, radius), lambda m: m.bitwiseXOR(F.col("__own"))))))
        found = (probes.join(index.hint("shuffle_hash"), ["segment", "value"])
                 .select("query", "code", "held", "first", _distance(segments).alias("distance"), "bound")
                 .filter(F.col("bound").isNull() | (F.col("distance") <= F.col("bound"))).drop("bound"))
        # a code met in several segments counts once; k codes hold k ids at least
        best = stage(found.unionByName(best).dropDuplicates(["query", "code"])
                     .withColumn("__n", F.row_number().over(nearest)).filter(F.col("__n") <= k).drop("__n"), "hamming-best")
        bounds = (best.withColumn("__ids", F.sum("held").over(so_far)).filter(F.col("__ids") >= need)
                  .groupBy("query").agg(F.min("distance").alias("bound")))
        judged = stage(open_.drop("bound").join(bounds, "query", "left"), "hamming-open")
        covered = F.coalesce(F.col("bound") < segments * (radius + 1), F.lit(False)) | F.lit(radius == width)
        closed = closed.unionByName(best.join(judged.filter(covered).select("query"), "query", "left_semi"))
        open_ = judged.filter(~covered)
        if open_.isEmpty():
            break
        best = best.join(open_.select("query"), "query", "left_semi")
    per_query = Window.partitionBy("query").orderBy("distance", "vec_id")
    ranked = (closed.join(codes.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("vec_id"))
              .withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k))
    # each query row has the result of its code
    named = asked.withColumnRenamed("vec_id", "query_id").join(every.select("query", *own), own).select("query", "query_id")
    return ranked.join(named, "query").select("query_id", "rank", "vec_id", "distance")
