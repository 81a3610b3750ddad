"""Near-duplicate removal on top of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import stage
from themeloom.llm.ngram_join import jaccard_components


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of the
    join the row with the least doc_id stays, with all its columns.

    Documents without words stay, each of them, as they link with nothing.
    Rows without an id are a group's representative only where no row of it
    has one; then one of them stays, as does one of rows that repeat an id.
    """
    marked = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    # the join tells rows apart by this number, so ids may repeat or be missing
    linked = jaccard_components(marked.select(F.col("__row").alias("doc_id"), "text"), width, percent)
    ids = marked.select("__row", "doc_id")
    kept = (linked.withColumnRenamed("doc_id", "__row").join(ids, "__row")
            .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("least"))
            .select(F.col("least.__row").alias("__row")))
    return marked.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
