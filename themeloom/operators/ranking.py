"""Sorting, top-k, per-group ranking and sampling.

Per-group top-n is ``row_number() <= n`` with a literal ``n``: Spark plans a
partial ``WindowGroupLimit`` below the shuffle, so each map task forwards at
most ``n`` rows per group and a hot group is never sorted whole. Global
top-k is ``orderBy().limit()`` -> ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators import stats
from themeloom.session import stage


def sort_mixed(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``[(col, ascending), ...]``; nulls last both ways (pandas)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in keys])


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (ties must be broken
    by the caller's order for a deterministic result)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k (the limit is the feature)."""
    return df.orderBy(*order).limit(k)


def top_docs_per_topic(df: DataFrame, n: int = 5, topic_col: str = "topic",
                       prob_col: str = "probability", cites_col: str | None = None,
                       id_col: str = "row_id") -> DataFrame:
    """Top documents of each topic, with the reference's two-way rule.

    If a topic has at least ``n`` rows at probability exactly 1.0, those rows
    are ranked by citations; otherwise the whole topic is ranked by
    probability. Noise (-1) is skipped. The citation column is
    ``total_cites``, else ``cited_by_count``; with neither (answers) the rank
    falls back to probability. Ties by ``id_col``.

    Both rankings run over narrow rows, each with its limit before the
    shuffle; the per-topic count chooses between them, and only the survivors'
    rows are fetched (``id_col`` names a row): the survivors are written, so that
    Spark knows their size and need not move the rows that it looks them up in.
    """
    if cites_col is None:
        cites_col = next((c for c in ("total_cites", "cited_by_count") if c in df.columns), None)
    d = df.filter(F.col(topic_col) != -1)
    by_prob, certain = F.col(prob_col).cast("double"), F.col(prob_col) == 1.0
    by_cites = F.col(cites_col).cast("double") if cites_col is not None else by_prob
    ones = d.groupBy(topic_col).agg(F.count_if(certain).alias("_n1"))
    narrow = d.select(topic_col, id_col, by_prob.alias("_p"), by_cites.alias("_c"))
    first = top_n_per_group(narrow.filter(F.col("_p") == 1.0), [topic_col], [F.col("_c").desc_nulls_last(), F.col(id_col)], n)
    second = top_n_per_group(narrow, [topic_col], [F.col("_p").desc_nulls_last(), F.col(id_col)], n)
    chosen = first.withColumn("_cited", F.lit(True)).unionByName(second.withColumn("_cited", F.lit(False)))
    chosen = chosen.join(ones, topic_col).filter(F.col("_cited") == (F.col("_n1") >= n)).select(topic_col, id_col, "rank")
    return d.join(stage(chosen, "top-docs"), [topic_col, id_col])


def balanced_sample(df: DataFrame, keys: list[str], id_col: str, cap: int = 100,
                    seed: int = 42) -> DataFrame:
    """Per group exactly ``min(cap, smallest group size)`` rows, seeded.

    Rows are ordered by ``md5(seed || '|' || id)``, a hash any engine can
    reproduce. The smallest group size (A4) is a scalar subquery; the literal
    ``cap`` bound lets the limit run map-side before the shuffle.
    """
    n = F.least(F.lit(cap), stats.smallest_group_size(df, keys).scalar())
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(id_col).cast("string")))
    w = Window.partitionBy(*keys).orderBy(h, F.col(id_col))
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
            .filter(F.col("_rn") <= n).drop("_rn"))
