"""Deduplication and record merging.

Keep-first semantics need an order: every function takes the ordinal
column(s) and never relies on physical row order. ``row_number() = 1`` with a
literal bound plans as a partial ``WindowGroupLimit`` before the shuffle, so a
hot key (one doi holding a third of the rows) is cut down map-side and never
sorted whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order_cols) -> list[Column]:
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def keep_first(df: DataFrame, key: str | list[str], order_cols) -> DataFrame:
    """Keep the first row of each ``key`` group by ``order_cols``.

    Null keys form one group, as in pandas ``drop_duplicates``.
    """
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*_order(order_cols))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def distinct_rows(df: DataFrame, order_cols) -> DataFrame:
    """Full-row distinct over every column but the ordinal, keeping the
    smallest ordinal (which names a row). Rows are told apart by a 256-bit
    digest, so the aggregation moves narrow rows, repeated ones merged before
    the shuffle, and the winners' rows are then fetched by their ordinal."""
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rest = [c for c in df.columns if c not in order]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*rest)), 256)).alias("_digest")
    least = F.min(F.struct(*[F.col(c) for c in order])).alias("_o")
    winners = df.select(digest, *order).groupBy("_digest").agg(least).select("_o.*")
    return df.join(winners.hint("shuffle_hash"), order, "left_semi").select(df.columns)


def dedupe_doi_then_title(df: DataFrame, order_cols="ordinal",
                          doi_col: str = "doi", title_col: str = "title") -> DataFrame:
    """Keep-first by doi, then keep-first by title, in sequence (a row that
    lost on doi cannot win a title)."""
    return keep_first(keep_first(df, doi_col, order_cols), title_col, order_cols)


def _one_number(order: list[str]) -> Column:
    """One or two whole-number order columns (the first below 10^17 in size) as one number."""
    if len(order) == 1:
        return F.col(order[0])
    if len(order) > 2:
        raise ValueError("order by one or two whole-number columns")
    high, low = F.col(order[0]).cast("decimal(17,0)"), F.col(order[1]).cast("decimal(19,0)")
    return (high * F.lit("100000000000000000000").cast("decimal(21,0)") + low).cast("decimal(38,0)")


def merge_first_non_null(df: DataFrame, key: str, order_cols, drop_null_key: bool = True) -> DataFrame:
    """D3: one row per ``key``; every column independently takes its first
    non-null value in source order.

    A narrow hash aggregate finds, per key and column, the ordinal of the first
    row with a value; the rows so named (at most one per column) are fetched
    once, each with the columns that it won, and put together. The ordinal
    names a row.
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if drop_null_key:
        df = df.filter(F.col(key).isNotNull())  # pandas groupby drops null keys (P2)
    rest = [c for c in df.columns if c != key and c not in order]
    df = df.withColumn("_at", _one_number(order))
    won = [F.min(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_w{i}") for i, c in enumerate(rest)]
    first = df.groupBy(key).agg(*won, F.min("_at").alias("_w"))
    at = [f"_w{i}" for i in range(len(rest))]
    wanted = first.select(*at, "_w", F.explode(F.array_distinct(F.array_compact(F.array(*at, "_w")))).alias("_at"))
    rows = df.join(wanted.hint("shuffle_hash"), "_at")
    mine = [F.when(F.col("_at") == F.col(w), F.col(c)).alias(c) for w, c in zip(at, rest)]
    mine += [F.when(F.col("_at") == F.col("_w"), F.col(c)).alias(c) for c in order]
    held = rows.select(key, F.struct(*mine).alias("_r")).groupBy(key).agg(F.collect_list("_r").alias("_r"))

    def value(c: str) -> Column:
        return F.get(F.filter("_r", lambda r: r[c].isNotNull()), 0)[c].alias(c)

    return held.select(key, *[value(c) for c in [*rest, *order]])


def title_dedupe_smallest_doi(df: DataFrame, title_col: str = "title", doi_col: str = "doi") -> DataFrame:
    """After D3 the reference's frame is sorted by doi, so keep-first by
    title keeps the smallest doi."""
    return keep_first(df, title_col, [doi_col])
