"""Aggregations.

Aggregates combine map-side before the shuffle. Quartiles are order statistics
found by counting; they reach the driver as numbers, and later steps hold them
as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.session import stage


def count_per_group(df: DataFrame, keys: list[str], drop_null: list[str] | None = None,
                    name: str = "count") -> DataFrame:
    """A1 / A3: rows per group; pandas drops null keys (P2), so do the same
    for the columns in ``drop_null``."""
    for c in drop_null or []:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_per_group(df: DataFrame, keys: list[str], col: str, name: str = "n_distinct") -> DataFrame:
    """A2: number of distinct non-null ``col`` values per group."""
    return df.groupBy(*keys).agg(F.count_distinct(F.col(col)).alias(name))


def smallest_group_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: one row, ``min_group_size``."""
    return df.groupBy(*keys).count().agg(F.min("count").alias("min_group_size"))


def count_at_minimum(df: DataFrame, col: str = "cited_by_count") -> DataFrame:
    """A5: one row: the minimum value and how many rows have it. Two hash
    aggregates (per value, then min_by over the value counts), no join."""
    per_value = df.filter(F.col(col).isNotNull()).groupBy(col).count()
    return per_value.agg(F.min(col).alias("min_value"),
                         F.min_by("count", col).cast("bigint").alias("n_at_min"))


def order_statistics(df: DataFrame, col: str, ranks: list[int], bins: int = 4096) -> dict[int, float]:
    """The values at the given ranks (from 0) of the sorted non-null numbers.

    Each round counts, per open interval, the values of ``bins`` equal bins and
    goes on in the bins that hold a rank, until such a bin has one value. What
    moves is counts; the driver reads at most ``bins`` rows per open rank. The
    values are read once a round. Infinite values count as the largest doubles."""
    big = 1.7976931348623157e308
    v = F.greatest(F.lit(-big), F.least(F.lit(big), F.col(col).cast("double")))
    values = df.select(v.alias("v")).filter("v is not null and not isnan(v)")
    least, most = values.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_: dict[tuple, list[tuple[int, int]]] = {(least, most): [(r, r) for r in ranks]}  # rank, rank within
    while open_:
        one = [k for k in open_ if k[0] == k[1]]
        for k in one:
            found.update({rank: k[0] for rank, _ in open_.pop(k)})
        parts = []
        for low, high in open_:
            # halves, as a difference of doubles may be no double
            place = (F.col("v") * 0.5 - low * 0.5) / F.lit(high * 0.5 - low * 0.5) * bins
            inside = (F.col("v") >= low) & (F.col("v") <= high)
            parts.append(F.when(inside, F.struct(F.lit(len(parts)).alias("i"),
                                                 F.least(F.lit(bins - 1), F.floor(place).cast("int")).alias("bin"))))
        if not parts:
            break
        rows = (values.select("v", F.explode(F.array_compact(F.array(*parts))).alias("at")).groupBy("at.i", "at.bin")
                .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i", "bin").collect())
        following: dict[tuple, list[tuple[int, int]]] = {}
        for i, wanted in enumerate(open_.values()):
            below = 0
            for r in (r for r in rows if r.i == i):
                for rank, at in wanted:
                    if below <= at < below + r.n:
                        following.setdefault((r.low, r.high), []).append((rank, at - below))
                below += r.n
        open_ = following
    return found


def quartile_values(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75)) -> list[float | None]:
    """A6 as numbers: quantiles with linear interpolation (nulls and NaN
    skipped, as pandas; None where there are no values). ``df`` is read a few
    times; where it is not a written table, its column is written first."""
    rows = stage(df.select(F.col(col).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "quantile-values")
    n = rows.count()
    if n == 0:
        return [None for _ in probs]
    at = [(n - 1) * p for p in probs]
    ranks = sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at})
    value = order_statistics(rows, "v", ranks)
    return [value[int(x)] + (x - int(x)) * (value[min(int(x) + 1, n - 1)] - value[int(x)]) if x != int(x) else value[int(x)] for x in at]


def quartiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75), approx: bool = False,
              accuracy: int = 10_000) -> DataFrame:
    """Quartiles, one row with columns ``q25, q50, q75``: exact ones by
    :func:`quartile_values`; ``approx`` uses ``percentile_approx``, which
    returns data points instead of interpolating."""
    names = [f"q{int(round(p * 100))}" for p in probs]
    if approx:
        arr = F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy)
        return df.agg(arr.alias("_q")).select(*[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    found = quartile_values(df, col, probs)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(nm) for v, nm in zip(found, names)])


def value_counts(df: DataFrame, col: str, include_null: bool = False, name: str = "count") -> DataFrame:
    """Counts per value, most frequent first (ties by value)."""
    if not include_null:
        df = df.filter(F.col(col).isNotNull())
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(col).asc_nulls_last())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A8."""
    return df.select(col).distinct()


def count_over(df: DataFrame, col: str, limit: int = 20_000, name: str = "n_over") -> DataFrame:
    """How many rows have ``col > limit``."""
    return df.agg(F.count_if(F.col(col) > limit).cast("bigint").alias(name))


def row_max_probability(probabilities) -> Column:
    """A10: the maximum of each row's probability vector (not the global one)."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.array_max(p)


def topic_info(df: DataFrame, topic_col: str = "topic", names: DataFrame | None = None) -> DataFrame:
    """``Topic, Count`` (+ ``Name`` when a name table is given)."""
    info = df.groupBy(F.col(topic_col).alias("Topic")).agg(F.count(F.lit(1)).alias("Count"))
    if names is not None:
        info = info.join(names, "Topic", "left")
    return info


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """The row count after each named stage in one pass.

    ``stages`` are cumulative predicates in order; stage k counts rows that
    pass predicates 1..k. One aggregate over boolean flags, not one
    ``count()`` action per stage.
    """
    aggs, acc = [], F.lit(True)
    for name, pred in stages:
        acc = acc & F.coalesce(pred, F.lit(False))
        aggs.append(F.count_if(acc).cast("bigint").alias(name))
    return df.agg(F.count(F.lit(1)).alias("input"), *aggs)


def funnel_counts(df: DataFrame, **named_counts: DataFrame) -> DataFrame:
    """A12 for stages that are not row predicates (dedupe): one row with the
    count of each given DataFrame, as scalar subqueries of a single plan."""
    spark = df.sparkSession
    cols = [F.lit(1).alias("_")]
    cols += [d.agg(F.count(F.lit(1))).scalar().alias(k) for k, d in named_counts.items()]
    return spark.range(1).select(*cols).drop("_")


def join_ranked_texts(df: DataFrame, group: str, rank_col: str, text_col: str,
                      sep: str = "\n", name: str = "texts") -> DataFrame:
    """Texts of each group, joined in rank order. Apply after a top-n so
    every collected list is bounded by n."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"))))
    return df.groupBy(group).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), sep).alias(name))
