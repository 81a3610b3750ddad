"""Mixing sources to target weights by exponential-key sampling.

Every document draws the key ``-ln(u) / w``: ``u`` in (0, 1) from the MD5 of
seed, id and text, ``w`` its quality weight, so that the documents with the
smallest keys of a source are a weighted sample without replacement. A source
first repeats completely as often as its word target holds its size; the rest
of the target is filled in key order while that brings it nearer to the target.

Only DataFrame functions are used. The running sum over a source is taken over
bins of the key's logarithm, whatever the weights are, then over even parts of
the one bin in which the target is met, each of about ``RANGE_ROWS`` documents;
only the documents of the one part in which it is met are sorted, so no source,
however large, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import stage, text_or_empty

RANGE_ROWS = 4096
BINS = 64  # of keys to each power of two: a bin is about 1 % of its keys wide, so keys lie evenly in it


def collapsed_text(text: Column) -> Column:
    """The text with every white-space run as one space and none at its ends."""
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` plus ``__size`` (words) and ``__key`` (sampling key).

    The quality weight is ``1 / (1 + 20 * symbols per word)``, with symbols the
    characters ``# * $ % & | < >``. A null text has no words.
    """
    text = text_or_empty()
    docs = docs.withColumn("__flat", collapsed_text(text))
    size = F.when(F.octet_length("__flat") == 0, 0).otherwise(
        F.octet_length("__flat") - F.octet_length(F.replace(F.col("__flat"), F.lit(" "))) + 1).cast("long")
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    named = F.concat_ws("\n", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    drawn = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")
    u = (drawn.cast("double") + 0.5) / float(1 << 52)
    docs = docs.select("*", size.alias("__size"), symbols.alias("__symbols"), u.alias("__u"))
    weight = 1.0 / (1.0 + 20.0 * F.col("__symbols") / F.greatest(F.col("__size"), F.lit(1)))
    return docs.withColumn("__key", -F.log("__u") / weight).drop("__flat", "__symbols", "__u")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
            max_epochs: int = 2) -> DataFrame:
    """Word targets of ``sizes(source, source_size, ...)``, a row per source.

    ``weights`` repeat over the sources in code-point order, null last. The
    targets share ``share`` times all words by weight; none passes
    ``max_epochs`` times its source's size, and what is cut off goes to the
    others by weight again. The sources that end at their bound are the first
    ones in order of bound / weight, so one running sum finds them. Windows
    here run over a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    out = (sizes.withColumn("__w", F.element_at(wheel, ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
           .withColumn("__cap", F.col("source_size") * max_epochs)
           .withColumn("__all", F.sum("source_size").over(everything) * share))
    in_order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(rest)
    out = out.withColumn("__capped", F.col("__cap") / F.col("__w") <= level)
    left = F.col("__all") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__cap"))).over(everything), F.lit(0))
    shared = left / F.sum(F.when(~F.col("__capped"), F.col("__w"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("__w") * shared)
    return out.withColumn("target", target).drop("__w", "__cap", "__all", "__capped")


def _bin_of(key: Column) -> Column:
    return F.floor(F.log2(key) * BINS)


def _part_of(key: Column, bin_no: Column, parts: Column) -> Column:
    """Which of ``parts`` even parts of its bin a key lies in."""
    low, high = F.pow(F.lit(2.0), bin_no / BINS), F.pow(F.lit(2.0), (bin_no + 1) / BINS)
    return F.greatest(F.lit(0), F.least(F.floor((key - low) / (high - low) * parts), parts - 1))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mixing_plan(rows: DataFrame, **options) -> DataFrame:
    """A row per source: source, source_size, target, epochs (complete ones) and
    cut, the largest key taken once more (null: none).

    ``rows`` holds source, ``__size`` and ``__key`` of every document. Rows
    whose id and text are equal share a key and are taken together.
    """
    sizes = rows.groupBy("source").agg(F.sum("__size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stage(targets(sizes, **options).withColumn("epochs", whole.cast("long"))
                 .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    keyed = (rows.alias("r").join(plan.alias("p"), same_source("r", "p"))
             .filter(F.col("rest") > 0)
             .select("r.source", "__size", "__key", "rest", _bin_of(F.col("__key")).alias("range")))

    def met_range(ranges: DataFrame) -> DataFrame:
        """Of each source the last range that begins before the rest is used up."""
        running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (ranges.groupBy("source", "range").agg(F.sum("__size").alias("words"), F.count("*").alias("n"),
                                                      F.max("rest").alias("rest"), F.max("before").alias("before"))
                .withColumn("begins", F.col("before") + F.sum("words").over(running) - F.col("words"))
                .filter(F.col("begins") < F.col("rest"))
                .groupBy("source").agg(F.max(F.struct("range", "begins", "n")).alias("m"))
                .select("source", "m.range", "m.begins", "m.n"))

    def within(rows_: DataFrame, met: DataFrame) -> DataFrame:
        return rows_.alias("k").join(met.alias("m"), same_source("k", "m") & (F.col("k.range") == F.col("m.range")))

    met = stage(met_range(keyed.withColumn("before", F.lit(0).cast("long"))), "mix-bins")
    keyed = stage(within(keyed, met).select(
        "k.source", "__size", "__key", "rest", F.col("begins").alias("before"),
        _part_of(F.col("__key"), F.col("k.range"), F.ceil(F.col("n") / RANGE_ROWS)).alias("range")), "mix-bin-rows")
    met = stage(met_range(keyed), "mix-ranges")
    in_range = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.col("begins") + F.sum("__size").over(in_range) - F.col("__size") / 2 <= F.col("rest")
    cuts = (within(keyed, met)
            .select("k.source", "__size", "__key", "rest", "begins")
            .withColumn("near", nearest)
            # if not even the first fits, the cut lies just below this range
            .groupBy("source").agg(F.max(F.when(F.col("near"), F.col("__key"))).alias("last"),
                                   F.min("__key").alias("first")))
    return stage(plan.alias("p").join(cuts.alias("c"), same_source("p", "c"), "left")
                 .select("p.source", "source_size", "target", "epochs", "last",
                         F.when(F.col("last").isNull(), F.col("first")).alias("below")), "mix-plan")


def copies() -> Column:
    """How often a row joined with its source's plan is taken."""
    once_more = F.coalesce(F.col("__key") <= F.col("last"), F.col("__key") < F.col("below"), F.lit(False))
    return F.col("epochs") + once_more.cast("long")


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` plus ``__source_size``, ``__target`` and ``__copies``."""
    kept = [F.col(f"r.`{c}`") for c in rows.columns]
    return (rows.alias("r").join(plan.alias("p"), same_source("r", "p"))
            .select(*kept, F.col("p.source_size").alias("__source_size"), F.col("p.target").alias("__target"),
                    copies().alias("__copies")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    plan = mixing_plan(stage(sized(docs).select("source", "__size", "__key"), "mix-sizes"), **options)
    return (mixed(sized(docs), plan).filter(F.col("__copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
