"""Joins (J1-J8).

No broadcast hints on tables whose size grows with the data (``rows_with_key``
sends parts of a fixed number of keys): AQE measures
the shuffled side at run time and turns a sort-merge join into a broadcast
hash join only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``, which
is the size check; above it the shuffle join stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import similarity
from themeloom.session import stage


def rows_with_key(rows: DataFrame, keys: DataFrame, key: str, part_keys: int = 1 << 20, most_parts: int = 8) -> DataFrame:
    """Rows whose ``key`` (a number) is one of ``keys``. The keys go to every task,
    ``part_keys`` of them at a time, so wide rows are read where they lie, once
    for each part; with more than ``most_parts`` parts the rows move instead."""
    keys = stage(keys.select(key).filter(F.col(key).isNotNull()).distinct(), "join-keys")
    parts = max(1, -(-keys.count() // part_keys))
    if parts > most_parts:
        return rows.join(keys, key, "left_semi")

    def part(df: DataFrame, i: int) -> DataFrame:
        return df if parts == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i)

    # each broadcast has about part_keys numbers, however many keys there are
    met = [part(rows, i).join(F.broadcast(part(keys, i)), key, "left_semi") for i in range(parts)]
    return functools.reduce(DataFrame.unionByName, met)


def with_topic_info(docs: DataFrame, topic_info: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Documents left-joined with the topic names (``Name``).

    Column names resolve case-insensitively, so the info table's ``Topic``
    key is matched to ``topic`` and not kept twice."""
    info = topic_info.select(F.col("Topic").alias("_topic_key"), F.col("Name"))
    return docs.join(info, docs[topic_col] == info["_topic_key"], "left").drop("_topic_key")


def with_documents_by_text(rows: DataFrame, docs: DataFrame, text_col: str = "doc",
                           doc_text_col: str = "title_abstract", salts: int = 32, hot_share: float = 0.001) -> DataFrame:
    """Left join on the full text; duplicate texts multiply rows, as in the
    reference. Joining on ``row_id`` (J5) is the default elsewhere; this variant
    reproduces the text fan-out.

    The key is a 256-bit digest; the documents' texts do not move, a match takes
    its text from ``rows``. Texts that hold over ``hot_share`` of the rows (so at
    most its inverse many) are dealt to ``salts`` places, their documents to all
    of them."""
    left = rows.withColumn("_key", F.unhex(F.sha2(F.col(text_col).cast("string"), 256)))
    counts = stage(left.filter("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "text-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r["_key"] for r in counts.filter(F.col("_n") > max(1000, total * hot_share)).select("_key").collect()]
    is_hot = F.col("_key").isin(*[bytes(k) for k in hot]) if hot else F.lit(False)
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    right = (docs.withColumn("_key", F.unhex(F.sha2(F.col(doc_text_col).cast("string"), 256))).drop(doc_text_col)
             .withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
             .withColumn("_met", F.lit(True)))
    out = left.join(right, ["_key", "_salt"], "left")
    text = F.when(F.col("_met"), F.col(text_col)).alias(doc_text_col)
    return out.select(*rows.columns, *[text if c == doc_text_col else right[c] for c in docs.columns])


def with_summaries(rows: DataFrame, summaries: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Rows left-joined with topic summaries."""
    return rows.join(summaries, topic_col, "left")


def counts_with_names(counts: DataFrame, names: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Topic counts inner-joined with names; topics without a summary drop."""
    return counts.join(names, topic_col, "inner")


def align_by_row_id(*dfs: DataFrame, key: str = "row_id") -> DataFrame:
    """The reference aligns answers, topics and coordinates by position;
    here they share a key."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, key, "inner")
    return out


def top_similar(queries: DataFrame, candidates: DataFrame, n: int = 3, **kw) -> DataFrame:
    """For each query vector, the ``n`` most cosine-similar candidates."""
    return similarity.top_n_similar(queries, candidates, n=n, **kw)


def pending_requests(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned requests not yet collected (left anti join on the grid keys)."""
    return grid.join(done.select(*keys), keys, "left_anti")


def request_grid(groups: DataFrame, n_samples: int, sample_col: str = "sample") -> DataFrame:
    """Every group row repeated for samples 0..n-1 (an explode of a
    sequence, no cross join)."""
    g = groups.withColumn(sample_col, F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    return g.withColumn(sample_col, F.col(sample_col).cast("bigint"))
