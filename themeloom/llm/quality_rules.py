"""Quality rules: isolation forests on rule statistics, calibrated on labels.

Isolation trees split random statistics at random values; a document that few
splits isolate is unusual. There is a forest over each share of
``textstats.SHARES`` alone and one over all of them, as one unusual share among
many usual ones hardly shortens a path of the joint forest. Each forest's
threshold is calibrated on all labelled rows: the least score that at most
``clean_loss`` of the good ones reach. A forest that catches less than
``MIN_CATCH`` of the labelled bad rows tells nothing of them and is left out.

Trees are grown on ``POOL`` rows (those with the smallest hash), of which each
tree sees 256, as the method prescribes; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from themeloom.llm.common import small_batches, stage, utf8
from themeloom.llm.textstats import COUNTS, SHARES, counts_of, text_counts, with_shares

POOL, TREES, SAMPLE, BINS, SEED, MIN_CATCH = 8192, 100, 256, 4096, 11, 0.05
FEATURES = list(SHARES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary search tree of ``n`` keys."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


@dataclass
class Forest:
    """Trees in flat arrays: at leaves ``feature`` is -1 and ``value`` the path length."""

    features: list[int]
    sample: int = SAMPLE
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)

    def _node(self, rows: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> int:
        at = len(self.feature)
        for x in (self.feature, self.value, self.left, self.right):
            x.append(-1)
        low, high = rows.min(0), rows.max(0)
        open_ = [f for f in self.features if low[f] < high[f]]
        if depth == most or not open_:
            self.value[at] = depth + float(mean_path(len(rows)))
            return at
        f = open_[rng.integers(len(open_))]
        cut = rng.uniform(low[f], high[f])
        below = rows[:, f] <= cut
        if below.all():  # the draw met the largest value
            self.value[at] = depth + float(mean_path(len(rows)))
            return at
        self.feature[at], self.value[at] = f, float(cut)
        self.left[at] = self._node(rows[below], rng, depth + 1, most)
        self.right[at] = self._node(rows[~below], rng, depth + 1, most)
        return at

    def grow(self, pool: np.ndarray, trees: int, rng: np.random.Generator) -> Forest:
        self.sample = min(self.sample, len(pool))
        most = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        for _ in range(trees):
            rows = pool[rng.choice(len(pool), self.sample, replace=False)]
            self.roots.append(self._node(rows, rng, 0, most))
        return self

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are soon isolated."""
        feature, value, left, right = map(np.asarray, (self.feature, self.value, self.left, self.right))
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            inner = feature[at] >= 0
            while inner.any():
                below = rows[each, np.maximum(feature[at], 0)] <= value[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
                inner = feature[at] >= 0
            total += value[at]
        return 2 ** (-total / max(1, len(self.roots)) / max(float(mean_path(self.sample)), 1.0))


@dataclass
class RuleModel:
    """Forests with the bin from which a row counts as unusual (BINS + 1: never)."""

    forests: list[Forest]
    limits: list[int]

    def bins(self, shares: np.ndarray) -> np.ndarray:
        if not self.forests or not len(shares):
            return np.zeros((len(shares), len(self.forests)), np.int64)
        return np.stack([np.floor(f.scores(shares) * BINS).astype(np.int64) for f in self.forests], 1)

    def unusual(self, shares: np.ndarray) -> np.ndarray:
        return (self.bins(shares) >= np.asarray(self.limits, np.int64)).any(1)


def share_rows(counts: np.ndarray) -> np.ndarray:
    """The shares of rows of ``COUNTS``, as ``textstats.with_shares`` has them."""
    at = {n: i for i, n in enumerate(COUNTS)}
    return np.stack([counts[:, at[a]] / np.maximum(counts[:, at[b]], 1) for a, b in SHARES.values()], 1)


def grown_forests(counts: DataFrame, seed: int = SEED) -> list[Forest]:
    pool = (with_shares(counts.filter(~base_failed())).orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed)), "doc_id")
            .select(*FEATURES).limit(POOL).toPandas().to_numpy(float))
    if len(pool) < 2:
        return []
    rng = np.random.default_rng(seed)
    every = list(range(len(FEATURES)))
    return [Forest(f).grow(pool, TREES, rng) for f in ([x] for x in every)] + [Forest(every).grow(pool, TREES, rng)]


def _binned(model: RuleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = np.stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            bins = model.bins(shares)
            yield pa.record_batch([b.column(b.schema.get_field_index("quality")), pa.array(list(bins), pa.list_(pa.int64()))],
                                  names=["quality", "bins"])
    return run


def calibrated(counts: DataFrame, labels: DataFrame, forests: list[Forest], clean_loss: float) -> RuleModel:
    """Thresholds from all labelled rows that pass the base rules.

    Rows without a label of 0 or 1 do not count. Without rows of both kinds
    no forest is used, so nothing is unusual."""
    model = RuleModel(forests, [BINS + 1] * len(forests))
    if not forests:
        return model
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    rows = (with_shares(counts.filter(~base_failed())).join(known, "doc_id").select("quality", *FEATURES)
            .mapInArrow(_binned(model), "quality int, bins array<bigint>")
            .select("quality", F.posexplode("bins").alias("forest", "bin")))
    seen = np.zeros((len(forests), 2, BINS + 2), np.int64)
    for r in rows.groupBy("forest", "quality", "bin").count().collect():  # forests x 2 x bins rows at most
        seen[r["forest"], r["quality"], r["bin"]] += r["count"]
    for i, (bad, good) in enumerate(seen):
        if not bad.sum() or not good.sum():
            continue
        reach = lambda n: n[::-1].cumsum()[::-1]  # noqa: E731  rows in this bin or above
        limit = int(np.flatnonzero(reach(good) <= clean_loss * good.sum())[0])
        if reach(bad)[limit] >= MIN_CATCH * bad.sum():
            model.limits[i] = limit
    return model


def fit_rules(counts: DataFrame, labels: DataFrame, clean_loss: float = 0.001) -> RuleModel:
    return calibrated(counts, labels, grown_forests(counts), clean_loss)


def _judged(model: RuleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS], 1)
            unusual = model.unusual(share_rows(rows))
            yield pa.record_batch([*b.columns, pa.array(unusual, pa.bool_())], names=[*b.schema.names, "unusual"])
    return run


def judge(counts: DataFrame, model: RuleModel) -> DataFrame:
    """``counts`` plus base_failed, unusual and kept.

    Rows that fail the base rules are not kept whatever the forests say."""
    schema = StructType([*counts.schema, StructField("unusual", BooleanType())])
    judged = counts.mapInArrow(_judged(model), schema)
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("unusual"))


def _passing(model: RuleModel):
    at = {n: i for i, n in enumerate(COUNTS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = np.array([counts_of(t) for t in utf8(b, "text")], np.int64).reshape(-1, len(COUNTS))
            words, repeats = rows[:, at["n_words"]], rows[:, at["n_repeat_words"]]
            keep = (words >= 50) & (100 * repeats <= 50 * words) & ~model.unusual(share_rows(rows))
            yield b.filter(pa.array(keep))
    return run


def keep_passing(docs: DataFrame, labels: DataFrame, clean_loss: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    The statistics are taken once to fit and once to filter, so that no text
    is shuffled. A null text has no words and goes."""
    model = fit_rules(stage(text_counts(docs), "rule-counts"), labels, clean_loss)
    return docs.mapInArrow(_passing(model), docs.schema)
