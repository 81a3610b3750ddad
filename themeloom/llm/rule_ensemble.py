"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on the labelled rows; every path from a root
to an inner or end node is a rule, a conjunction of bounds on statistics. The
rules, as 0/1 columns, go into a logistic regression with lasso penalty, which
leaves a weight on few of them. The model is then one Spark column expression:
the logistic function of the weighted rules. Training reads all labelled rows
and runs on Spark's own trees and regression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import stage
from themeloom.llm.textstats import SHARES, with_shares

FEATURES = [*SHARES, "n_words", "n_lines"]
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.002, 7

#: A rule: bounds as sorted (statistic, above, up to) with infinities for none.
Rule = tuple[tuple[str, float, float], ...]


@dataclass
class RuleEnsemble:
    """``intercept + sum of the weights of the rules that hold``, through the logistic function."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(condition(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(name) > low)
        if high < math.inf:
            out = out & (F.col(name) <= high)
    return out


def tree_rules(printed: str, features: list[str]) -> set[Rule]:
    """The rules of a tree in Spark's printed form: a line per branch, indented by depth."""
    out: set[Rule] = set()
    path: list[tuple[int, str, str, float]] = []
    for line in printed.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, features[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, list[float]] = {}
        for _, name, sign, value in path:
            b = bounds.setdefault(name, [-math.inf, math.inf])
            if sign == ">":
                b[0] = max(b[0], value)
            else:
                b[1] = min(b[1], value)
        out.add(tuple(sorted((n, lo, hi) for n, (lo, hi) in bounds.items())))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3.

    A row without an id counts as an empty text here."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and label (0.0 or 1.0) of the labelled rows that may be learned
    from. An id with more labels has that of the majority, none on a tie."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg("quality").alias("mean")).filter("mean <> 0.5")
             .select("doc_id", F.round("mean").alias("label")))
    return with_shares(counts).join(known, "doc_id").select("label", *[F.col(f).cast("double").alias(f) for f in FEATURES])


def fit_ensemble(counts: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> RuleEnsemble:
    """Without labelled rows of both kinds the score is their share of good
    rows, or a half without any."""
    rows = stage(training_rows(counts, labels), "rule-training")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleEnsemble({1.0: 20.0, 0.0: -20.0}[next(iter(seen))] if seen else 0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=max(1, min(seen.values()) // 50))
    trees = forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).trees
    rules = sorted(set().union(*(tree_rules(t.toDebugString, FEATURES) for t in trees)))
    if not rules:  # no statistic tells the kinds apart
        return RuleEnsemble(math.log(seen[1.0] / seen[0.0]))
    names = [f"r{i}" for i in range(len(rules))]
    marked = rows.select("label", *[condition(r).cast("double").alias(n) for r, n in zip(rules, names)])
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60)
    fitted = lasso.fit(VectorAssembler(inputCols=names, outputCol="features").transform(marked))
    return RuleEnsemble(float(fitted.intercept), {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray()) if w})


def scored(counts: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on)."""
    return (with_shares(counts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
