import math
import zlib

import pytest
from pyspark.sql import functions as F

from themeloom.llm import queries
from themeloom.llm import rule_ensemble as re_
from themeloom.llm.textstats import text_counts
from themeloom.session import ship_package

DOCS = "doc_id bigint, text string, score string, label string, n_words string"
LABELS = "doc_id bigint, quality int, toxic int"

PRINTED = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 0.5)
   If (feature 1 > 2.0)
    Predict: 1.0
   Else (feature 1 <= 2.0)
    Predict: 0.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 0.0
   Else (feature 0 > 0.75)
    Predict: 1.0
"""


def test_paths_become_rules():
    inf = math.inf
    assert re_.tree_rules(PRINTED, ["a", "b"]) == {
        (("a", -inf, .5),), (("a", -inf, .5), ("b", 2.0, inf)), (("a", -inf, .5), ("b", -inf, 2.0)),
        (("a", .5, inf),), (("a", .5, .75),), (("a", .75, inf),)}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    out = queries.QUERIES["op4_rule_ensemble"](spark, f"/root/testdata/{sf}")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= .5)
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").distinct()
    kinds = {(r.quality, r.right) for r in out.filter("held_out").join(labels, "doc_id")
             .groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()}
    assert {q for q, _ in kinds} == {0, 1} and all(right >= .93 for _, right in kinds)


def test_held_out_labels_change_nothing(spark):
    ship_package(spark)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20 + i % 9)) if i % 4 else "*** $$$ " * (10 + i % 5)) for i in range(120)]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    counts = text_counts(docs)
    right = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], LABELS)
    held = zlib.crc32
    wrong = spark.createDataFrame([(i, int((i % 4 > 0) != (held(str(i).encode()) % 3 == 1)), 0) for i in range(120)], LABELS)
    a, b = re_.fit_ensemble(counts, right), re_.fit_ensemble(counts, wrong)
    assert a == b and a.weights
    got = {r.doc_id: r.predicted for r in re_.scored(counts, a).collect()}
    assert got == {i: int(i % 4 > 0) for i in range(120)}


def test_odd_rows(spark):
    ship_package(spark)
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in [(1, None), (None, "x"), (2, ""), (2, ""), (3, "word " * 5000)]], DOCS)
    counts = text_counts(docs)
    none = spark.createDataFrame([], LABELS)
    for labels, score in ((none, .5), (spark.createDataFrame([(2, 1, None), (None, 0, 1), (9, None, 0)], LABELS), None)):
        rows = re_.scored(counts, re_.fit_ensemble(counts, labels)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert score is None or all(r.score == score for r in rows)
    # the same statistics with both labels: nothing to learn but the shares
    both = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (1, 0, 0), (4, 0, 0)], LABELS)
    assert re_.scored(counts, re_.fit_ensemble(counts, both)).count() == 5
    empty = text_counts(spark.createDataFrame([], DOCS))
    assert re_.scored(empty, re_.fit_ensemble(empty, none)).count() == 0
