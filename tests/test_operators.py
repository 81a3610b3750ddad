"""Operators: BM25 against a plain restatement, dedupe, sampling, ranking."""
import math

from pyspark.sql import functions as F

import pytest

from themeloom.operators import dedupe, joins, ranking, retrieval, stats


def bm25_plain(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [d.split(" ") for d in corpus]
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (eps * mean if v < 0 else v) for t, v in idf.items()}
    out = []
    for d in docs:
        s = 0.0
        for q in query.split(" "):
            f = d.count(q)
            s += idf.get(q, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avgdl))
        out.append(s)
    return out


def test_bm25_matches_plain(spark):
    corpus = ["the cat sat", "the dog", "a cat and a dog and the bird", "the the the", "zebra  crossing"]
    q = "the cat cat unknown"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "id long, t string")
    got = {r["id"]: r["bm25_score"] for r in retrieval.bm25_scores(df, q, "t").collect()}
    want = bm25_plain(corpus, q)
    for i, w in enumerate(want):
        assert abs(got[i] - w) < 1e-9


def test_keep_first_and_idempotent(spark):
    rows = [(1, "d1", "t1"), (2, "d1", "t2"), (3, "d2", "t1"), (4, "d3", "t3")]
    df = spark.createDataFrame(rows, "ordinal long, doi string, title string")
    out = dedupe.dedupe_doi_then_title(df)
    assert sorted(r.ordinal for r in out.collect()) == [1, 4]  # row 3 loses on title to row 1
    again = dedupe.dedupe_doi_then_title(out)
    assert sorted(r.ordinal for r in again.collect()) == [1, 4]


def test_merge_first_non_null(spark):
    rows = [(0, 5, "x", None, None), (1, 1, "x", "T", None), (0, 9, "x", "U", 7), (0, 1, None, "Z", 1)]
    df = spark.createDataFrame(rows, "f int, p long, doi string, title string, cites long")
    r = dedupe.merge_first_non_null(df, "doi", ["f", "p"]).collect()
    assert len(r) == 1 and r[0].title == "U" and r[0].cites == 7 and (r[0].f, r[0].p) == (0, 5)


def test_balanced_sample_sizes_and_repeatable(spark):
    rows = [(i, "a" if i < 30 else "b") for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, g string")
    s1 = ranking.balanced_sample(df, ["g"], "row_id", cap=100, seed=1)
    counts = {r.g: r["count"] for r in s1.groupBy("g").count().collect()}
    assert counts == {"a": 30, "b": 30}
    s2 = ranking.balanced_sample(df.repartition(7), ["g"], "row_id", cap=100, seed=1)
    assert sorted(r.row_id for r in s1.collect()) == sorted(r.row_id for r in s2.collect())
    s3 = ranking.balanced_sample(df, ["g"], "row_id", cap=10, seed=1)
    assert s3.count() == 20


def test_top_docs_two_way_rule(spark):
    rows = [(i, 0, 1.0 if i < 6 else 0.5, 100 - i) for i in range(10)] + \
           [(10 + i, 1, 1.0 if i < 2 else i / 10, i) for i in range(8)] + [(99, -1, 1.0, 1000)]
    df = spark.createDataFrame(rows, "row_id long, topic int, probability double, total_cites long")
    out = {(r.topic, r["rank"]): r.row_id for r in ranking.top_docs_per_topic(df, 5).collect()}
    assert [out[(0, k)] for k in range(1, 6)] == [0, 1, 2, 3, 4]      # by citations among p == 1
    assert [out[(1, k)] for k in range(1, 3)] == [10, 11]              # by probability
    assert not any(t == -1 for t, _ in out)


def test_funnel_one_pass(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    r = stats.funnel(df, [("ge1", F.col("x") >= 1), ("eq2", F.col("x") == 2)]).first()
    assert (r.input, r.ge1, r.eq2) == (10, 6, 3)


def test_answers_stream_roundtrip(spark, tmp_path):
    import json

    from themeloom.streaming import answers as st

    src = tmp_path / "in"
    src.mkdir()
    recs = [{"answer": ["1. **A**: x", "2. **B b**: y", "Overall fine"], "datetime": "2024-01-01T00:00:00",
             "gpt_model": "m", "temperature": 0.5, "research_question": "q", "system_message": "s"}]
    (src / "part1.jsonl").write_text("\n".join(json.dumps(r) for r in recs) + "\n")
    lines = st.answer_lines_stream(st.answer_records_stream(spark, str(src)))
    q = st.start_append(lines, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [r.heading for r in got] == ["a", "b b", None]
    assert got[0].answer_cleaned == " A: x"


def test_merge_needs_no_sort_of_values(spark):
    rows = [(0, i, "hot" if i % 2 else f"k{i}", None if i % 3 else f"t{i}", i if i % 5 == 0 else None) for i in range(300)] + [(1, 0, None, "z", 1)]
    df = spark.createDataFrame(rows, "f int, p long, doi string, title string, cites long")
    out = dedupe.merge_first_non_null(df, "doi", ["f", "p"])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doi: (r.title, r.cites, r.f, r.p) for r in out.collect()}
    want = {}
    for f, p, k, t, c in rows:
        if k is not None:
            a = want.setdefault(k, [None, None, f, p])
            a[0], a[1] = a[0] or t, a[1] if a[1] is not None else c
    assert got == {k: tuple(v) for k, v in want.items()}
    one = dedupe.merge_first_non_null(df.drop("f"), "doi", "p", drop_null_key=False)
    assert one.count() == len(want) + 1


@pytest.mark.parametrize("bins", [2, 4096])
def test_order_statistics(spark, bins):
    import random

    r = random.Random(4)
    values = [r.choice([0.0, -0.0, 1e-300, -1e308, 1e308, 3.5, float("inf")]) for _ in range(40)] + [r.gauss(0, 1e6) for _ in range(200)] + [7.0] * 100
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    want = sorted(min(v, 1.7976931348623157e308) for v in values)
    ranks = [0, 1, 57, 170, 171, len(values) - 1]
    assert stats.order_statistics(df, "v", ranks, bins) == {k: want[k] for k in ranks}


def test_quartiles_are_those_of_numpy(spark):
    import numpy as np

    for values in ([5], [1, 2], [3, 3, 3, 9], list(range(101)), [x * x % 97 for x in range(250)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
        assert np.allclose(stats.quartile_values(df, "v"), np.percentile(values, [25, 50, 75]))
    none = stats.quartiles(spark.createDataFrame([], "v long"), "v").first()
    assert (none.q25, none.q50, none.q75) == (None, None, None)


def test_join_on_text_with_a_hot_text_on_both_sides(spark):
    from themeloom.operators import joins

    rows = [(i, "hot" if i % 2 else f"t{i % 50}" if i % 3 else None) for i in range(2600)]
    docs = [(i, "hot" if i < 6 else f"t{i}", "x") for i in range(60)] + [(99, None, "y")]
    left = spark.createDataFrame(rows, "file_pos long, doc string")
    right = spark.createDataFrame(docs, "row_id long, title_abstract string, extra string")
    got = joins.with_documents_by_text(left, right, salts=4)
    assert got.columns == ["file_pos", "doc", "row_id", "title_abstract", "extra"]
    want = sorted(((i, t, *m) for i, t in rows for m in ([m for m in docs if t is not None and m[1] == t] or [(None, None, None)])), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x]
    assert exchanges and all("doc" not in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges)


@pytest.mark.parametrize("part_keys,most_parts", [(100, 8), (2, 8), (2, 1)])
def test_rows_with_key_keeps_repeats_and_drops_nulls(spark, part_keys, most_parts):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, f"t{i}") for i in range(40)], "k long, t string")
    keys = spark.createDataFrame([(k,) for k in (1, 3, 3, 4, 6, 99, None)], "k long")
    got = joins.rows_with_key(rows, keys, "k", part_keys, most_parts)
    assert sorted(r.t for r in got.collect()) == sorted(f"t{i}" for i in range(40) if i % 5 and i % 7 in (1, 3, 4, 6))


def test_texts_without_a_vector_do_not_move(spark, tmp_path):
    from themeloom.sources import corpora

    spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 2, 3, 4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 5, [1.0]), (3, None, [2.0]), (3, 1, [3.0]), (4, 1, None), (8, 1, [4.0]), (None, 1, [5.0])],
                          "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = corpora.topic_docs(spark, str(tmp_path), with_vector=True)
    every = corpora.topic_docs(spark, str(tmp_path)).filter("embedding is not null")
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect())) and got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan  # by broadcast: before the join with the vectors, texts are not shuffled


def test_texts_do_not_move_to_meet_top_docs(spark):
    from themeloom.operators import ranking

    rows = [(i, i % 3, (i % 10) / 10, i % 7, f"text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "row_id long, topic int, probability double, total_cites long, text string")
    top = ranking.top_docs_per_topic(docs, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    want = {(t, r[0], k) for t in range(3) for k, r in enumerate(sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2], r[0]))[:2], 1)}
    assert {(r.topic, r.row_id, r["rank"]) for r in top.collect()} == want
