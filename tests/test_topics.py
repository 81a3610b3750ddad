"""Topic operators: planted clusters, probabilities, hulls, similarity joins."""
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.operators import similarity, topics


def planted(spark, n_per=20, noise=15, seed=3):
    rng = np.random.default_rng(seed)
    centers = np.eye(16)[:3]
    rows, rid = [], 0
    for c in centers:
        for _ in range(n_per):
            v = c + rng.normal(0, 0.05, 16)
            rows.append((rid, [float(x) for x in v])); rid += 1
    for _ in range(noise):
        v = rng.normal(0, 1, 16)
        rows.append((rid, [float(x) for x in v])); rid += 1
    return spark.createDataFrame(rows, "row_id long, embedding array<double>")


def test_density_clusters_find_planted_groups(spark):
    df = planted(spark)
    assign, edges = topics.density_clusters(df, 0.9, 10, block_rows=16)
    got = {r.row_id: r.topic for r in assign.collect()}
    for g in range(3):
        labels = {got[i] for i in range(g * 20, g * 20 + 20)}
        assert len(labels) == 1 and labels != {-1}
    assert len({got[i] for i in range(60)}) == 3
    sizes = assign.filter("topic != -1").groupBy("topic").count().collect()
    assert all(r["count"] >= 10 for r in sizes)
    # invariant to partitioning
    a2, _ = topics.density_clusters(df.repartition(5), 0.9, 10, block_rows=7)
    assert {r.row_id: r.topic for r in a2.collect()} == got
    p = topics.membership_probability(assign, edges).collect()
    assert all(0.0 <= r.probability <= 1.0 for r in p)
    assert any(r.probability == 1.0 for r in p if r.topic != -1)


def test_too_few_rows_all_noise(spark):
    df = planted(spark, n_per=3, noise=0)
    assign, _ = topics.density_clusters(df, 0.9, 10)
    assert {r.topic for r in assign.collect()} == {-1}


def test_top_n_similar_paths_agree(spark):
    df = planted(spark)
    q = df.filter(F.col("row_id") % 9 == 0).select(F.col("row_id").alias("query_id"), "embedding")
    a = similarity.top_n_similar(q, df, n=4)
    b = similarity.top_n_similar(q, df, n=4, block_rows=8)
    key = lambda r: (r.query_id, r["rank"])
    ra = {key(r): (r.row_id, round(r.similarity, 9)) for r in a.collect()}
    rb = {key(r): (r.row_id, round(r.similarity, 9)) for r in b.collect()}
    assert ra == rb and len(ra) == q.count() * 4


def test_convex_hull_ring(spark):
    rng = np.random.default_rng(0)
    pts = [("g", float(x), float(y)) for x, y in rng.uniform(-1, 1, (200, 2))] + [("h", 0.0, 0.0), ("h", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "grp string, x double, y double").repartition(4)
    hull = topics.convex_hulls(df, "grp").orderBy("grp", "order").collect()
    ring = [(r.x, r.y) for r in hull if r.grp == "g"]
    assert ring[0] == ring[-1] and len(ring) >= 4
    poly = np.array(ring[:-1])
    for _, x, y in pts[:200]:
        for i in range(len(poly)):
            a, b = poly[i], poly[(i + 1) % len(poly)]
            assert (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9
    assert len([r for r in hull if r.grp == "h"]) == 2


def test_ctfidf_weights(spark):
    docs = spark.createDataFrame([(0, "apple banana apple"), (1, "banana cherry"), (2, "apple cherry cherry")],
                                 "topic int, text string")
    c = topics.topic_term_counts(docs, ngram_range=(1, 1), min_df=1, max_df=1.0)
    w = {(r.topic, r.term): r.weight for r in topics.ctfidf(c).collect()}
    # A = floor(7 / 3) = 2; apple: f=3
    assert abs(w[(0, "apple")] - (2 / 3) * np.log(1 + 2 / 3)) < 1e-12


def test_top_n_similar_small_candidate_side(spark):
    df = planted(spark)
    cands = df.filter(F.col("row_id") % 13 == 0)
    a = similarity.top_n_similar(df.withColumnRenamed("row_id", "query_id"), cands, n=2)
    b = similarity.top_n_similar(df.withColumnRenamed("row_id", "query_id"), cands, n=2, block_rows=8)
    key = lambda r: (r.query_id, r["rank"])
    assert {key(r): r.row_id for r in a.collect()} == {key(r): r.row_id for r in b.collect()}


def test_keyword_refinement_t8_t9(spark):
    docs = spark.createDataFrame(
        [(i, i % 2, t) for i, t in enumerate([
            "apple banana cherry apple", "dog cat mouse dog", "apple cherry grape", "cat mouse horse",
            "banana grape apple", "dog horse cat", "apple banana grape cherry", "mouse dog cat horse"])],
        "row_id long, topic int, text string")
    w = topics.ctfidf(topics.topic_term_counts(docs, ngram_range=(1, 1), min_df=1, max_df=1.0))
    reps = topics.representative_docs(docs, w, 2, ngram_range=(1, 1))
    t8 = topics.similarity_keywords(w, reps, docs, n=3, n_candidates=5).collect()
    assert {r.topic for r in t8} == {0, 1} and all(r["rank"] <= 3 for r in t8)
    t9 = topics.diverse_keywords(w, reps, docs, n=3, diversity=0.3, n_candidates=5).collect()
    by_topic = {}
    for r in t9:
        by_topic.setdefault(r.topic, []).append(r.term)
    assert all(len(v) == len(set(v)) <= 3 for v in by_topic.values())


def test_probability_vectors_with_one_topic(spark):
    df = planted(spark, n_per=12, noise=4).filter("row_id < 12 or row_id >= 36")
    assign, edges = topics.density_clusters(df, 0.9, 10)
    assert {r.topic for r in assign.collect()} == {0, -1}
    got = {r.row_id: r.probabilities for r in topics.probability_vectors(assign, edges).collect()}
    assert all(len(v) == 1 for v in got.values()) and max(v[0] for v in got.values()) == 1.0


def test_terms_in_small_parts_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(topics, "TASK_WORDS", 5)
    rows = [(1, 0, "Red red fish and the blue fish"), (2, 0, "blue fish"), (3, 1, "red fish swims"), (4, None, "x blue"),
            (5, 1, None), (6, 2, ""), (7, 1, "red fish red fish"), (7, 1, "red fish"), (8, 2, "fish and red")]
    docs = spark.createDataFrame(rows, "row_id long, topic int, text string").coalesce(1)
    want = {}
    for _, topic, text in rows:
        w = [x for x in (text or "").lower().split() if x not in ("and", "the", "x")]
        for term in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            want[topic, term] = want.get((topic, term), 0) + 1
    n = {t: len({k for k, u in want if u == t}) for t in {u for _, u in want}}
    counts = topics.topic_term_counts(docs, min_df=2, max_df=0.7)
    assert {(r.topic, r.term): r.tf for r in counts.collect()} == {k: v for k, v in want.items() if 2 <= n[k[1]] <= 2.8}
    assert all(r.f == sum(v for (_, t), v in want.items() if t == r.term) for r in counts.collect())
    weights = topics.ctfidf(counts)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    # shipped terms change the work, not the result; the rows of a repeated id are one document
    every = [tuple(r) for r in topics.representative_docs(docs, weights, 9).orderBy("topic", "rank").collect()]
    monkeypatch.setattr(topics, "SHIPPED_TERMS", 0)
    assert every == [tuple(r) for r in topics.representative_docs(docs, weights, 9).orderBy("topic", "rank").collect()]
    assert len([r for r in every if r[1] == 7]) == 1


def test_terms_without_a_weight_do_not_leave_the_task(spark):
    words = pa.array([["red", "fish", "swims", "far"], [], None, ["Ärger", "red", "red", "fish"]], pa.list_(pa.string()))
    for terms in topics._terms_of(words, (1, 3), pa.array([], pa.string())):
        _, head, last, _ = terms.counts(np.arange(4))
        assert (topics._hash_of(terms.texts(head, last)) == terms.hashes(head, last)).all()
    rows = [(i, i % 3, f"red fish only{i} here{i} grow{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, topic int, text string").coalesce(2)
    weights = spark.createDataFrame([(t, w) for t in range(3) for w in ("red", "red fish", "fish only7")], "topic int, term string")
    found = topics._term_filter(weights, 9)
    hashes = topics._hash_of(pa.array(["red", "red fish", "fish only7"]))
    assert topics._may_be_in(found, hashes).all() and found[0] <= 16
    held = topics._term_counts(topics._words(docs, "text", ["id", "topic"]), ["id", "topic"], True, (1, 2), None, spark.sparkContext.broadcast(found), 4)
    moved = topics._unblocked([pa.RecordBatch.from_pylist([{"data": bytes(r["data"])} for r in held.collect()])]).to_pylist()
    assert sum(r["term"] in ("red", "red fish", "fish only7") for r in moved) == 601
    assert len(moved) < 601 + 300 * 7 / 3  # of 2,700 terms of documents


def test_terms_move_as_blocks_and_all_rows_of_a_term_meet(spark):
    rows = [(i % 3, f"Red_fish {i % 5} Ärger über the ÄRGER x1 red {'blue' if i % 2 else 'grün'} fish\tred\x00fish") for i in range(40)]
    docs = spark.createDataFrame([*rows, (1, "plain ASCII a b red fish"), (None, "red fish"), (2, None), (0, "")], "topic int, text string")
    want = {}
    for topic, text in [*rows, (1, "plain ASCII a b red fish"), (None, "red fish")]:
        w = [x for x in re.findall(r"\w{2,}", text.lower()) if x != "the"]
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                want[topic, " ".join(w[i:i + n])] = want.get((topic, " ".join(w[i:i + n])), 0) + 1
    words = topics._words(docs.coalesce(2), "text", ["topic"])
    blocks = topics._term_counts(words, ["topic"], False, (1, 3), None, buckets=4).collect()
    assert len(blocks) <= 2 * 3 * 4  # tasks, lengths of terms, buckets: not a row per term
    places, found = {}, {}
    for b in blocks:
        for r in pa.ipc.open_stream(b.data).read_all().to_pylist():
            places.setdefault(r["term"], set()).add(b.bucket)
            found[r["topic"], r["term"]] = found.get((r["topic"], r["term"]), 0) + r["n"]
    assert found == want and all(len(x) == 1 for x in places.values()) and len(set.union(*places.values())) > 1
    plain = topics._term_counts(words, ["topic"], False, (1, 3), None).groupBy("topic", "term").agg(F.sum("n").alias("n"))
    assert {(r.topic, r.term): r.n for r in plain.collect()} == want


def test_vocabulary_is_the_same_from_one_task_or_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 4, f"red fish w{i % 7} w{i % 3} blue {i}") for i in range(30)], "topic int, text string")
    one = sorted(tuple(r) for r in topics.topic_term_counts(docs, ngram_range=(1, 3)).collect())
    monkeypatch.setattr(topics, "MEETING_BYTES", 100)
    assert one and one == sorted(tuple(r) for r in topics.topic_term_counts(docs, ngram_range=(1, 3)).collect())


def test_counts_do_not_move_to_a_task_per_topic(spark):
    docs = spark.createDataFrame([(i % 3, f"red fish w{i % 7} blue {i}") for i in range(60)], "topic int, text string")
    plan = topics.ctfidf(topics.topic_term_counts(docs))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(topic" not in plan and "BroadcastHashJoin" in plan


def test_vocabulary_of_texts_of_a_known_size(spark):
    rows = [(i % 3 or None, f"red fish w{i % 7} blue {i}") for i in range(60)] + [(4, None), (4, "")]
    docs = spark.createDataFrame(rows, "topic int, text string")
    every = sorted(map(str, topics.topic_term_counts(docs).collect()))
    assert every and all(sorted(map(str, topics.topic_term_counts(docs, size=x).collect())) == every for x in (0, 100, 1 << 25))


def test_only_leading_terms_are_sorted(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), f"w{i}", float(x)) for i, (t, x) in enumerate(zip(rng.integers(0, 3, 3000), rng.lognormal(0, 4, 3000)))]
    odd = [(7, f"o{i}", x) for i, x in enumerate([None, float("nan"), float("inf"), 0.0, -1.0, -2.0, 5e-324, 1.0, 1.0, 1.0, None])]
    same = [(None, f"s{i}", 0.25) for i in range(40)]
    weights = spark.createDataFrame([*rows, *odd, *same, (8, "only", None)], "topic int, term string, weight double")
    assert topics._leading_terms(weights.filter("topic < 3"), 10).count() < 200
    for n in (1, 4, 8, 50):
        weights.createOrReplaceTempView("some_weights")
        want = spark.sql(f"select * from (select *, row_number() over (partition by topic order by weight desc, term) as rank "
                         f"from some_weights) where rank <= {n}").select("topic", "term", "rank").collect()
        got = topics.top_keywords(weights, n).select("topic", "term", "rank").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_representative_docs_weigh_terms_by_count_and_idf(spark):
    texts = ["apple apple banana", "banana cherry", "apple cherry cherry", "dog dog cat", "cat mouse apple"]
    docs = spark.createDataFrame([(i, int(i > 2), t) for i, t in enumerate(texts)], "row_id long, topic int, text string")
    w = topics.ctfidf(topics.topic_term_counts(docs, ngram_range=(1, 1), min_df=1, max_df=1.0))
    weight = {(r.topic, r.term): r.weight for r in w.collect()}
    idf = {r.term: r.idf for r in w.collect()}
    want = {}
    for i, t in enumerate(texts):
        v = {x: t.split().count(x) * idf[x] for x in t.split()}
        topic = {x: k for (g, x), k in weight.items() if g == int(i > 2)}
        dot = sum(v[x] * topic[x] for x in v)
        want[i] = dot / np.sqrt(sum(x * x for x in v.values())) / np.sqrt(sum(x * x for x in topic.values()))
    got = {r.row_id: r.similarity for r in topics.representative_docs(docs, w, 3, ngram_range=(1, 1)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_jitter_belongs_to_the_row(spark):
    from themeloom.functions import vectors as vx

    df = spark.range(500).withColumn("x", F.lit(0.0))
    draw = lambda d: {r.id: (r.a, r.b) for r in d.select(
        "id", vx.gaussian_jitter("x", 1.0, 7, "id").alias("a"), vx.uniform_offset("x", 2.0, 3, "id").alias("b")).collect()}
    one, other = draw(df.repartition(3)), draw(df.repartition(7, "id"))
    assert one == other
    a, b = np.array(list(one.values())).T
    assert abs(a.mean()) < .2 and .85 < a.std() < 1.15 and abs(b).max() <= 1 and abs(b.mean()) < .15


def test_components_of_a_long_chain(spark):
    from themeloom.operators.components import connected_components

    nodes = spark.range(400).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(299)], "src long, dst long")
    got = {r.id: r.label for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(400)}


def test_summaries_keep_documents_whole(spark, tmp_path):
    from themeloom.operators import responses
    from themeloom.sources import io

    docs = spark.createDataFrame([(1, 0, 1.0, 'First "line.\nStill first. Second.'), (2, 0, .5, "b\nc"), (3, -1, .9, "noise")],
                                 "row_id long, topic int, probability double, text string")
    kw = spark.createDataFrame([(0, "k", 1), (0, "l", 2)], "topic int, term string, rank long")
    done = responses.complete(responses.summary_requests(docs, kw, 5))
    path = str(tmp_path / "summaries.json")
    io.write_table(responses.summary_records(done), path)
    row, = responses.flatten_summaries(io.read_table(spark, path)).collect()
    assert row.representative_docs == ['First "line.\nStill first. Second.', "b\nc"]
    assert (row.topic, row.topic_name, row.topic_description) == (0, "k l", 'First "line.')


def test_python_operators_run_from_another_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from themeloom.session import build_session
from themeloom.operators import embed
s = build_session("local[2]", 2)
print("ROWS", embed.embed(s.createDataFrame([("a b",), ("c",)], "t string"), "t", dim=16).collect()[0].embedding is not None)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "ROWS True" in out.stdout, out.stderr[-2000:]


def skewed(spark, n=1200, dim=24, seed=5):
    """Tight groups of very different size, copies, a zero and a null vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 1.5
    pick = np.minimum(rng.geometric(0.3, n) - 1, 11)
    pts = centres[pick] + rng.normal(size=(n, dim)) * 0.1
    pts[:60] = pts[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(pts)] + [(n, [0.0] * dim), (n + 1, None)]
    unit = pts / np.linalg.norm(pts, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(5), unit


@pytest.mark.parametrize("threshold", [0.999, 0.9, 0.2, -0.1])
def test_pruned_edges_equal_all_pairs(spark, threshold):
    df, unit = skewed(spark, 400)
    got = {(r.src, r.dst): r.similarity for r in similarity.similarity_edges(df, threshold, block_rows=32, n_pivots=10).collect()}
    unit = np.vstack([unit, np.zeros((1, unit.shape[1]))])
    sims = np.triu(unit @ unit.T, 1) + np.tril(np.full((401, 401), -9.0))
    clear = {(int(i), int(j)) for i, j in zip(*np.nonzero(sims >= threshold + 1e-9))}
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(sims >= threshold - 1e-9))}
    assert clear <= set(got) <= near
    assert all(abs(s - sims[p]) < 1e-9 for p, s in got.items())


def test_pruning_leaves_less_than_a_third_of_the_products(spark):
    df, _ = skewed(spark)
    blocks, pairs = similarity.candidate_blocks(df, 0.9, block_rows=32)
    n = blocks.count()
    assert n >= 38 and pairs.count() * 3 < n * (n + 1) / 2
    assert blocks.selectExpr("sum(size(ids))").first()[0] == 1200


def test_single_precision_vectors_move_as_such_to_few_groups(spark):
    df, unit = skewed(spark)
    kept = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    blocks, _, _ = similarity._vector_blocks(kept, 0.5, "row_id", "embedding", 8, 64)
    met, groups = similarity._group_pairs(blocks)
    assert groups <= np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism))
    assert met.selectExpr("sum(length(data))").first()[0] == groups * 1200 * unit.shape[1] * 4
    found = lambda d: sorted(tuple(r) for r in similarity.similarity_edges(d, 0.5, block_rows=32).collect())
    got, want = found(kept), found(kept.withColumn("embedding", F.col("embedding").cast("array<double>")))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-14)


def plain_forest(edges):
    root, kept = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, a, b in sorted((-s, a, b) for a, b, s in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            kept.append((a, b, -s))
    return kept


def test_local_forest_equals_kruskal():
    rng = np.random.default_rng(2)
    for n, m in ((2, 1), (6, 9), (40, 200), (30, 20), (50, 1225)):
        x, y = rng.integers(0, n, (2, m))
        x, y = x[x != y], y[x != y]
        s = rng.integers(0, 5, len(x)) / 4
        at = similarity.local_forest(x, y, s, n)
        assert sorted(s[at]) == sorted(e[2] for e in plain_forest(zip(x.tolist(), y.tolist(), s.tolist())))
        parts = plain_forest(zip(x[at].tolist(), y[at].tolist(), s[at].tolist()))
        assert len(parts) == len(at)


def test_forest_keeps_components_and_best_similarities(spark):
    df, _ = skewed(spark, 300)
    every = [(r.src, r.dst, r.similarity) for r in similarity.similarity_edges(df, 0.5, block_rows=40).collect()]
    few = [(r.src, r.dst, r.similarity) for r in similarity.similarity_edges(df, 0.5, block_rows=40, forest=True).collect()]
    assert set((a, b) for a, b, _ in few) < set((a, b) for a, b, _ in every) and len(few) < len(every) / 3
    want, got = plain_forest(every), plain_forest(few)
    assert np.allclose(sorted(e[2] for e in want), sorted(e[2] for e in got))

    def best(edges):
        out = {}
        for a, b, s in edges:
            for x in (a, b):
                out[x] = max(out.get(x, -1), round(s, 9))
        return out

    assert best(every) == best(few)


def test_a_vector_and_its_edges_move_once_per_group_not_once_per_block(spark, monkeypatch):
    monkeypatch.setattr(similarity._Forest, "ROOM", 500)  # the forest is brought up to date often
    df, unit = skewed(spark)
    blocks, _, _ = similarity._vector_blocks(df, 0.2, "row_id", "embedding", 8, 64)
    met, groups = similarity._group_pairs(blocks)
    assert groups < blocks.count() / 5 and met.count() == groups * blocks.count()
    few = [(r.src, r.dst, r.similarity) for r in similarity.similarity_edges(df, 0.2, block_rows=8, forest=True).collect()]
    assert len(few) < (groups + 1) * 1200
    sims = unit @ unit.T
    i, j = np.nonzero(np.triu(sims >= 0.2, 1))
    kept = similarity.local_forest(i, j, sims[i, j], 1200)
    want = sorted(sims[i, j][kept])
    got = sorted(e[2] for e in plain_forest(few))
    assert len(got) == len(want) and np.allclose(want, got)


@pytest.mark.parametrize("ship", ["queries", "candidates"])
@pytest.mark.parametrize("ship_bytes", [1 << 25, 24 * 8 * 7])
def test_top_n_against_all_pairs(spark, ship, ship_bytes):
    df, unit = skewed(spark, 300)
    q = df.filter("row_id % 7 = 0").select(F.col("row_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): (r.row_id, r.similarity)
           for r in similarity.top_n_similar(q, df, n=4, block_rows=50, ship=ship, ship_bytes=ship_bytes).collect()}
    unit = np.vstack([unit, np.zeros((1, unit.shape[1]))])
    sims = np.round(unit @ unit.T, 12)
    for i in range(0, 301, 7):
        order = sorted(range(301), key=lambda j: (-sims[i, j], j))[:4]
        for k, j in enumerate(order):
            assert got.pop((i, k + 1)) == (j, pytest.approx(sims[i, j], abs=1e-9))
    assert not got


def test_top_n_plan_has_no_cartesian_product(spark):
    docs = spark.range(2_000_000).select(F.col("id").alias("row_id"), F.array(*[F.rand(i) for i in range(3)]).alias("embedding"))
    cents = spark.createDataFrame([(t, [1.0, float(t), 0.0]) for t in range(4)], "topic int, centroid array<double>")
    plan = topics.nearest_centroid(docs, cents)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("MapInPandas") == 1


def test_top_n_of_empty_sides(spark):
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "row_id long, embedding array<double>")
    assert similarity.top_n_similar(none, some).collect() == []
    assert similarity.top_n_similar(some.withColumnRenamed("row_id", "query_id"), none.withColumnRenamed("query_id", "row_id")).collect() == []
    assert similarity.similarity_edges(none.withColumnRenamed("query_id", "row_id"), 0.5).collect() == []


def test_a_saved_model_is_applied_as_the_fitted_one(spark, tmp_path):
    df, _ = skewed(spark, 200)
    red, model = topics.reduce_dimensions(df.filter("embedding is not null"), 5)
    red = red.withColumn("topic", (F.col("row_id") % 4).cast("int"))
    cents = topics.centroids(red, "topic", "reduced")
    names = spark.createDataFrame([(t, "x") for t in range(4)], "topic int, Name string")
    topics.save_topic_model(str(tmp_path / "m"), names, names, cents, topics.component_table(spark, model))
    direct = topics.nearest_centroid(red.select("row_id", "reduced"), cents, 0.1, vec="reduced")
    back = topics.apply_topic_model(topics.load_topic_model(spark, str(tmp_path / "m")), df, 0.1)
    got = {r.row_id: (r.topic, round(r.similarity, 8)) for r in back.collect()}
    assert got == {r.row_id: (r.topic, round(r.similarity, 8)) for r in direct.collect()} and len(got) == 201
