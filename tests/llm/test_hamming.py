import numpy as np
import pytest

from themeloom.llm import hamming

ROWS = "vec_id bigint, embedding array<float>, distance string, ids string, code string"


def code(v):
    return [int(x is not None and x == x and x >= 0) for x in v]


def brute(vectors, queries, k):
    dims = max((len(v) for _, v in vectors if v is not None), default=0)
    usable = {(i, tuple(code(v))) for i, v in vectors if i is not None and v and len(v) == dims}
    out = []
    for q, c in {(i, tuple(code(v))) for i, v in queries if i is not None and v and len(v) == dims}:
        near = sorted((sum(a != b for a, b in zip(c, d)), i) for i, d in usable)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def run(spark, vectors, queries, k, segments):
    df = lambda rows: spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROWS)
    out = hamming.hamming_top_k(df(vectors), df(queries), k, segments)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("dims,segments,k", [(16, 4, 5), (13, 3, 3)])
def test_matches_brute_force(spark, dims, segments, k):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims))
    vectors = [(i, (centres[i % 6] + rng.normal(size=dims) * (i % 3) * .6).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[0][1]) for i in range(20)]  # more copies than k
    queries = [v for v in vectors if v[0] % 20 == 0]
    assert run(spark, vectors, queries, k, segments) == brute(vectors, queries, k)


def test_odd_rows(spark):
    nan = float("nan")
    vectors = [(1, [1.0, -1.0, 0.0, nan]), (1, [1.0, -1.0, 0.0, nan]), (2, None), (3, []), (4, [1.0]), (None, [1.0] * 4),
               (5, [None, 1.0, 1.0, 1.0]), (6, [-1.0] * 4)]
    assert run(spark, vectors, vectors, 10, 2) == brute(vectors, vectors, 10)
    assert run(spark, [], [], 3, 2) == []
    assert run(spark, vectors, [], 3, 2) == []
    assert run(spark, [], vectors, 3, 2) == []
