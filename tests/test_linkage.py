"""Merging in rounds against the same merges one at a time."""
import numpy as np
import pytest

from themeloom.operators import linkage, topics


def plain_leaves(edges, m):
    """Kruskal, strongest edge first; the state of every cluster as in the definition."""
    comp, points = {}, {p for a, b, _ in edges for p in (a, b)}
    state = {p: ([p], 1 if m <= 1 else 0, []) for p in points}  # members in play, kind, leaves below
    comp = {p: p for p in points}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    sizes, leaves = {p: 1 for p in points}, []
    for _, a, b in sorted((-s, min(a, b), max(a, b)) for a, b, s in edges):
        a, b = find(a), find(b)
        if a == b:
            continue
        (ma, ka, _), (mb, kb, _) = state[a], state[b]
        comp[b] = a
        sizes[a] += sizes[b]
        if ka and kb:
            leaves += [x for x, k in ((ma, ka), (mb, kb)) if k == 1]
            state[a] = ([], 2, [])
        elif 2 in (ka, kb):
            state[a] = ([], 2, [])
        else:
            state[a] = (ma + mb, 1 if ka or kb or sizes[a] >= m else 0, [])
    leaves += [state[p][0] for p in points if find(p) == p and state[p][1] == 1]
    return {frozenset(x) for x in leaves}


def leaves(spark, edges, m):
    df = spark.createDataFrame([(int(a), int(b), float(s)) for a, b, s in edges], "src long, dst long, similarity double")
    out = {}
    for r in linkage.leaf_groups(df, m).collect():
        out.setdefault(r.leaf, []).append(r.id)
    assert sum(map(len, out.values())) == len({i for v in out.values() for i in v})
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed,n,m,levels,size", [(2, 40, 45, 1000, 3), (3, 60, 300, 6, 5)])
def test_leaves_against_one_merge_at_a_time(spark, seed, n, m, levels, size):
    rng = np.random.default_rng(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})
    edges = [(a, b, rng.integers(1, levels + 1) / levels) for a, b in pairs]
    assert leaves(spark, edges, size) == plain_leaves(edges, size)


def test_star_chain_and_bridges(spark):
    star = [(0, i, 0.5 + i / 100) for i in range(1, 30)]
    chain = [(100 + i, 101 + i, 0.9 - i / 100) for i in range(25)]
    bridge = [(5, 110, 0.6), (200, 201, 0.9), (201, 202, 0.9), (202, 5, 0.3)]
    edges = star + chain + bridge
    assert leaves(spark, edges, 4) == plain_leaves(edges, 4)


def test_no_edges(spark):
    assert leaves(spark, [], 3) == set()


def test_leaf_topics_undo_a_chain(spark):
    # two tight groups and a thread of points between them
    rng = np.random.default_rng(0)
    a, b = np.eye(8)[0], np.eye(8)[1]
    pts = [a + rng.normal(size=8) * 0.02 for _ in range(12)] + [b + rng.normal(size=8) * 0.02 for _ in range(12)]
    pts += [a * np.cos(t) + b * np.sin(t) for t in np.linspace(0.15, 1.42, 10)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(pts)] + [(90, None)], "row_id long, embedding array<double>")
    one = {r.row_id: r.topic for r in topics.density_clusters(df, 0.95, 5)[0].collect()}
    two = {r.row_id: r.topic for r in topics.density_clusters(df, 0.95, 5, select="leaves")[0].collect()}
    assert {one[i] for i in range(24)} == {0}
    assert {two[i] for i in range(12)} != {two[i] for i in range(12, 24)}
    assert {two[i] for i in range(12)} | {two[i] for i in range(12, 24)} == {0, 1} and one[90] == two[90] == -1


def plain_average(m, target):
    groups = {i: [i] for i in range(len(m))}
    sim, out = m @ m.T, []
    while len(groups) > max(target, 1):
        h, a, b = max((round(float(sim[np.ix_(groups[a], groups[b])].mean()), 10), -a, -b) for a in groups for b in groups if a < b)
        out.append((-a, -b))
        groups[-a] += groups.pop(-b)
    return {frozenset(g) for g in groups.values()}, out


@pytest.mark.parametrize("ship_bytes,targets", [(1 << 20, (1, 6)), (6 * 8 * 5, (9, 40))])
def test_average_linkage_against_one_merge_at_a_time(spark, ship_bytes, targets):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(23, 6))
    m[20:] = m[3]  # ties
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "g long, v array<double>")
    for target in targets:
        got = {}
        for r in linkage.merged_groups(df, target, ship_bytes).collect():
            got.setdefault(r.group, set()).add(r.g)
        assert {frozenset(v) for v in got.values()} == plain_average(m, target)[0]
        assert all(k == min(v) for k, v in got.items())


def test_reduce_topics_keeps_noise_and_topics_without_vectors(spark):
    rows = [(i, i % 3, [1.0, 0.1 * (i % 3), 0.0]) for i in range(9)] + [(20 + i, 3, [0.0, 0.0, 1.0]) for i in range(5)]
    rows += [(40, 7, None), (41, -1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, topic int, embedding array<double>")
    got = {r.old_topic: r.topic for r in topics.reduce_topics(df.select("row_id", "topic"), df.select("row_id", "embedding"), 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 7: 2, -1: -1}
