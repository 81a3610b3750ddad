import random
import re

import numpy as np
import pytest

from themeloom.llm import ngram_join as nj
from themeloom.llm import queries
from themeloom.session import ship_package
from tests.conftest import SF0001

DOCS = "doc_id bigint, text string, n string, digest string, component_id string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width=4, percent=85):
    """Rows (doc_id, text) -> sorted (doc_id, set size, component)."""
    sets = [shingles(t, width) for _, t in rows]
    uf = nj.UnionFind(len(rows))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                uf.join(i, j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if uf.find(j) == uf.find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


def joined(spark, rows, **how):
    ship_package(spark)
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    out = nj.jaccard_components(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.QUERIES["op5_ngram_jaccard"](spark, SF0001).collect()], key=str)
    assert got == brute(rows)


def near_copies(seed, groups=6, copies=14, words=90):
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
            if rng.random() < .3:
                t = t[rng.randrange(3):]
            rows.append(" ".join(t))
    rows += [" ".join([*passage, *(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(12)))]) for _ in range(25)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_near_copies(spark, monkeypatch, small):
    if small:  # every group is dealt to many blocks
        monkeypatch.setattr(nj, "BLOCK", 3)
        monkeypatch.setattr(nj, "GROUP_SETS", 4)
    rows = near_copies(5)
    assert joined(spark, rows) == brute(rows)


def test_other_width_and_threshold(spark):
    rows = near_copies(6, groups=4, copies=10)
    assert joined(spark, rows, width=5, percent=80) == brute(rows, 5, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, "A B\nC D"), (8, "a b c d e"),
            (9, "a b c d"), (9, "a b c d"), (9, "z y x w v"), (None, "a b c d"), (None, "only here at all now"),
            (10, "é É"), (11, "É é"), (12, "k " * 3000), (13, "k " * 3000 + "j"), (14, "q " * 4), (14, None)]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_tree_links_span_the_join():
    rng = np.random.default_rng(2)
    order = nj.GramOrder(np.empty(0, np.uint64), np.empty(0, np.int64), 1.0)
    for _ in range(20):
        bases = [rng.integers(0, 400, rng.integers(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(40):
            b = bases[rng.integers(4)]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < .97], rng.integers(0, 400, 2)])).astype(np.uint64))
        side = rng.integers(0, 2, len(sets))
        for s in (None, side):
            want, got = nj.UnionFind(len(sets)), nj.UnionFind(len(sets))
            for i in range(len(sets)):
                for j in range(i):
                    n = len(np.intersect1d(sets[i], sets[j]))
                    if nj.reaches(n, len(sets[i]), len(sets[j]), 85) and (s is None or s[i] != s[j]):
                        want.join(i, j)
            for i, j in nj.tree_links(sets, order, 85, s):
                assert nj.reaches(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)
                got.join(i, j)
            assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 130, 300, 2100):
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < f], rng.integers(0, 1 << 62, int(n * .05)).astype(np.uint64)]))
                for f in rng.uniform(.85, 1, 12)]
        sets = [s for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets])
        hists = [nj.unpacked(nj.histogram(s), len(s)) for s in sets]
        assert all(h.sum() == k for h, k in zip(hists, sizes))
        uf = nj.UnionFind(len(sets))
        for i, j in nj.possible_links(sizes, hists, 85):
            uf.join(i, j)
        for i in range(len(sets)):
            for j in range(i):
                if nj.reaches(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], 85):
                    assert uf.find(i) == uf.find(j)


def test_components(spark):
    from themeloom.operators.components import star_components

    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(40)], *[(300, 300 + i) for i in range(30)]]
    got = dict(tuple(r) for r in star_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    uf = nj.UnionFind(400)
    for a, b in edges:
        uf.join(a, b)
    assert got == {n: uf.find(n) for e in edges for n in e}


def test_bounds_hold_below_half():
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 1 << 62, 1200).astype(np.uint64))
    sets = [base[:k] for k in (130, 200, 390, 400, 520, 700, 900, 1190, 60, 70, 100, 1000)]
    sizes = np.array([len(s) for s in sets])
    hists = [nj.unpacked(nj.histogram(s), len(s)) for s in sets]
    for percent in (10, 30, 34, 49, 50, 85):
        uf = nj.UnionFind(len(sets))
        for i, j in nj.possible_links(sizes, hists, percent):
            uf.join(i, j)
        for i in range(len(sets)):
            for j in range(i):
                if nj.reaches(min(sizes[i], sizes[j]), sizes[i], sizes[j], percent):
                    assert uf.find(i) == uf.find(j)


def test_many_rows_of_one_or_no_id(spark):
    ship_package(spark)
    texts = [" ".join(f"w{i // 2}x{j}" for j in range(30)) + (" end" if i % 2 else "") for i in range(4000)]
    rows = [(None, t) for t in texts] + [(7, t + " more") for t in texts[:1000]]
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    # groups of two rows without an id; those with a row of id 7 take its id
    assert sum(r.component_id == 7 for r in got) == 2000 and sum(r.component_id is None for r in got) == 3000
