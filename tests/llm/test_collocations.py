"""Phrase mining against a plain count of all grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import collocations as co
from themeloom.session import ship_package


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, percent, limit):
    f = defaultdict(Counter)
    for lang, text in docs:
        for w in pieces_of(text):
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cands = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cands.items():
            if any(len(h) > len(g) and 100 * b >= percent * a and g in (h[:2], h[1:]) for h, b in cands.items()):
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:limit])]
    return sorted(out)


def mined(spark, docs, least, limit, parts=3, **how):
    ship_package(spark)
    frame = spark.createDataFrame([(*d, 1, "w", 2) for d in docs], "lang string, text string, n int, w1 string, id int").repartition(parts)
    return sorted(map(tuple, co.collocations(frame, least, 50, limit, **how).collect()))


def corpus(rows, seed=5):
    r = random.Random(seed)
    words = ["the", "of", "a", "new", "york", "city", "hall", "é", "日本", "x-y", "zu", "Ende"]
    out = []
    for i in range(rows):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(r.randrange(0, 40)))
        out.append((r.choice(["en", "en", "en", "de", None, ""]), text + ("New York City Hall of" if i % 3 == 0 else "")))
    return out


ODD = [("en", None), (None, None), ("en", ""), ("en", " \t "), ("de", "..,;"), ("de", "one"), ("de", "one. one. one"), ("fr", "a a a a a a a"),
       ("it", "a b a b a b a b"), ("it", "p q r p q r p q r p q r"), ("xx", "A\x0bB\x0cC\rD"), ("xx", "A\x1cB C\x85D E\xa0F"), ("en", "\x00 \x00 \x00 \x00")]


@pytest.mark.parametrize("how", [{}, {"buckets": 7, "hot": 2}, {"buckets": 3, "hot": 0, "room": 50}, {"buckets": 1, "hot": 1, "room": 1}])
def test_rows_nulls_ties_and_hot_nodes(spark, how):
    docs = corpus(120) + ODD * 3
    assert mined(spark, docs, 3, 25, **how) == brute(docs, 3, 50, 25)


def test_one_long_text_and_one_hot_pair(spark):
    long = ("en", " ".join(f"of the w{i % 700}" for i in range(6000)))
    docs = [long, *[("en", f"of the w{i}") for i in range(300)], ("en", "same line here\n" * 50)]
    assert mined(spark, docs, 5, 50, hot=100, room=1000) == brute(docs, 5, 50, 50)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_words_in_slices():
    text = b"The cat, sat\tON. a " + b"x" * 50 + b" end"
    whole = [w for part in co.piece_words(text) for w in part]
    for size in (1, 3, 8, 30):
        assert [w for part in co.piece_words(text, size) for w in part] == whole
    assert whole[:6] == [b"the", b"cat", b"\xff", b"sat", b"on", b"\xff"]


def test_distinct_rows_of_large_numbers():
    rng = np.random.default_rng(1)
    x, y, z = (rng.integers(0, 4, 300) for _ in range(3))
    n = rng.integers(1, 9, 300)
    small = co.distinct_rows(x, y, z, n, 4)
    large = co.distinct_rows(x * 3_000_000, y * 3_000_000, z * 3_000_000, n, 10_000_000)
    assert all((a * s == b).all() for a, b, s in zip(small, large, (3_000_000, 3_000_000, 3_000_000, 1)))


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10, 10, 10), (10**12, 10**12 + 7, 3 * 10**12 + 1), (999_999_999_989, 10**15 + 3, 10**13 + 9), (7, 3 * 10**9, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(co.floor_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_paths(spark):
    # a chain that branches at (c d), a cycle, a loop of one edge
    grams = ["a b c", "b c d", "c d e", "c d f", "d e g", "e g h", "m n m", "n m n", "z z z", "p q r", "q r p", "r p q"]
    edges = spark.createDataFrame([("en", *g.split(), 5, i) for i, g in enumerate(grams)], "lang string, w1 string, w2 string, w3 string, n long, id long")
    got = {r.id: (r.path, r.pos) for r in co.unary_paths(edges).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 4: (2, 1), 5: (2, 2), 3: (3, 0), 6: (6, 0), 7: (6, 1), 8: (8, 0),
                   9: (9, 0), 10: (9, 1), 11: (9, 2)}


def test_a_long_path_and_a_long_cycle(spark):
    chain = [("en", f"w{i}", f"w{i + 1}", f"w{i + 2}", 5, i) for i in range(70)]
    ring = [("de", f"r{i}", f"r{(i + 1) % 21}", f"r{(i + 2) % 21}", 5, 1000 - i) for i in range(21)]
    edges = spark.createDataFrame(chain + ring, "lang string, w1 string, w2 string, w3 string, n long, id long")
    got = {r.id: (r.path, r.pos) for r in co.unary_paths(edges).collect()}
    assert all(got[i] == (0, i) for i in range(70))
    assert all(got[1000 - i] == (980, (i + 1) % 21) for i in range(21))
