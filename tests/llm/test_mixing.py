import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from themeloom.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string, target string, range string, n string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def key_of(doc_id, text, seed="mix"):
    text = text or ""
    named = f"{seed}\n{'' if doc_id is None else doc_id}\n{text}"
    u = (int(hashlib.md5(named.encode()).hexdigest()[:13], 16) + .5) / 2 ** 52
    symbols = sum(c in "#*$%&|<>" for c in text)
    return -math.log(u) / (1 / (1 + 20 * symbols / max(1, words(text))))


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not above:
            return fixed | {s: left * w[s] / total for s in open_}
        for s in above:
            fixed[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


def brute(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target, out = water_fill(sizes), []
    for s in sizes:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: key_of(r[0], r[1]))
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, done = target[s] - epochs * sizes[s], 0
        for i, t, _ in mine:
            n = words(t)
            more = rest > 0 and done + n / 2 <= rest
            done += n
            out.append((i, n, sizes[s], round(target[s], 6), n * (epochs + more)))
    return sorted(out, key=str)


def mixed(spark, rows):
    df = mixing.sized(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS))
    out = mixing.mixed(df, mixing.mixing_plan(df))
    return sorted([(r.doc_id, r["__size"], r["__source_size"], round(r["__target"], 6), r["__size"] * r["__copies"])
                   for r in out.collect()], key=str)


def corpus(n=200):
    names = ["a", "B", "é", "\U0001f600", "￿", "", None, "zz"]
    return [(i, " ".join(f"w{i}x{j}" + "*" * (i % 3 * (j % 2)) for j in range(1 + i * 7 % 40)) + "\n" * (i % 4),
             names[min(7, i % 17)]) for i in range(n)]


@pytest.mark.parametrize("rows_in_range", [4096, 5])
def test_matches_brute_force(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_in_range)
    rows = corpus() + [(900, None, "a"), (901, "", None), (902, " \t\n", "only blanks"), (903, "x " * 4000, "one long"), (None, "n n", "a"),
                       (None, "m m m", "a"), (5, "same id, other text", "a")]
    got = mixed(spark, rows)
    assert got == brute(rows) and got == mixed(spark, list(reversed(rows)))


def test_targets_are_met(spark):
    rows = corpus(600)
    taken, target, largest = Counter(), {}, Counter()
    for (i, n, size, t, k), source in zip(sorted(mixed(spark, rows), key=lambda r: r[0]), [r[2] for r in rows]):
        taken[source] += k
        target[source] = t
        largest[source] = max(largest[source], n)
        assert k <= 2 * n
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "s")] * 5 + [(2, "d e", "s")] * 3 + [(3, "f", "t")]
    got = mixed(spark, rows)
    assert len(got) == 9 and all(k <= 2 * n for _, n, _, _, k in got)
    assert mixed(spark, []) == []
    assert all(r[1:] == (0, 0, 0.0, 0) for r in mixed(spark, [(1, None, "s"), (2, "", None)]))


def test_documents_are_repeated_whole(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({i: k // n for i, n, _, _, k in brute(rows) if k})


@pytest.mark.parametrize("weight", [1.0, 1 / 21, 1 / 400])
def test_ranges_are_even_for_any_weight(spark, weight):
    rows = spark.range(40_000).select((-F.log((F.col("id") + 0.5) / 40_000) / weight).alias("key"))
    bins = rows.withColumn("bin", mixing._bin_of(F.col("key")))
    n = bins.groupBy("bin").count()
    parts = (bins.join(n, "bin").withColumn("part", mixing._part_of(F.col("key"), F.col("bin"), F.ceil(F.col("count") / 50)))
             .groupBy("bin", "part").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
             .orderBy("bin", "part").collect())
    assert max(r.n for r in parts) <= 100
    assert all(a.high < b.low for a, b in zip(parts, parts[1:]))
