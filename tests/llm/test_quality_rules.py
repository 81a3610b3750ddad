import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF0001
from themeloom.llm import quality_rules as qr
from themeloom.llm import queries
from themeloom.llm.textstats import COUNTS, counts_of, repeat_words, text_counts
from themeloom.session import ship_package

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, unusual string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_base_columns_match_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality_rules"](spark, SF0001).collect()}
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_of(d.text)
        assert not (r.base_failed and r.kept)


def test_labelled_junk_goes_and_good_stays(spark):
    got = queries.QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").distinct()
    share = {r.quality: r.kept for r in got.filter("not base_failed").join(labels, "doc_id").groupBy("quality")
             .agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.05


def test_odd_texts(spark):
    odd = ["", " \t\n\x0b\x0c\r ", "a b  c", "\n\n", "a b c a b c a", "a a a a", "é\U0001f600 <x>\n<x>\né\U0001f600 <x>",
           "x\n x\nx", "x " * 5000]
    for t in odd:
        c = dict(zip(COUNTS, counts_of(t.encode())))
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == base_of(t)[:5], t
    assert repeat_words([]) == 0


def stage_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], DOCS)


def test_filter_agrees_with_judgement_and_keeps_columns(spark):
    ship_package(spark)
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60 + i))) for i in range(40)]
    junk = [(100 + i, " ".join(f"q{i}y{j}***" for j in range(60))) for i in range(6)]
    rows = good + junk + [(None, None), (None, good[0][1]), (7, good[7][1]), (200, ""), (201, "z " * 400)]
    docs = stage_rows(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0), (101, 0, 0), (102, 0, 0), (None, 1, None), (5, None, 1)],
                                   "doc_id bigint, quality int, toxic int")
    out = qr.keep_passing(docs, labels)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    assert kept == sorted([*range(40), 7, None], key=str)
    model = qr.fit_rules(text_counts(docs), labels)
    judged = sorted((r.doc_id for r in qr.judge(text_counts(docs), model).filter("kept").collect()), key=str)
    assert judged == kept


def test_empty_tables_and_no_labels(spark):
    ship_package(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert qr.keep_passing(stage_rows(spark, []), labels).count() == 0
    # without labels only the base rules reject
    rows = [(1, "a b c"), (2, " ".join(map(str, range(80)))), (3, " ".join(f"{i}***" for i in range(80)))]
    assert sorted(r.doc_id for r in qr.keep_passing(stage_rows(spark, rows), labels).collect()) == [2, 3]


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.zeros((500, len(qr.FEATURES)))
    rows[:, 0] = rng.normal(0, 1, 500)
    rows[:3, 0] = 30, 40, -35
    s = qr.Forest([0]).grow(rows, 50, np.random.default_rng(1)).scores(rows)
    assert s[:3].min() > np.sort(s[3:])[-3]
