import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF0001
from tests.llm.test_ngram_join import brute
from themeloom.llm import mixing, quality_rules, queries
from themeloom.llm.common import stage
from themeloom.llm.textstats import text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of each stage, with those of ``documents`` first."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF0001), name)
        out.append((docs.columns, docs.collect()))
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_all_but_the_last_keep_the_columns(stages):
    assert [c for c, _ in stages[:5]] == [COLUMNS] * 5 and len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, stages):
    before, after = by_id(stages[0][1]), by_id(stages[1][1])
    counts = text_counts(spark.read.parquet(f"{SF0001}/documents.parquet"))
    model = quality_rules.fit_rules(counts, spark.read.parquet(f"{SF0001}/labels.parquet"))
    assert after.keys() == {r.doc_id for r in quality_rules.judge(counts, model).filter("kept").collect()}
    assert after == {i: before[i] for i in after} and len(after) < len(before)


def test_line_stage(stages):
    rows, after = stages[1][1], by_id(stages[2][1])
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).encode().lower()
    seen = Counter(k for r in rows for k in {key(x) for x in r.text.split("\n")} if k)
    assert len(after) == len(rows)
    for r in rows:
        kept = "\n".join(x for x in r.text.split("\n") if not key(x) or seen[key(x)] < 10)
        assert after[r.doc_id].text == kept
        assert (after[r.doc_id].lang, after[r.doc_id].source) == (r.lang, r.source)


def test_near_duplicate_stage(stages):
    rows, after = stages[2][1], stages[3][1]
    component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80)}
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))
    assert all(by_id(rows)[r.doc_id] == r for r in after)


def test_mixing_stage(spark, stages):
    rows, after = stages[3][1], Counter(r.doc_id for r in stages[4][1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sized = mixing.sized(df)
    want = {r.doc_id: r["__copies"] for r in mixing.mixed(sized, mixing.mixing_plan(sized)).collect() if r["__copies"]}
    assert after == want and max(after.values()) <= 2
    assert all(by_id(rows)[r.doc_id] == r for r in stages[4][1])


def test_packing_stage(stages):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    rows, pieces = stages[4][1], stages[5][1]
    want = Counter()
    for r in rows:
        want.update(tok.encode(r.text, add_special_tokens=False).ids + [2])
    got, sequences = Counter(), {}
    for p in pieces:
        got.update(np.frombuffer(bytes(p.ids), "<u4").tolist())
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= 4096 and total & (total - 1) == 0


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset)
    assert sorted(map(key, corpus_pipeline.run(spark, SF0001).collect()), key=str) == sorted(map(key, stages[5][1]), key=str)


def test_odd_documents_pass_all_stages(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, long, None, None, 5), (None, long, "en", "a", 5), (2, "", "en", "", 0),
            (2, long + " more", "en", "b", 1), (3, " ".join(f"z{i}" for i in range(60)), "en", None, 2)]
    extra = "n_words int, kept string, score double, component_id bigint, size bigint, line string"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra
    docs = spark.createDataFrame([(*r, 1, "x", .5, 7, 8, "y") for r in rows], schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, step in corpus_pipeline.STAGES:
            columns = now.columns
            now = stage(step(spark, now, SF0001), name)
            if name != "retrieval_packing":
                assert now.columns == columns
        assert now.count() == 0 if empty else now.count() > 0
