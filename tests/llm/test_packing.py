import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF0001
from themeloom.llm import packing, queries
from themeloom.session import ship_package

DOCS = "doc_id bigint, text string, start string, length string, ids string"


def test_query_holds_every_id_once(spark):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    want = {i: e.ids + [2] for i, e in zip(docs, tok.encode_batch(list(docs.values()), add_special_tokens=False))}
    rows = queries.QUERIES["op8_retrieval_packing"](spark, SF0001).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    check_sequences(by_seq, 4096)


def check_sequences(by_seq, window):
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0  # no padding at all


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_odd_rows(spark, shard_bytes):
    ship_package(spark)
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (None, "x y"), (4, "long word " * 3000),
            (5, "a b c"), (6, "<|endoftext|> z")]
    df = spark.createDataFrame([(*r, "s", "l", "i") for r in rows], DOCS)
    out = packing.pack_documents(df, queries.TOKENIZER, window=64, shard_bytes=shard_bytes).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
    check_sequences(by_seq, 64)
    tok = Tokenizer.from_file(queries.TOKENIZER)
    assert sum(r.length for r in out) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(len(r.ids) for r in out) == 4 * sum(r.length for r in out)


def test_empty_table(spark):
    ship_package(spark)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), queries.TOKENIZER).count() == 0


def test_neighbours_match_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32) for _ in range(50)]
    index = packing.ShardIndex(docs, query_terms=1000)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    sets = [set(d.tolist()) for d in docs]
    df = {t: sum(t in s for s in sets) for s in sets for t in s}

    def score(q, d):
        out = 0.0
        for t in sets[q]:
            f = int((docs[d] == t).sum())
            if df[t] > 1 and f:
                out += np.log1p((n - df[t] + .5) / (df[t] + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * len(docs[d]) / mean))
        return out

    unused = rng.random(50) < .7
    for q in range(0, 50, 7):
        got = index.neighbours(q, unused)
        assert sorted(got) == np.flatnonzero(unused).tolist()
        s = np.array([score(q, d) for d in got])
        assert (np.diff(s) <= 1e-9).all()


def test_production_query_holds_every_shared_token():
    rng = np.random.default_rng(5)
    rare = np.arange(1000, 1070)                   # 70 tokens that two documents share
    middling = np.arange(2000, 2200)               # 200 tokens that six documents share
    seed = np.concatenate([rare, middling])
    docs = [seed, rare[:2], *[middling] * 5, *[rng.integers(0, 900, 200) for _ in range(40)], rare[2:]]
    docs = [d.astype(np.uint32) for d in docs]
    index, plain = packing.ShardIndex(docs), packing.ShardIndex(docs, query_terms=100_000)
    unused = np.ones(len(docs), bool)
    unused[0] = False
    got = index.neighbours(0, unused).tolist()
    assert got == plain.neighbours(0, unused).tolist()
    # five whole copies of the middling tokens outweigh two rare ones
    assert got.index(1) > max(got.index(d) for d in range(2, 7))


def test_dropping_used_documents_keeps_the_order_of_the_rest():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 300, rng.integers(80, 200)).astype(np.uint32) for _ in range(80)]
    index, whole, unused = packing.ShardIndex(docs), packing.ShardIndex(docs), np.ones(80, bool)
    for q in range(0, 60, 6):
        unused[q:q + 6] = False
        index.drop_used(unused)
        assert index.neighbours(q, unused).tolist() == whole.neighbours(q, unused).tolist()


def test_order_goes_on_beyond_the_sorted_head():
    rng = np.random.default_rng(7)
    base = [np.append(rng.integers(0, 400, rng.integers(1, 60)), 450).astype(np.uint32) for _ in range(200)]
    docs = base + base + [np.arange(500, 510, dtype=np.uint32)] * 50  # ties in pairs, and documents without a score
    index, unused = packing.ShardIndex(docs), np.ones(len(docs), bool)
    assert len(index.table)  # frequent tokens are rows of a table
    for seed in (0, 17, 210, 440):
        unused[seed] = False
        left = np.flatnonzero(unused)
        want = left[np.argsort(-index.scores(seed)[left], kind="stable")].tolist()
        for head in (1, 3, 64, 1000):
            assert list(index.ranked(seed, unused, head)) == want


def test_statistics_cover_all_shards(spark, monkeypatch):
    ship_package(spark)
    rows = [(i, "common word " * (1 + i % 3) + f"w{chr(97 + i % 20)}x") for i in range(120)] + [(None, None), (7, "")]
    df = spark.createDataFrame([(*r, "s", "l", "i") for r in rows], DOCS)
    made, plain = [], packing.corpus_of
    monkeypatch.setattr(packing, "corpus_of", lambda encoded: made.append(plain(encoded)) or made[-1])
    assert packing.pack_documents(df, queries.TOKENIZER, window=64, shard_bytes=300).select("sequence_id").count()
    tok = Tokenizer.from_file(queries.TOKENIZER)
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    [corpus] = made
    assert (corpus.n, corpus.tokens) == (len(ids), sum(map(len, ids)))
    assert {t: n for t, n in enumerate(corpus.df.tolist()) if n} == {t: sum(t in x for x in ids) for x in ids for t in x}


def test_index_weighs_by_corpus_statistics():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32) for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    whole = packing.ShardIndex(docs)
    part = packing.ShardIndex(docs[:30], corpus=packing.Corpus(90, sum(map(len, docs)), df))
    unused = np.arange(90) < 30
    for q in range(30):
        assert part.neighbours(q, unused[:30]).tolist() == whole.neighbours(q, unused).tolist()


def test_copies_meet_only_when_nothing_else_is_left(spark):
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 500, rng.integers(5, 30)).astype(np.uint32) for _ in range(200)]
    docs = [d for d in docs for _ in range(2)] + [docs[0]] * 3
    pieces = packing.pack_shard(docs, 64)
    held = {}
    for d, start, n, seq, _ in pieces:
        held.setdefault(seq, set()).add(d)
    assert sorted(d for d, start, *_ in pieces if not start) == list(range(len(docs)))
    texts = [[docs[d].tobytes() for d in x] for _, x in sorted(held.items())]
    assert all(len(set(x)) == len(x) for x in texts[:len(texts) * 4 // 5])
    alone = packing.pack_shard([docs[0]] * 40, 64)  # copies only
    assert sum(n for _, _, n, _, _ in alone) == 40 * len(docs[0])


def test_twice_mixed_documents_stay_apart(spark):
    ship_package(spark)
    rows = [(i, " ".join(f"{w}{i % 40}" for w in ("red", "old", "big", "dry", "low")) + f" n{i}") for i in range(150)] * 2
    df = spark.createDataFrame([(*r, "s", "l", "i") for r in rows], DOCS)
    out = packing.pack_documents(df, queries.TOKENIZER, window=128).collect()
    windows = {}
    for r in out:
        if r.start == 0:
            windows.setdefault(r.sequence_id, []).append(r.doc_id)
    whole = [sorted(v) for _, v in sorted(windows.items())][:len(windows) // 2]
    assert all(len(set(v)) == len(v) for v in whole)


def test_the_encoder_gets_a_megabyte_of_text_at_a_time(monkeypatch):
    sizes = []

    class Encoder:
        def ids(self, texts):
            sizes.append(sum(map(len, texts)))
            return [b"" for _ in texts]

    monkeypatch.setattr(packing.tokens, "encoder", lambda path: Encoder())
    batch = pa.record_batch([pa.array(range(40)), pa.array([0] * 40), pa.array(["x" * 100_000] * 40)], names=["doc_id", "shard", "text"])
    out = list(packing._encoded("vocabulary", 2)(iter([batch])))
    assert sum(map(len, out)) == 40 and sum(sizes) == 4_000_000 and max(sizes) <= 1 << 20
