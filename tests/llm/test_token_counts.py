import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF0001
from themeloom.llm import queries, token_counts, tokens
from themeloom.llm.common import shared_folder
from themeloom.session import ship_package

DOCS = "doc_id bigint, text string, n_tokens string, digest string, n_bytes string"
ODD = ["a<|endoftext|>b <|startoftext|> <|endoftext|", "I'LL don't 'S it's can'tx '''s", "É ﬁ İstanbul ΑΣ Σ", "a\x1cb \x85c\xa0d e　f",
       "１２ x½ 12ab 3,4.", "日本語 한국어 \U0001f600!!", "ß ẞ Ǆ ŉ µ ª ÿŸ", "\x00\x01 ​﻿", "A" * 3000, "", " \n\t\x0b\x0c\r",
       "Th. the, (the) the! the... #the", "Été, dÉjÀ. naïve x", "a ́b", "x̣́", "word " * 4000]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.mark.parametrize("room", [0, 3, 400_000])
def test_ids_equal_the_library(tok, room):
    enc = tokens.TextEncoder(queries.TOKENIZER, max_words=room)
    assert enc.by_word
    for _ in range(2):  # the second time from the tables
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.ids([t.encode() for t in ODD])]
        assert got == [e.ids for e in tok.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("alone", [True, False])
def test_lower_case_and_split_marks_keep_the_ids(tok, alone):
    texts = ["A<|ENDOFTEXT|>B c", "a<|EndOfText|> D. E", "THE End. The end, x!. 3. 4,5. A, B, C.\nD.", "H\u0331. H\u0331 I\u0307,",
             "Plain ASCII, Twice. Plain ASCII, twice.", "\u00c9. Z. z,", "<|endoftext|>. <|startoftext|>, X. ", ".", ", .", "a.\x0bb. c"]
    enc = tokens.TextEncoder(queries.TOKENIZER)
    data = [t.encode() for t in texts]
    got = [enc.ids([x])[0] for x in data] if alone else enc.ids(data)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids([]) == [] and enc.ids([b"", b" \n"]) == [b"", b""]


def test_other_kinds_of_tokenizer_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.TextEncoder(path)
    assert not enc.by_word
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.ids([t.encode() for t in ODD])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]


def test_query_matches_the_library(spark, tok):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_token_counts"](spark, SF0001).collect()
    want = {i: len(e.ids) for i, e in zip(docs, tok.encode_batch(list(docs.values()), add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(docs)
    assert all(r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_odd_rows_and_cache(spark, tok):
    ship_package(spark)
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (3, "another text"), (None, None), (None, "b  c"), (100, "b c"), (101, " b\nc ")]
    cache = shared_folder(spark, "cache-test")

    def counted(rows):
        df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
        out = token_counts.token_counts(df, cache, queries.TOKENIZER, limit=3)
        return sorted([tuple(r) for r in out.collect()], key=str)

    def expected(rows):
        texts = [t or "" for _, t in rows]
        made = tok.encode_batch(texts, add_special_tokens=False)
        return sorted([(i, len(t.encode()), len(e.ids), len(e.ids) > 3) for (i, _), t, e in zip(rows, texts, made)], key=str)

    assert counted(rows) == expected(rows)
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count() == len({b" ".join((t or "").encode().split()) for _, t in rows})
    # known texts are not encoded again: what the cache says is taken
    changed = shared_folder(spark, "cache-test")
    stored.selectExpr("tokenizer", "digest", "n_tokens + 1000 as n_tokens").write.parquet(changed)
    cache = changed
    more = rows + [(200, "a new text")]
    got = counted(more)
    assert [r[2] for r in got] == [r[2] + (0 if r[0] == 200 else 1000) for r in expected(more)]
    assert spark.read.parquet(cache).count() == n + 1
    assert counted([]) == []


def test_many_rows_without_or_with_one_id(spark, tok):
    """Rows of one id meet only by their text: work in proportion to the rows."""
    ship_package(spark)
    texts = [f"text {i} of w{i % 7}" for i in range(6000)] + ["same"] * 500
    df = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = token_counts.token_counts(df, shared_folder(spark, "cache-ids"), queries.TOKENIZER)
    want = sorted(len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False))
    assert sorted(r.n_tokens for r in out.collect()) == want
