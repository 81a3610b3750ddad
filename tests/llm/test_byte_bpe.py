"""Byte-level BPE against the tiktoken library, decoding as an exact round trip."""

import hashlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.llm import byte_bpe
from themeloom.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TABLE = byte_bpe.read_ranks(RANKS)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
TOKENIZER = byte_bpe.byte_tokenizer(RANKS, public_tokenizers.PATTERN)
SIZE = np.array([len(x) for x in byte_bpe.byte_table(RANKS)])

ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n x", "it's we'll 'x", "x y  z", "  a", "\x1c a\x85 b",
       "1234 56", "!? ...", "<|endoftext|> a", "é è́", "日本語 テキスト", "👩‍👩‍👧 👍🏽", "\U0010ffff\u0000 ​", "tab\tx ", "a  b", " ﻿ x",
       "a" * 5000, "ab " * 3000, "é" * 2000, " " * 1000 + "x"]


def ids_of(texts):
    enc = byte_bpe.ByteEncoder(TOKENIZER, SIZE, max_parts=5)
    return [list(array("I", x)) for x in enc.ids(texts)]


def test_ids_are_those_of_tiktoken():
    assert ids_of(ODD) == [ORACLE.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4), st.lists(st.text("ab'sé 1!\n\t 日", max_size=30), max_size=4))
def test_ids_of_any_text(a, b):
    assert ids_of(a + b) == [ORACLE.encode_ordinary(t) for t in a + b]


def test_the_split_takes_every_code_point_as_tiktoken_does():
    # a pair that its table holds whole is one token exactly where the split keeps it together
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF] + [chr(c) for c in range(0xA000, 0x1F000, 7) if not 0xD800 <= c <= 0xDFFF]
    pairs = [lead + c for c in chars for lead in "a1!\n"]
    held = dict(TABLE)
    for p in pairs:
        held.setdefault(p.encode(), len(held))
    whole = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
    split = TOKENIZER.pre_tokenizer.pre_tokenize_str
    assert [p for p in pairs if (len(whole.encode_ordinary(p)) == 1) != (len(split(p)) == 1)] == []


def test_every_rank_has_its_merge_again():
    for token in list(TABLE)[256::97]:
        assert TOKENIZER.model.tokenize("".join(byte_bpe.byte_letters()[b] for b in token))[0].id == TABLE[token]


def test_table_reverses_the_written_bytes():
    table = byte_bpe.byte_table(RANKS)
    assert {t: i for i, t in enumerate(table)} == TABLE


def test_rows_nulls_repeats_other_columns_and_offsets(spark):
    texts = [None, "", *ODD, "same", "same"]
    docs = spark.createDataFrame([(None if i % 7 == 3 else i, t, "x", b"y") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, decoded binary")
    made = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    rows = byte_bpe.decode_ids(made, RANKS).collect()
    assert len(rows) == len(texts)
    want = sorted((t or "") for t in texts)
    assert sorted(bytes(r.decoded).decode() for r in rows) == want
    table = byte_bpe.byte_table(RANKS)
    for r in rows:
        text, ids = bytes(r.decoded).decode(), list(array("I", r.ids))
        assert ids == ORACLE.encode_ordinary(text) and r.n_tokens == len(ids) and (r.n_lead, r.n_open) == (0, 0)
        at, pos = [], 0
        starts = np.cumsum([0, *[len(c.encode()) for c in text]])
        for i in ids:
            end = pos + len(table[i])
            touched = [k for k in range(len(text)) if starts[k] < end and starts[k + 1] > pos]
            at.append((touched[0], touched[-1] + 1))
            pos = end
        assert list(zip(r.char_start, r.char_end)) == at if len(text) < 1500 else len(at) == len(r.char_start)


def test_pieces_of_split_characters_join_again(spark):
    text = "👩‍👩‍👧 日本語 naïve 🏳️‍🌈 \U0010ffff end"
    ids = ORACLE.encode_ordinary(text)
    pieces = [(k, array("I", [i]).tobytes()) for k, i in enumerate(ids)] + [(99, None), (100, b"")]
    rows = byte_bpe.decode_ids(spark.createDataFrame(pieces, "at int, ids binary"), RANKS).orderBy("at").collect()
    assert b"".join(bytes(r.decoded) for r in rows).decode() == text
    assert any(r.n_lead for r in rows) and any(r.n_open for r in rows)
    for r in rows:
        whole = bytes(r.decoded)[r.n_lead:len(r.decoded) - r.n_open]
        whole.decode()  # whole characters only


def test_split_ends():
    for text in ("", "a", "é", "日", "👍", "a👍", "👍a"):
        data = text.encode()
        for a in range(len(data) + 1):
            for z in range(a, len(data) + 1):
                lead, rest = byte_bpe.split_ends(data[a:z])
                data[a + lead:z - rest].decode()
                assert 0 <= lead <= 3 and 0 <= rest <= 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = ORACLE.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


@pytest.mark.parametrize("token", [b"the", b" the"])
def test_halves(token):
    a, z = byte_bpe.halves(token, TABLE)
    assert a + z == token and a in TABLE and z in TABLE
