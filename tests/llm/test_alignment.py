"""Token alignment against a plain restatement with the whole library calls."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from themeloom.llm import alignment
from themeloom.llm.queries import QUERIES
from themeloom.llm.tokens import byte_letters
from themeloom.session import ship_package

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)
BACK = {c: b for b, c in byte_letters().items()}

ODD = [None, "", " ", "  ", "a", " a", "a  b ", "the cat sat", "x\n y\t z", "it's 12,345.67!!", "naïve café", "日本語 テキスト 👩‍👩‍👧",
       "has ▁ in it", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01", "\xa0z　", "a" * 3000, "é" * 900,
       "ab " * 2000, " " * 300, "👍" * 500, "same words here", "same words here"]


def bytes_b(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()


def plain(text):
    """(ids a, ids b, groups as pairs of lists) by ends of tokens, or None."""
    if not text:
        return None
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    da = [bytes(BACK[c] for c in TOK.id_to_token(i)) for i in a]
    db = [bytes_b(i) for i in b]
    if not b"".join(da) == b"".join(db) == (" " + text).encode():
        return None
    groups, i, j = [], 0, 0
    while i < len(a):
        ga, gb, ea, eb = [a[i]], [b[j]], len(da[i]), len(db[j])
        i, j = i + 1, j + 1
        while ea != eb:
            if ea < eb:
                ga.append(a[i]); ea += len(da[i]); i += 1
            else:
                gb.append(b[j]); eb += len(db[j]); j += 1
        groups.append((ga, gb))
    return a, b, groups


def brute(docs):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)]"""
    made = [(i, plain(t)) for i, t in docs]
    links = [Counter((x, y) for ga, gb in m[2] for x in ga for y in gb) if m else Counter() for _, m in made]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, m), c in zip(made, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in m[2]) if m else None
        out.append((i, len(m[0]) if m else 0, len(m[1]) if m else 0, len(m[2]) if m else 0, sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if m else ""))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_products_against_sets_of_bytes(a, b):
    short = sum(a) - sum(b)
    a, b = (a, b + [short]) if short > 0 else (a + [-short], b) if short < 0 else (a, b)
    made = alignment.align(np.array(a), np.array(b))
    ea, eb = np.cumsum(a), np.cumsum(b)
    want = [(i, j, min(ea[i], eb[j]) - max(ea[i] - a[i], eb[j] - b[j])) for i in range(len(a)) for j in range(len(b))]
    assert [(i, j, n) for i, j, n in want if n > 0] == list(zip(*[x.tolist() for x in made[:3]]))
    both = sorted(set(ea) & set(eb))
    assert made.group_a.tolist() == [int(np.searchsorted(both, e)) for e in ea]
    assert made.group_b.tolist() == [int(np.searchsorted(both, e)) for e in eb]
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if made.group_a[i] == made.group_b[j]]
    assert links == [(int(x), int(y)) for r, c in alignment.group_links(made.group_a, made.group_b) for x, y in zip(r, c)]


@pytest.mark.parametrize("room", [1, 7, 1 << 20])
def test_row_products_in_blocks_equal_a_dense_product(room):
    rng = np.random.default_rng(3)
    a, b = rng.random((9, 12)) < 0.3, rng.random((12, 7)) < 0.3

    def csr(m):
        return alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])

    out = np.zeros((9, 7), int)
    for i, j, n in alignment.row_products(csr(a), csr(b), room):
        out[i, j] = n
    assert (out == a.astype(int) @ b.astype(int)).all()
    back = alignment.transposed(csr(a))
    assert (back.at == csr(a.T).at).all() and (back.cols == csr(a.T).cols).all()


@pytest.mark.parametrize("top", [0, 5, 1 << 18])
def test_rows_nulls_ties_repeats_and_other_columns(spark, top):
    ship_package(spark)
    docs = [(None if i % 9 == 4 else i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*d, 1, "x", 5) for d in docs], "doc_id long, text string, a int, row string, n_a int").repartition(3)
    got = alignment.alignment(frame, A, B, top=top)
    rows = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(brute(docs), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5), st.lists(st.text("ab's é1!\n\t 日", max_size=25), max_size=5))
def test_words_alone_have_the_ids_of_whole_texts(a, b):
    texts = a + b
    for text, parts in zip(texts, alignment.PairEncoder.texts(ENC, texts)):
        want = plain(text)
        assert (parts is None) == (want is None)
        if want:
            assert ";".join(p.groups for p in parts) == ";".join(
                ",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in want[2])
            assert (sum(p.n_a for p in parts), sum(p.n_b for p in parts)) == (len(want[0]), len(want[1]))


ENC = alignment.PairEncoder(A, B, max_parts=10)


def test_details(spark):
    ship_package(spark)
    text = "the naïve cat's 👍 日本語"
    row = alignment.aligned_texts(spark.createDataFrame([(1, text)], "doc_id int, text string"), A, B, details=True).first()
    a, b, groups = plain(text)
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert sum(o.n_bytes for o in row.overlaps) == len(text.encode()) + 1
    assert {o.a for o in row.overlaps} == set(range(len(a))) and {o.b for o in row.overlaps} == set(range(len(b)))


def test_least_count(spark):
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate([1, 1, 1, 2, 3, 4, 9])], "a int, b int, n long")
    assert [alignment.least_count(counts, t) for t in (0, 1, 2, 3, 4, 6, 7)] == [16, 8, 4, 4, 2, 2, 1]
    assert alignment.least_count(counts.limit(0), 3) == 1


def test_empty_table(spark):
    ship_package(spark)
    assert alignment.alignment(spark.createDataFrame([], "doc_id int, text string"), A, B).collect() == []


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, sf).collect())) == sorted(brute(docs))
