"""Packing documents into training windows with lexically near neighbours.

Documents are dealt by hash to shards of about ``shard_bytes`` of text; a task
packs one shard at a time. A shard's inverted index holds the BM25 weight of
every (token, document); the statistics in it are those of the whole corpus, but
only the seed's own shard is asked for neighbours. A window begins with a seed: what is left of the
document that the window before cut, else the next unused document. The index
returns the seed's unused neighbours, best first, which fill the window; when
none shares a token the shard's next documents do. A text that the window holds
already waits while others are left, so that copies of a document (repeats of
an epoch, say) do not meet. Documents are cut at window
ends, so every window is full. What a shard has left at its end is cut into
sequences whose lengths are falling powers of two, which need no padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm import tokens
from themeloom.llm.common import small_batches, stage, text_or_empty, utf8

ENCODED = "doc_id bigint, shard bigint, ids binary"
MAX_TASKS = 20_000
PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Corpus(NamedTuple):
    """Number of documents, of their tokens, and of the documents that hold each token."""

    n: int
    tokens: int
    df: np.ndarray


class ShardIndex:
    """BM25 postings over the token ids of a shard's documents.

    A query is all of a document's tokens that others hold too, or its
    ``query_terms`` rarest ones. ``corpus`` is the documents that the
    statistics cover, by default the shard's own."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, query_terms: int | None = None,
                 corpus: Corpus | None = None):
        self.n, self.query_terms = len(docs), query_terms
        lengths = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64)
        width = int(flat.max()) + 1
        keys, tf = np.unique(np.repeat(np.arange(self.n), lengths) * width + flat, return_counts=True)
        doc, self.terms = keys // width, keys % width
        held = np.bincount(self.terms, minlength=width)
        n, tokens_held, df = (self.n, lengths.sum(), held) if corpus is None else (corpus.n, corpus.tokens, corpus.df[:width])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / max(1.0, tokens_held / n))
        weight = idf[self.terms] * tf * (k1 + 1) / (tf + norm[doc])
        # the postings of a token that a quarter of the shard or more holds are a row of a
        # table, which has a column for each document; such rows add up faster
        dense = held * 4 >= self.n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        of_dense = dense[self.terms]
        self.table = np.zeros((np.count_nonzero(dense), self.n))
        self.table[self.row[self.terms[of_dense]], doc[of_dense]] = weight[of_dense]
        self.columns = np.arange(self.n)
        by_term = np.argsort(self.terms, kind="stable")
        by_term = by_term[~of_dense[by_term]]
        self.post_doc, self.post_weight = doc[by_term], weight[by_term]
        self.post_at = np.concatenate([[0], np.cumsum(np.where(dense, 0, held))])
        self.doc_at = np.searchsorted(doc, np.arange(self.n + 1))
        self.df, self.idf = df, idf

    def drop_used(self, unused: np.ndarray) -> None:
        """Postings of used documents go; the scores of the others stay as they are."""
        keep = unused[self.post_doc]
        self.post_at = np.concatenate([[0], np.cumsum(keep)])[self.post_at]
        self.post_doc, self.post_weight = self.post_doc[keep], self.post_weight[keep]
        keep = unused[self.columns]
        self.table, self.columns = self.table[:, keep], self.columns[keep]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's tokens; nothing for dropped ones."""
        terms = self.terms[self.doc_at[seed]:self.doc_at[seed + 1]]
        terms = terms[self.df[terms] > 1]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argsort(self.df[terms], kind="stable")[:self.query_terms]]
        row = self.row[terms]
        score = np.zeros(self.n)
        score[self.columns] = self.table[row[row >= 0]].sum(axis=0)
        few = terms[row < 0]
        spans = [slice(i, j) for i, j in zip(self.post_at[few].tolist(), self.post_at[few + 1].tolist()) if i < j]
        if spans:
            score += np.bincount(np.concatenate([self.post_doc[s] for s in spans]),
                                 np.concatenate([self.post_weight[s] for s in spans]), self.n)
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents: by falling score, those without a score last, ties in order."""
        return np.fromiter(self.ranked(seed, unused), np.int64)

    def ranked(self, seed: int, unused: np.ndarray, head: int = 64) -> Iterator[int]:
        """``neighbours`` one by one: the best ``head`` are sorted first, the others only if asked for."""
        left = np.flatnonzero(unused)
        score = -self.scores(seed)[left]
        if len(left) > 2 * head:
            best = score <= np.partition(score, head)[head]
            yield from left[best][np.argsort(score[best], kind="stable")].tolist()
            left, score = left[~best], score[~best]
        yield from left[np.argsort(score, kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents, none empty."""
    index = ShardIndex(docs, corpus=corpus)
    text = [xxhash.xxh3_128_digest(d.tobytes()) for d in docs]
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, following, left_over, listed = 0, 0, None, len(docs)

    while True:
        if left_over is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return pieces
            unused[following] = False
            left_over = (following, 0)
        (doc, start), first, room = left_over, len(pieces), window
        left_over = None
        take = min(room, len(docs[doc]) - start)
        pieces.append((doc, start, take, seq, 0))
        room -= take
        if start + take < len(docs[doc]):
            left_over = (doc, start + take)
        elif room:
            if (n := np.count_nonzero(unused)) < 0.85 * listed:
                index.drop_used(unused)
                listed = n
            for near in _copies_last(index.ranked(doc, unused), text, text[doc]):
                unused[near] = False
                take = min(room, len(docs[near]))
                pieces.append((near, 0, take, seq, window - room))
                room -= take
                if take < len(docs[near]):
                    left_over = (near, take)
                if not room:
                    break
        if room:  # the shard's end
            return pieces[:first] + _powers_of_two(pieces[first:], window - room, seq)
        seq += 1


def _copies_last(ranked: Iterable[int], text: list[bytes], seed: bytes) -> Iterator[int]:
    """``ranked`` documents; those whose text is the seed's or came before follow at the end."""
    met, waiting = {seed}, []
    for near in ranked:
        if text[near] in met:
            waiting.append(near)
        else:
            met.add(text[near])
            yield near
    yield from waiting


def _powers_of_two(pieces: list[tuple], total: int, seq: int) -> list[tuple]:
    """The pieces of one sequence dealt to sequences of falling powers of two."""
    out, room, offset = [], 1 << (total.bit_length() - 1), 0
    for doc, start, length, _, _ in pieces:
        while length:
            take = min(room, length)
            out.append((doc, start, take, seq, offset))
            start, length, room, offset, total = start + take, length - take, room - take, offset + take, total - take
            if not room and total:
                room, offset, seq = 1 << (total.bit_length() - 1), 0, seq + 1
    return out


def _encoded(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer_path), np.array([end_id], np.uint32).tobytes()
        for b in small_batches(batches, 1 << 20):  # the encoder needs some 20 times that beside its tables
            ids = pa.array([x + end for x in enc.ids(utf8(b, "text"))], pa.binary())
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "shard")] + [ids],
                                  names=["doc_id", "shard", "ids"])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, df) of a task's documents; at token -1 their number, at -2 their tokens."""
    n, size, df = 0, 0, np.zeros(0, np.int64)
    last = np.zeros(0, np.int64)  # place of each token in the document that it was met in last
    for b in batches:
        for x in b.column(0):
            ids = np.frombuffer(x.as_buffer(), np.uint32)
            if (top := int(ids.max())) >= len(df):
                df, last = (np.concatenate([a, np.zeros(top + 1 - len(a), np.int64)]) for a in (df, last))
            place = np.arange(len(ids))
            last[ids] = place
            df[ids[last[ids] == place]] += 1
            n, size = n + 1, size + len(ids)
    held = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate([[-1, -2], held]), pa.int64()),
                           pa.array(np.concatenate([[n, size], df[held]]), pa.int64())], names=["token", "df"])


def corpus_of(encoded: DataFrame) -> Corpus:
    """Statistics of all rows' ``ids``: a number for each token of the vocabulary."""
    rows = encoded.select("ids").mapInArrow(_counted, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))
    found = {r.token: r.df for r in rows.collect()}
    df = np.zeros(max(found, default=0) + 1, np.int64)
    for token, n in found.items():
        if token >= 0:
            df[token] = n
    return Corpus(found.get(-1, 0), found.get(-2, 0), df)


def _packed(window: int, corpus: Corpus):
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.int64()] * 6 + [pa.binary()]

    def shard_rows(shard: int, ids: list, docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(ids[d], start, n, len(docs[d]), (shard << 32) + seq, offset, docs[d][start:start + n].tobytes())
                for d, start, n, seq, offset in pack_shard(docs, window, corpus)]
        for i in range(0, len(rows), 1000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 1000]), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, docs = None, [], []
        for b in small_batches(batches):
            for shard, doc_id, x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "doc_id", "ids"))):
                if shard != now and docs:
                    yield from shard_rows(now, ids, docs)
                    ids, docs = [], []
                now = shard
                ids.append(doc_id)
                docs.append(np.frombuffer(x, np.uint32))
        if docs:
            yield from shard_rows(now, ids, docs)
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096,
                   shard_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of all rows of ``docs``: doc_id, start, length, doc_tokens,
    sequence_id, offset and ids (little-endian 32-bit numbers).

    Each document is its token ids (whole text, no added special tokens) and
    ``end_id``; a null or empty text is ``end_id`` alone. Repeated rows are
    packed each, null ids are passed on. ``window`` is a power of two. Shards
    are dealt by hash of id and text; their number follows the bytes of text,
    and a task has about as many of them as any other.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    encoded = stage(dealt.mapInArrow(_encoded(tokenizer_path, end_id), ENCODED), "packing-ids")
    return (encoded.repartitionById(min(shards, MAX_TASKS), (F.col("shard") % MAX_TASKS).cast("int")).sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(1)), "doc_id")
            .mapInArrow(_packed(window, corpus_of(encoded)), PIECE))
