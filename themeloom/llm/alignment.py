"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokens and bytes make incidence matrices, held as plain CSR arrays. The row
products of A with B transposed (Gustavson's way: a row of the product is the
sum of B's rows that the row of A names) give the overlap links, with the
number of shared bytes. Where a token of A overlaps nothing of its
predecessor's last partner both sides have ended: there a group ends. Products
of the two group incidences give the links of tokens that share a group.

Neither vocabulary has a token that reaches over the start of a word, so the
matrices are block-diagonal by word: a worker aligns every distinct word once.

The corpus counts, for every pair of ids, the documents that hold it linked:
partial counts per task, then a sum per pair. Scores of documents come from
those counts: the most frequent pairs, at most ``TOP_PAIRS``, travel to every
task; all rarer ones are joined, and no rare pair is hot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm.byte_bpe import CLOSED, kept, space_parts
from themeloom.llm.common import small_batches, stage, text_or_empty, utf8
from themeloom.llm.tokens import byte_letters

#: How pieces of the second vocabulary write a space.
BLANK = "\u2581"
#: Bound of the pairs that go to every task (16 bytes each).
TOP_PAIRS = 1 << 18


class Csr(NamedTuple):
    """A 0/1 matrix by rows: row i has its columns in ``cols[at[i]:at[i + 1]]``."""

    at: np.ndarray
    cols: np.ndarray
    width: int


def incidence(lengths: np.ndarray) -> Csr:
    """Token x byte: token i covers the next ``lengths[i]`` bytes."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(at, np.arange(at[-1], dtype=np.int64), int(at[-1]))


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.cols, kind="stable")
    rows = np.repeat(np.arange(len(m.at) - 1), np.diff(m.at))
    at = np.concatenate([[0], np.cumsum(np.bincount(m.cols, minlength=m.width))]).astype(np.int64)
    return Csr(at, rows[order], len(m.at) - 1)


def row_products(a: Csr, b: Csr, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of a·b, in order, in blocks of whole rows that
    take about ``room`` products each."""
    size = np.diff(b.at)[a.cols]
    cost = np.concatenate([[0], np.cumsum(size)])[a.at]
    row, last = 0, len(a.at) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(cost, cost[row] + room, "right")) - 1)
        part = slice(a.at[row], a.at[end])
        n = size[part]
        take = np.repeat(b.at[a.cols[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = np.repeat(np.repeat(np.arange(row, end), np.diff(a.at[row:end + 1])), n)
        key, value = np.unique(of * b.width + b.cols[take], return_counts=True)
        yield key // b.width, key % b.width, value
        row = end


class Aligned(NamedTuple):
    """Overlap links (token of a, token of b, shared bytes) and each token's group."""

    over_a: np.ndarray
    over_b: np.ndarray
    over_n: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Two runs of tokens, none empty, over the same bytes."""
    if not len(len_a):
        none = np.zeros(0, np.int64)
        return Aligned(none, none, none, none, none)
    found = [np.concatenate(x) for x in zip(*row_products(incidence(len_a), transposed(incidence(len_b))))]
    over_a, over_b, over_n = found
    first = np.flatnonzero(np.diff(over_a, prepend=-1))
    last = np.append(first[1:], len(over_a)) - 1
    group_a = np.concatenate([[0], np.cumsum(over_b[first[1:]] > over_b[last[:-1]])])
    group_b = np.zeros(len(len_b), np.int64)
    group_b[over_b] = group_a[over_a]
    return Aligned(over_a, over_b, over_n, group_a, group_b)


def group_links(group_a: np.ndarray, group_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (token of a, token of b) of one group, in blocks."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    a = Csr(np.arange(len(group_a) + 1), group_a, n)
    b = Csr(np.arange(len(group_b) + 1), group_b, n)
    for row, col, _ in row_products(a, transposed(b)):
        yield row, col


def listed_groups(table: list[str], ids_a: np.ndarray, ids_b: np.ndarray, made: Aligned) -> list[str]:
    """Every token of both sides as text, group by group, each with the mark
    that follows it: a comma, ``|`` behind a group's last of a, ``;`` behind
    its last of b. ``table`` is that of :func:`marked`."""
    def codes(ids: np.ndarray, group: np.ndarray, first: int, size: int) -> np.ndarray:
        return ids + np.int64(first) + np.append(np.diff(group) > 0, True) * np.int64(size)

    if not len(ids_a):
        return []
    size = len(table) // 4
    both = np.concatenate([codes(ids_a, made.group_a, 0, size), codes(ids_b, made.group_b, 2 * size, size)])
    order = np.argsort(np.concatenate([made.group_a * 2, made.group_b * 2 + 1]), kind="stable")
    return list(map(table.__getitem__, both[order].tolist()))


def marked(size: int) -> list[str]:
    """The texts that :func:`listed_groups` puts together, for ids below ``size``."""
    return [f"{i}{mark}" for mark in (",", "|", ",", ";") for i in range(size)]


class Part(NamedTuple):
    """What is kept of a word: its numbers of tokens and groups, its groups as
    text, its linked pairs of ids (a << 32 | b, rising) and how often each is
    linked."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes
    times: bytes


class PairEncoder:
    """Both vocabularies, and the aligned words met so far (at most
    ``max_parts``, about 500 bytes each; words of over 64 characters are not kept)."""

    def __init__(self, path_a: str, path_b: str, max_parts: int = 200_000):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: b for b, c in byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                        else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # no token of b holds a space behind another character: words stand alone
        self.by_word = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.marked = marked(max(len(self.bytes_a), len(pieces)))
        self.ones = [np.ones(n, np.int64).tobytes() for n in range(64)]
        self.max_parts = max_parts
        self.known: dict[str, Part | None] = {}

    def parts(self, text: str) -> list[str]:
        """``text`` with a space before it, cut before words."""
        if not self.by_word:
            return [" " + text]
        first, *rest = space_parts(text)
        return [" " + first, *rest]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text that begins with a space, where the bytes of both are the text's."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def learn(self, parts: list[str]) -> dict[str, Part | None]:
        """Parts that may stand behind each other are encoded as one text; the
        bytes of its tokens tell where each part ends."""
        out: dict[str, Part | None] = dict.fromkeys(parts)
        chain = [p for p in parts if self.by_word and len(p) <= 64 and CLOSED.search(p) and BLANK not in p]
        runs = [chain[i:i + 2000] for i in range(0, len(chain), 2000)] + [[p] for p in set(parts).difference(chain)]
        made = [(run, self.ids("".join(run))) for run in runs]
        made += [([p], self.ids(p)) for run, ids in made if ids is None and len(run) > 1 for p in run]
        good = [p for run, ids in made if ids for p in run]
        if not good:
            return out
        ids_a, ids_b = (np.concatenate([ids[i] for _, ids in made if ids]) for i in (0, 1))
        ends = np.cumsum([len(p.encode()) for p in good])
        ends_a = np.searchsorted(np.cumsum(self.size_a[ids_a]), ends) + 1
        ends_b = np.searchsorted(np.cumsum(self.size_b[ids_b]), ends) + 1
        found = align(self.size_a[ids_a], self.size_b[ids_b])
        texts = listed_groups(self.marked, ids_a, ids_b, found)
        part_of = np.repeat(np.arange(len(good)), np.diff(ends_a, prepend=0))
        # the links of a part are counted per pair of ids, block by block
        links = [_counted(part_of[row], ids_a[row] << 32 | ids_b[col], np.ones(len(row), np.int64))
                 for row, col in group_links(found.group_a, found.group_b)]
        of, pair, times = _counted(*[np.concatenate(x) for x in zip(*links)])
        single = np.maximum.reduceat(times, np.searchsorted(of, np.arange(len(good)))) == 1
        pair, times = pair.tobytes(), times.tobytes()
        ends_p = np.searchsorted(of, np.arange(len(good)), "right").tolist()
        a = b = g = k = 0
        rows = zip(good, ends_a.tolist(), ends_b.tolist(), (found.group_a[ends_a - 1] + 1).tolist(), ends_p, single.tolist())
        for p, a2, b2, g2, k2, one in rows:
            n = self.ones[k2 - k] if one and k2 - k < 64 else times[8 * k:8 * k2]
            out[p] = Part(a2 - a, b2 - b, g2 - g, "".join(texts[a + b:a2 + b2])[:-1], pair[8 * k:8 * k2], n)
            a, b, g, k = a2, b2, g2, k2
        return out

    def texts(self, texts: list[str]) -> list[list[Part] | None]:
        """Per text its parts, or None where it has no tokens."""
        split = [self.parts(t) if t else [] for t in texts]
        known = self.known
        unseen = list({p for parts in split for p in parts if p not in known})
        here: dict[str, Part | None] = {}
        for k in range(0, len(unseen), 20_000):
            here |= self.learn(unseen[k:k + 20_000])
        room = self.max_parts - len(known)
        if room > 0:
            known.update(islice(((p, x) for p, x in here.items() if len(p) <= 64), room))
        out: list[list[Part] | None] = []
        for parts in split:
            got = [known[p] if p in known else here[p] for p in parts]
            out.append(None if not got or None in got else got)
        return out


def _counted(of: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (of, pair) with the sum of their times."""
    order = np.lexsort((pair, of))
    of, pair, times = of[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])])) if len(of) else np.zeros(0, np.int64)
    return of[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _encoder(path_a: str, path_b: str) -> PairEncoder:
    return kept(("pair", path_a, path_b), lambda: PairEncoder(path_a, path_b))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, details: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct linked pairs of ids as three arrays a, b
    and times (how often each pair is linked in it).

    With ``details`` also ``groups`` (``a1,a2|b1;a3|b2``) and ``overlaps``, an
    array of (a, b, n_bytes): positions of tokens that share bytes. Texts that
    are null or empty, or whose tokens of either side do not join to a space
    and the text, have no tokens: zeros, an empty digest and empty arrays.
    Repeated rows and null ids each give a row; columns other than doc_id and
    text are not looked at. Both files must be readable on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path_a, path_b)
        for batch in small_batches(batches, 2 << 20):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            rows, of, pairs, times = [], [], [], []
            texts = [t.decode("utf-8", "replace") for t in utf8(batch, "text")]
            for k, parts in enumerate(enc.texts(texts)):
                parts = parts or []
                groups = ";".join([p.groups for p in parts])
                pair = np.frombuffer(b"".join([p.pairs for p in parts]), np.int64)
                n = np.frombuffer(b"".join([p.times for p in parts]), np.int64)
                row = (sum([p.n_a for p in parts]), sum([p.n_b for p in parts]), sum([p.n_groups for p in parts]), int(n.sum()),
                       hashlib.sha256(groups.encode()).hexdigest() if parts else "")
                if details:
                    ids_of = enc.ids(" " + texts[k]) if parts else None
                    made = align(enc.size_a[ids_of[0]], enc.size_b[ids_of[1]])[:3] if ids_of else ([], [], [])
                    row += (groups, [dict(a=int(x), b=int(y), n_bytes=int(z)) for x, y, z in zip(*made)])
                rows.append(row)
                of.append(np.full(len(pair), k))
                pairs.append(pair)
                times.append(n)
            if not rows:
                continue
            at, pair, n = _counted(np.concatenate(of), np.concatenate(pairs), np.concatenate(times))
            cut = pa.array(np.searchsorted(at, np.arange(len(rows) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(w))) for v, w in
                     ((pair >> 32, np.int32), (pair & 0xFFFFFFFF, np.int32), (n, np.int64))]
            cols = list(zip(*rows))
            out = [ids, *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), *lists]
            if details:
                out += [pa.array(cols[5], pa.string()), pa.array(cols[6], overlap)]
            yield pa.record_batch(out, names=names)

    overlap = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_bytes", pa.int32())]))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"]
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
              "n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<bigint>")
    if details:
        names += ["groups", "overlaps"]
        schema += ", groups string, overlaps array<struct<a:int,b:int,n_bytes:int>>"
    return rows.mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's entries begin, and the entries of the list columns."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    at = cols[0].offsets.to_numpy()
    return at - at[0], [c.flatten().to_numpy() for c in cols]


def pair_counts(rows: DataFrame, room: int = 4_000_000) -> DataFrame:
    """(a, b, n): how many rows hold the pair in their arrays a and b. A task
    adds up its own rows first, ``room`` entries at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)),
                                    pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        for batch in batches:
            _, (a, b) = _flat(batch, "a", "b")
            held.append(a.astype(np.int64) << 32 | b)
            size += len(a)
            if size >= room:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return (rows.select("a", "b").mapInArrow(run, "a int, b int, n bigint")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def least_count(counts: DataFrame, top: int) -> int:
    """The smallest power of two that at most ``top`` pairs reach."""
    by_power = {int(r.p): r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()}
    power = max(by_power, default=0) + 1
    held = 0
    while power > 0 and held + by_power.get(power - 1, 0) <= top:
        power -= 1
        held += by_power.get(power, 0)
    return 1 << power


def scored(rows: DataFrame, counts: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """``rows`` (with a number ``row`` of its own for each) without its arrays,
    with ``n_best``, the links whose pair is the most frequent of its a, and
    ``count_sum``, the sum of the pairs' counts over the links.

    ``rows`` and ``counts`` are written tables. Of the counts, the frequent
    pairs (at most ``top``) and the highest of each id of a (at most the
    vocabulary) go to every task; the others meet their counts in a join."""
    spark = rows.sparkSession
    least = least_count(counts, top)
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    often = counts.filter(F.col("n") >= least).toPandas()
    highest = best.toPandas()
    order = np.argsort(pair := (often.a.to_numpy(np.int64) << 32 | often.b.to_numpy(np.int64)))
    of_a = np.zeros(int(highest.a.max()) + 1 if len(highest) else 1, np.int64)
    of_a[highest.a.to_numpy(np.int64)] = highest.best.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((pair[order], often.n.to_numpy(np.int64)[order], of_a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_of, of_a = shared.value
        for batch in batches:
            at, (a, b, times) = _flat(batch, "a", "b", "times")
            want = a.astype(np.int64) << 32 | b
            place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = keys[place] == want if len(keys) else np.zeros(len(want), bool)
            n = np.where(hit, n_of[place] if len(keys) else 0, 0)
            sums = [np.concatenate([[0], np.cumsum(v)])[at] for v in (times * (hit & (n == of_a[a])), times * n)]
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[at], pa.int32())
            cols = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("a", "b", "times")]
            cols += [pa.array(np.diff(s), pa.int64()) for s in sums]
            cols += [pa.ListArray.from_arrays(left, pa.array(v[~hit])) for v in (a, b, times)]
            yield pa.record_batch(cols, names=names)

    plain = rows.drop("a", "b", "times")
    names = [*plain.columns, "n_best", "count_sum", "a", "b", "times"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    half = stage(rows.select(*plain.columns, "a", "b", "times").mapInArrow(
        run, schema + ", n_best bigint, count_sum bigint, a array<int>, b array<int>, times array<bigint>"), "alignment-sums")
    rare = (half.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("row", "x.*")
            .join(counts.filter(F.col("n") < least), ["a", "b"]).join(best, "a")
            .groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return (half.drop("a", "b", "times").join(rare, "row", "left")
            .select(*plain.columns, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")))


def alignment(docs: DataFrame, path_a: str, path_b: str, top: int = TOP_PAIRS) -> DataFrame:
    """Per row of ``docs`` its counts of tokens, groups and links, the digest
    of its groups, and ``n_best`` and ``count_sum`` against the whole corpus
    (see ``aligned_texts`` and ``scored``)."""
    rows = stage(aligned_texts(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "pair-counts")
    return scored(rows, counts, top).drop("row")
