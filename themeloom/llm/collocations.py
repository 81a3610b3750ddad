"""Phrases whose words stand together more often than their parts suggest.

A weighted de Bruijn graph per language: nodes are two-word grams, and the
longest gram, three words, is the edge from its first two to its last two.
Where a piece of text ends its last gram leaves the graph: a piece-end weight.

1. Tasks count the edges and piece ends of many texts at once and deal them, in
   blocks with their own word list, to buckets by the hash of the node; the
   edges of a node with very many successors by the hash of the edge.
2. A bucket adds up its edges. Edges below the least count carry no phrase, so
   they and the piece ends become one number per node, the rest of its flow.
3. Unary paths of the remaining edges, where each node has one way in and one
   way out, are compacted by pointer doubling.
4. Counts of shorter grams are flows: of a node, its edge on a path, or the sum
   of its branches, plus the rest; of a word, the flow of its nodes plus the
   pieces that end with it.

Nothing is dropped on the way to a count: all flows are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import small_batches, stage, text_or_empty, utf8

#: Text bytes that a bucket stands for, and words that a task counts at once.
BUCKET_BYTES = 12 << 20
ROOM = 2_000_000
#: A node with more distinct successors in a task's count is dealt by edge.
HOT = 4096

_END = 0xFF  # in no UTF-8 text
_FOLD = bytes(_END if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
              for b in range(256))


def piece_words(text: bytes, slice_bytes: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``b"\\xff"`` between pieces, some at a time."""
    text = text.translate(_FOLD).replace(b"\xff", b" \xff ")
    at = 0
    while at < len(text):
        cut = len(text)
        if cut - at > slice_bytes:
            cut = text.rfind(b" ", at, at + slice_bytes)
            if cut <= at:
                cut = text.find(b" ", at + slice_bytes)
                cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def gram_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, z) of a run of word numbers, 0 between pieces: each word with its
    two successors, z = 0 at the end of a piece; a piece of one word is (x, 0, 0)."""
    x = np.zeros(len(ids) + 4, np.int32)
    x[1:-3] = ids
    one, two, before, three = x[1:-3], x[2:-2], x[:-4], x[3:-1]
    take = np.flatnonzero((one > 0) & ((two > 0) | (before == 0)))
    y, z = two[take], three[take]
    z[y == 0] = 0
    return one[take], y, z


def distinct_rows(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray,
                  size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (x, y, z) with the sum of n; all numbers are below ``size``."""
    if not len(x):
        return x, y, z, n
    if size ** 3 < 1 << 62:
        key = x.astype(np.int64)
        key *= size
        key += y
        key *= size
        key += z
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    else:
        order = np.lexsort((z, y, x))
        a, b, c = x[order], y[order], z[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
        del a, b, c
    at = order[first]
    return x[at], y[at], z[at], np.add.reduceat(n[order], first)


def _small(a: np.ndarray) -> bytes:
    """The narrowest unsigned form; its width is its length by the number of rows."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


BLOCK = "bucket int, lang string, open boolean, n_rows int, words binary, x binary, y binary, z binary, n binary"


class _Counting:
    """Word numbers of the texts of one count, by language."""

    def __init__(self, buckets: int, hot: int):
        self.buckets, self.hot = buckets, hot
        self.words: dict[bytes, int] = {b"\xff": 0}
        self.runs: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        run, words = self.runs.setdefault(lang, []), self.words
        for part in piece_words(text):
            for w in set(part).difference(words):
                words[w] = len(words)
            run.append(np.fromiter(map(words.__getitem__, part), np.int32, len(part)))
            self.size += len(part)
        run.append(np.zeros(1, np.int32))

    def blocks(self) -> Iterator[pa.RecordBatch]:
        names = list(self.words)
        names[0] = b""
        hashes = np.fromiter((zlib.crc32(w) for w in names), np.uint64, len(names))
        for lang, run in self.runs.items():
            x, y, z = gram_rows(np.concatenate(run))
            run.clear()
            x, y, z, n = distinct_rows(x, y, z, np.ones(len(x), np.int32), len(names))
            if not len(x):
                continue
            first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            node = np.cumsum(first) - 1
            hot = np.bincount(node)[node] > self.hot
            home = _mixed(hashes[x] << np.uint64(32) | hashes[y])
            to = (np.where(hot, _mixed(home + hashes[z]), home) >> np.uint64(16)) % np.uint64(self.buckets)
            # the home of a hot node hears of it by a row without weight
            told = np.flatnonzero(hot & first)
            x, y, z, n = (np.concatenate([v, w]) for v, w in zip((x, y, z, n), (x[told], y[told], 0 * told, 0 * told)))
            to = np.concatenate([to, (home[told] >> np.uint64(16)) % np.uint64(self.buckets)]).astype(np.int64)
            group = to * 2 + np.concatenate([hot, np.zeros(len(told), bool)])
            order = np.argsort(group, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(group[order]) > 0, True)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                at = order[a:b]
                used, local = np.unique(np.concatenate([[0], x[at], y[at], z[at]]), return_inverse=True)
                k, local = len(at), local[1:]
                row = [int(to[at[0]]), lang, bool(group[at[0]] & 1), k, b" ".join([names[i] for i in used[1:].tolist()]),
                       *[_small(local[i * k:(i + 1) * k]) for i in range(3)], _small(n[at])]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], names=_BLOCK_NAMES)


_BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), *[pa.binary()] * 5]


def edge_blocks(docs: DataFrame, buckets: int, hot: int = HOT, room: int = ROOM) -> DataFrame:
    """Step 1: blocks of distinct (x, y, z) rows with their counts, for a bucket each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counting(buckets, hot)
        for batch in small_batches(batches):
            for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), utf8(batch, "text")):
                held.add(lang, text)
                if held.size >= room:
                    yield from held.blocks()
                    held = _Counting(buckets, hot)
        yield from held.blocks()

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, BLOCK)


FLOW = "lang string, w1 string, w2 string, w3 string, n bigint"


class _Bucket:
    """The rows of one bucket and language, over one list of words."""

    def __init__(self):
        self.words: dict[bytes, int] = {b"": 0}
        self.parts: list[tuple] = []

    def add(self, block: dict) -> None:
        k, words = block["n_rows"], self.words
        mine = block["words"].split(b" ") if block["words"] else []
        for w in mine:
            if w not in words:
                words[w] = len(words)
        number = np.array([0, *map(words.__getitem__, mine)], np.int32)
        self.parts.append((*[number[_wide(block[c], k)] for c in "xyz"], _wide(block["n"], k).astype(np.int64),
                           np.full(k, block["open"])))


def _flows_of(lang: str, bucket: _Bucket, least: int) -> Iterator[pa.RecordBatch]:
    """Step 2 for one bucket and language."""
    words = bucket.words
    x, y, z, n, opened = (np.concatenate(v) for v in zip(*bucket.parts))
    bucket.parts.clear()
    told, size = n == 0, len(words)
    if told.any():
        node = x.astype(np.int64) * size + y
        opened |= np.isin(node, np.unique(node[told]))
        del node
    texts = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())

    def out(n, *cols) -> pa.RecordBatch:
        held = [texts.take(pa.array(c)) for c in cols] + [pa.nulls(len(n), pa.string())] * (3 - len(cols))
        return pa.record_batch([pa.array([lang] * len(n), pa.string()), *held, pa.array(n, pa.int64())],
                               names=["lang", "w1", "w2", "w3", "n"])

    word = np.zeros(size, np.int64)
    np.add.at(word, x, n)
    last = (z == 0) & (y > 0)
    np.add.at(word, y[last], n[last])
    at = np.flatnonzero(word)
    yield out(word[at], at)
    keep = (y > 0) & ~told
    for is_open in (False, True):
        take = keep & (opened == is_open)
        a, b, c, m = distinct_rows(x[take], y[take], z[take], n[take], size)
        if not len(a):
            continue
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        edge = (c > 0) & (is_open | (m >= least))
        yield out(m[edge], a[edge], b[edge], c[edge])
        # what stays behind at the node: piece ends and light edges
        starts = np.flatnonzero(first)
        rest = np.add.reduceat(np.where(edge, 0, m), starts)
        need = (rest > 0) & (is_open | (rest >= least) | np.logical_or.reduceat(edge, starts))
        yield out(rest[need], a[starts][need], b[starts][need])


def flows(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """Step 2: (lang, w1, w2, w3, n). Rows with three words are edges, with two
    the rest of a node's flow, with one the flow of a word; to be added up, as
    words, and the nodes with very many successors, come from many buckets.
    Other nodes and edges are whole; of those, nodes and edges that cannot
    reach ``least`` are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, _Bucket()
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                if (row["bucket"], row["lang"]) != key:
                    if key:
                        yield from _flows_of(key[1], held, least)
                    key, held = (row["bucket"], row["lang"]), _Bucket()
                held.add(row)
        if key:
            yield from _flows_of(key[1], held, least)

    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(run, FLOW)


# ---------------------------------------------------------------------------
# compaction
# ---------------------------------------------------------------------------

def _resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over (id, at, pos, done): rows whose chain ends, and
    those of cycles. A round that closes nothing leaves cycles only, as each
    open row of a chain has rows nearer its head that the round would close."""
    rows, before = stage(rows, "path-round"), -1
    while (still := rows.filter("not done").count()) not in (0, before):
        before = still
        to = rows.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("pos").alias("more"), F.col("done").alias("end"))
        met = (rows.filter("not done").join(to, "at")
               .select("id", F.col("to").alias("at"), (F.col("pos") + F.col("more")).alias("pos"), F.col("end").alias("done")))
        rows = stage(rows.filter("done").unionByName(met), "path-round")
    return rows.filter("done"), rows.filter("not done")


def unary_paths(edges: DataFrame) -> DataFrame:
    """Step 3: ``edges`` (with a number ``id`` of its own for each) with
    ``path``, the id of the first edge of its unary path, and ``pos``, its place
    on it from 0. A cycle of unary nodes is cut before its least id."""
    into = edges.groupBy("lang", F.col("w2").alias("a"), F.col("w3").alias("b")).agg(F.count("*").alias("k"), F.max("id").alias("at"))
    out = edges.groupBy("lang", F.col("w1").alias("a"), F.col("w2").alias("b")).agg(F.count("*").alias("k"), F.max("id").alias("id"))
    links = stage(into.filter("k = 1").drop("k").join(out.filter("k = 1").drop("k"), ["lang", "a", "b"])
                  .filter("at <> id").select("id", "at"), "path-links")
    start = (edges.select("id").join(links, "id", "left")
             .select("id", F.coalesce("at", "id").alias("at"), F.col("at").isNotNull().cast("long").alias("pos"),
                     F.col("at").isNull().alias("done")))
    done, cycles = _resolved(start)
    if not cycles.isEmpty():
        # the least id of what lies behind, over doubled stretches, until no row learns of a smaller one
        ring = stage(links.join(cycles.select("id"), "id", "left_semi").select("id", "at", F.least("id", "at").alias("low")), "path-ring")
        while True:
            behind = ring.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("low").alias("lower"))
            now = stage(ring.join(behind, "at").select("id", F.col("to").alias("at"), F.least("low", "lower").alias("low"),
                                                       (F.col("lower") < F.col("low")).alias("new")), "path-ring")
            ring = now.drop("new")
            if now.filter("new").isEmpty():
                break
        cut = links.join(ring.select("id", "low"), "id").select(
            "id", F.when(F.col("id") == F.col("low"), F.col("id")).otherwise(F.col("at")).alias("at"),
            (F.col("id") != F.col("low")).cast("long").alias("pos"), (F.col("id") == F.col("low")).alias("done"))
        done = done.unionByName(_resolved(cut)[0])
    return edges.join(done.select("id", F.col("at").alias("path"), "pos"), "id")


# ---------------------------------------------------------------------------
# counts, scores, ranks
# ---------------------------------------------------------------------------

def floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    big = [c.cast("decimal(19,0)") for c in (a, left, right)]
    made = F.call_function("div", big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)"), big[1] * big[2])
    return made.cast("long")


def phrase_counts(docs: DataFrame, least: int, buckets: int | None = None, hot: int = HOT,
                  room: int = ROOM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, nodes, paths): the flow ``n`` of every word per language; of
    every two-word gram of at least ``least``, with ``longer``, the count of the
    most frequent edge that holds it (0: none reaches ``least``); and the edges
    of at least ``least`` with their place on unary paths."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES + 1)
    flow = stage(flows(edge_blocks(docs, buckets, hot, room), buckets, least), "phrase-flows")
    words = stage(flow.filter("w2 is null").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "phrase-words")
    edges = stage(flow.filter("w3 is not null").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
                  .withColumn("id", F.monotonically_increasing_id()), "phrase-edges")
    light = edges.filter(F.col("n") < least).select("lang", "w1", "w2", "n")
    rest = flow.filter("w2 is not null and w3 is null").select("lang", "w1", "w2", "n").unionByName(light)

    by_place = Window.partitionBy("path").orderBy("pos")
    paths = stage(unary_paths(edges.filter(F.col("n") >= least))
                  .withColumn("before", F.lag("n").over(by_place))
                  .withColumn("last", F.lead("id").over(by_place).isNull()), "phrase-paths")
    # on a path a node has one edge out; elsewhere its branches begin
    inner = paths.filter("pos > 0").select("lang", "w1", "w2", "n", F.greatest("before", "n").alias("longer"))
    first = paths.filter("pos = 0").select("lang", "w1", "w2", "n", F.col("n").alias("longer"))
    ends = paths.filter("last").select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(0).cast("long").alias("n"),
                                       F.col("n").alias("longer"))
    none = rest.withColumn("longer", F.lit(0).cast("long"))
    nodes = stage(inner.unionByName(first).unionByName(ends).unionByName(none).groupBy("lang", "w1", "w2")
                  .agg(F.sum("n").alias("n"), F.max("longer").alias("longer")).filter(F.col("n") >= least), "phrase-nodes")
    return words, nodes, paths


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, limit: int = 2000, **how) -> DataFrame:
    """Per language its best ``limit`` phrases of two and three words: lang,
    rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count within pieces, ``l`` and ``r`` those of the two
    parts of its lowest-scoring cut, ``n`` the language's words. Phrases below
    ``least`` are no candidates; a two-word one goes if a candidate that holds
    it has at least ``inside_percent`` of its count. Null texts are empty, a
    null lang is ``und``; repeated rows count each time; other columns are not
    looked at; ties by count, then by the phrase's bytes. A table without words
    gives no row.
    """
    words, nodes, paths = phrase_counts(docs, least, **how)
    often = words.filter(F.col("n") >= least)  # every word of a candidate is

    def of_word(name: str, word: str) -> DataFrame:
        return often.select("lang", F.col("w1").alias(word), F.col("n").alias(name))

    def of_node(name: str, w1: str, w2: str) -> DataFrame:
        return nodes.select("lang", F.col("w1").alias(w1), F.col("w2").alias(w2), F.col("n").alias(name))

    two = (nodes.filter(F.col("longer") * 100 < F.col("n") * inside_percent)
           .join(of_word("f1", "w1"), ["lang", "w1"]).join(of_word("f2", "w2"), ["lang", "w2"])
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"),
                   F.col("f1").alias("l"), F.col("f2").alias("r"),
                   floor_score(F.col("n"), F.col("f1"), F.col("f2")).alias("score")))
    three = (paths.select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
             .join(of_word("f1", "w1"), ["lang", "w1"]).join(of_node("f23", "w2", "w3"), ["lang", "w2", "w3"])
             .join(of_node("f12", "w1", "w2"), ["lang", "w1", "w2"]).join(of_word("f3", "w3"), ["lang", "w3"])
             .withColumn("s1", floor_score(F.col("a"), F.col("f1"), F.col("f23")))
             .withColumn("s2", floor_score(F.col("a"), F.col("f12"), F.col("f3")))
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                     F.when(F.expr("s1 <= s2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
                     F.when(F.expr("s1 <= s2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
                     F.least("s1", "s2").alias("score")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = two.unionByName(three).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
