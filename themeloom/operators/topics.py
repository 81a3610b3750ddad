"""Topic modelling as DataFrame jobs.

The reference hands this to one single-machine library object (reduce with
a manifold method, cluster by density, describe with class-based TF-IDF).
Here every stage is a Spark job with the same contract; labels are a re-aim,
not label-identical:

* T1 / T14  -- ``ml.feature.PCA`` on unit vectors (distributed fit).
* T2        -- density clustering: exact similarity edges over a threshold
               (:func:`themeloom.operators.similarity.similarity_edges`), then
               connected components, or the leaves of the single-linkage tree
               (:mod:`themeloom.operators.linkage`); groups below the minimum
               size are noise ``-1``.
* T3        -- membership probability from nearest-neighbour distances.
* T4-T7     -- vocabulary, c-TF-IDF, keywords and names, counted over
               topics-as-documents with partial aggregation.
* T10-T13   -- representative documents, topic reduction, nearest-centroid and
               zero-shot assignment.
* T16       -- convex hulls per group in two phases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import vectors as vx
from themeloom.operators import linkage, similarity
from themeloom.operators.components import connected_components
from themeloom.session import stage

# Spark's default English stop word list (StopWordsRemover,
# "english"), in its own order. Kept as text so the SQL oracle can use it.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now i'll "
    "you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

# A word is a maximal run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"

#: Words that a task counts at a time, about.
TASK_WORDS = 1 << 22
#: Terms with a weight for which the filter that goes to every task has a byte; with more it lets more other terms pass.
SHIPPED_TERMS = 1 << 26
#: The filter is made in so many slices.
FILTER_SLICES = 16
#: Bytes of text whose terms meet in one task (some 30 times as many in memory).
MEETING_BYTES = 8 << 20
#: Weights of one bin differ by a factor of e ** (1 / WEIGHT_BINS) at most.
WEIGHT_BINS = 16


# ---------------------------------------------------------------------------
# vectors
# ---------------------------------------------------------------------------

def centroids(df: DataFrame, group: str, vec: str = "embedding", name: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group (``Summarizer``: JVM-side, with
    partial aggregation, so a huge group is combined map-side)."""
    v = df.filter(F.col(vec).isNotNull()).select(group, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    m = v.groupBy(group).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select(group, vector_to_array("_m").alias(name))


def reduce_dimensions(df: DataFrame, k: int, vec: str = "embedding", out: str = "reduced",
                      n_rows: int | None = None) -> tuple[DataFrame, object]:
    """Unit-normalise then PCA to ``k`` dimensions, ``k`` clamped to
    ``min(k, n - 2, width)`` up front (the reference relied on a caught
    exception for small corpora)."""
    width = len(df.select(vec).first()[0])
    n = n_rows if n_rows is not None else df.count()
    k = max(1, min(k, n - 2, width))
    v = df.withColumn("_v", array_to_vector(vx.l2_normalize(vec)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p"), model


def project_2d(df: DataFrame, vec: str = "embedding", id_col: str = "row_id") -> DataFrame:
    """2-D coordinates ``x, y`` for plotting (PCA, deterministic). The
    sign of each axis is fixed so its largest-magnitude loading is positive."""
    v = df.withColumn("_v", array_to_vector(vx.l2_normalize(vec)))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    pc = model.pc.toArray()  # width x 2, small
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(v).withColumn("_a", vector_to_array("_p"))
    return out.withColumn("x", F.col("_a")[0] * signs[0]).withColumn("y", F.col("_a")[1] * signs[1]) \
        .drop("_v", "_p", "_a")


# ---------------------------------------------------------------------------
# Density clustering
# ---------------------------------------------------------------------------

def density_clusters(vectors: DataFrame, threshold: float, min_size: int, id_col: str = "row_id",
                     vec: str = "embedding", block_rows: int = 1024, select: str = "components") -> tuple[DataFrame, DataFrame]:
    """``(assignments(row_id, topic), edges)``.

    Edges join vectors whose cosine is ``>= threshold``; each connected
    component of at least ``min_size`` members is a topic, the rest is noise
    ``-1``. Topics are numbered 0.. by size (descending), ties by smallest id.
    Fewer rows than ``min_size`` -> all noise. Of the edges those that span
    the components are returned, every row's best one among them.

    With ``select="leaves"`` the threshold is only the lowest of a sweep: a
    topic is one of the finest groups of at least ``min_size``, as they stand
    before they meet another one (``linkage.leaf_groups``), so that single links
    between groups do not chain them together.
    """
    if select not in ("components", "leaves"):
        raise ValueError(f"select: {select}")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    edges = stage(similarity.similarity_edges(v, threshold, "id", "v", block_rows, forest=True), "similarity-edges")
    if select == "leaves":
        leaves = stage(linkage.leaf_groups(edges, min_size), "leaf-groups")
        least = leaves.groupBy("leaf").agg(F.min("id").alias("label"))
        comp = stage(v.select("id").join(leaves.join(least, "leaf").select("id", "label"), "id", "left"), "leaf-labels")
    else:
        comp = connected_components(v.select("id"), edges, "id")
    sizes = comp.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.filter((F.col("size") >= min_size) & F.col("label").isNotNull())
    # numbering over the (few) surviving components; one window over a small table
    num = big.withColumn("topic", (F.row_number().over(Window.orderBy(F.col("size").desc(), F.col("label"))) - 1)
                         .cast("int"))
    out = comp.join(num.select("label", "topic"), "label", "left").select(
        F.col("id").alias(id_col), F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"))
    return out, edges


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "similarity")
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))


def _core_distances(assign: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """``(id, topic, core)``: 1 - best similarity to another member of the
    same topic (null for noise and for members without such an edge)."""
    a = assign.select(F.col(id_col).alias("id"), "topic")
    same = (_both_ways(edges).join(a.withColumnRenamed("id", "x").withColumnRenamed("topic", "tx"), "x")
            .join(a.withColumnRenamed("id", "y").withColumnRenamed("topic", "ty"), "y")
            .filter((F.col("tx") == F.col("ty")) & (F.col("tx") != -1)))
    core = same.groupBy(F.col("x").alias("id")).agg((1 - F.max("similarity")).alias("core"))
    return a.join(core, "id", "left")


def _ratio(tmin: Column, d: Column) -> Column:
    return F.when(d <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tmin / d))


def membership_probability(assign: DataFrame, edges: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Probability of each document for its own topic, in [0, 1].

    A member's core distance is ``1 - (its best similarity to another member
    of its topic)``; probability = ``min(1, smallest core distance in the
    topic / own core distance)``. The densest members reach exactly 1.0
    (W4's first branch needs that); noise gets 0.
    """
    m = _core_distances(assign, edges, id_col)
    tmin = m.groupBy("topic").agg(F.min("core").alias("tmin"))
    return m.join(tmin, "topic", "left").select(
        F.col("id").alias(id_col), "topic",
        F.when(F.col("topic") == -1, F.lit(0.0)).otherwise(F.coalesce(_ratio(F.col("tmin"), F.col("core")), F.lit(0.0)))
        .cast("double").alias("probability"))


def probability_vectors(assign: DataFrame, edges: DataFrame, id_col: str = "row_id") -> DataFrame:
    """T3 (vector form): ``probabilities ARRAY<DOUBLE>`` per document, one
    slot per topic 0..k-1: ``min(1, topic's smallest core distance / (1 -
    best similarity to that topic's members))``, 0 without any edge. Only
    edges (pairs over the threshold) are read, never all pairs."""
    a = assign.select(F.col(id_col).alias("id"), "topic")
    tmin = _core_distances(assign, edges, id_col).groupBy("topic").agg(F.min("core").alias("tmin"))
    to_topic = (_both_ways(edges).join(a.withColumnRenamed("id", "y").withColumnRenamed("topic", "ty"), "y")
                .filter(F.col("ty") != -1)
                .groupBy("x", "ty").agg((1 - F.max("similarity")).alias("d")))
    per = (to_topic.join(tmin, to_topic.ty == tmin.topic)
           .select(F.col("x").alias("id"), F.col("ty").alias("t"), _ratio(F.col("tmin"), F.col("d")).alias("pv")))
    vecs = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "pv"))).alias("m"))
    last = assign.agg(F.max("topic")).first()[0]  # one number, read on the driver
    k = 0 if last is None else last + 1
    return a.join(vecs, "id", "left").select(
        F.col("id").alias(id_col),
        (F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
         if k > 0 else F.array().cast("array<double>")).alias("probabilities"))


# ---------------------------------------------------------------------------
# Vocabulary, c-TF-IDF, keywords, names
# ---------------------------------------------------------------------------

def _words(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``keys`` and the lower-cased words (2+ letters or digits) of each text: as
    ``_words``, or for an ASCII text as ``_text``, which the tasks split."""
    plain = F.octet_length(text_col) == F.length(text_col)
    return df.select(*keys, F.when(plain, F.col(text_col)).alias("_text"),
                     F.when(~plain, F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), 0)).alias("_words"))


#: ASCII letters, digits and underscores, in lower case; a space for every other byte.
PLAIN_BYTES = np.array([ord(c.lower()) if c.isalnum() or c == "_" else 32 for c in map(chr, range(128))] + [32] * 128, np.uint8)


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """(place, words): the words of the batch's row at each place. Some of ASCII
    texts are shorter than two letters: ``_terms_of`` leaves them out."""
    plain = batch["_text"].is_valid().to_numpy(zero_copy_only=False)
    texts = batch["_text"].filter(pa.array(plain)).cast(pa.string())
    words = batch["_words"].filter(pa.array(~plain)).cast(pa.list_(pa.string()))
    _, ends, data = texts.buffers()
    if len(texts) and data is not None:
        lower = pa.py_buffer(PLAIN_BYTES[np.frombuffer(data, np.uint8)])
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), ends, lower, offset=texts.offset))
        words = pa.concat_arrays([split.cast(words.type), words])
        return np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), words
    return np.flatnonzero(~plain), words


class _Terms:
    """The terms of ``n`` words in some rows' texts: (row, head, last) of each, by
    the code of its first ``n - 1`` words and that of its last one."""

    def __init__(self, row, head, last, heads, head_hash, names, name_hash):
        self.row, self.head, self.last = row, head, last
        self.heads, self.head_hash, self.names, self.name_hash = heads, head_hash, names, name_hash
        self.shape = 1 if heads is None else len(heads), len(names)

    def counts(self, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """(group, head, last, n) of each term and group of rows."""
        n_heads, n_names = self.shape
        found, n = np.unique((group[self.row] * n_heads + self.head) * n_names + self.last, return_counts=True)
        rest, last = np.divmod(found, n_names)
        return *np.divmod(rest, n_heads), last, n

    def hashes(self, head: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of each term, which follows from its words."""
        return self.name_hash[last] if self.heads is None else self.head_hash[head] * NEXT_WORD + self.name_hash[last]

    def texts(self, head: np.ndarray, last: np.ndarray) -> pa.Array:
        words = self.names.take(pa.array(last))
        return words if self.heads is None else pc.binary_join_element_wise(self.heads.take(pa.array(head)), words, " ")


def _terms_of(words: pa.Array, ngram_range, stop: pa.Array) -> Iterator[_Terms]:
    """For each n the terms of the rows' words. Stop words go first, then words
    that are left are joined by a space."""
    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    word, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    left = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 1) & ~pc.is_in(names, value_set=stop).to_numpy(zero_copy_only=False)
    row, word = row[left[word]], word[left[word]]
    if not len(word):
        return
    of_word = pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False)
    made = _Terms(row, np.zeros(len(row), np.int64), word, None, None, names, of_word)
    place = np.arange(len(row))
    for n in range(1, ngram_range[1] + 1):
        if n > 1:
            if n == 2:
                heads, hashes, code = names, of_word, word
            else:  # the terms before this one, numbered
                pairs, code = np.unique(made.head * len(names) + made.last, return_inverse=True)
                head, last = np.divmod(pairs, len(names))
                heads, hashes = made.texts(head, last), made.hashes(head, last)
            full = np.full(len(row), -1)
            full[place] = code
            place = np.flatnonzero(row[:max(len(row) - n + 1, 0)] == row[n - 1:])
            made = _Terms(row[place], full[place], word[place + n - 1], heads, hashes, names, of_word)
        if n >= ngram_range[0]:
            yield made


#: What a term's hash is multiplied by for each word that follows, and for its place among the filter's bits.
NEXT_WORD, FILTER_PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hash_of(terms: pa.Array) -> np.ndarray:
    """The hashes that ``_Terms.hashes`` gives for these terms."""
    words = pc.split_pattern(terms, " ")
    flat = words.flatten().dictionary_encode()
    of_word = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False), categorize=False)[flat.indices.to_numpy(zero_copy_only=False)]
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = of_word[start]
    for k in range(1, size.max(initial=0)):
        more = size > k
        out[more] = out[more] * NEXT_WORD + of_word[start[more] + k]
    return out


def _bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Each term's place among ``1 << bits``."""
    return (hashes * FILTER_PLACE) >> np.uint64(64 - bits)


def _term_filter(terms: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, bytes): a bit is set where one of the ``n`` terms has its place; eight
    to sixteen bits a term, for ``SHIPPED_TERMS`` at most. Slices are set in tasks of their own."""
    bits = max((8 * min(n, SHIPPED_TERMS)).bit_length(), (8 * FILTER_SLICES).bit_length() - 1)
    slice_bits = (1 << bits) // FILTER_SLICES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits_of(_hash_of(b["term"]), bits)).astype(np.int64)
            part, place = np.divmod(at, slice_bits)
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts], pa.int32()),
                 pa.array([place[i:j].astype(np.uint32).tobytes() for i, j in zip(starts, [*starts[1:], len(part)])], pa.binary())], names=["slice", "data"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for k, x in zip(b["slice"].to_pylist(), b["data"]):
                held.setdefault(k, np.zeros(slice_bits, bool))[np.frombuffer(x.as_buffer(), np.uint32)] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["slice", "data"])

    out = np.zeros((FILTER_SLICES, slice_bits // 8), np.uint8)
    rows = terms.select("term").mapInArrow(placed, "slice int, data binary").repartitionById(FILTER_SLICES, "slice")
    for r in rows.mapInArrow(merged, "slice int, data binary").collect():  # two bytes per shipped term at most
        out[r["slice"]] = np.frombuffer(r["data"], np.uint8)
    return bits, out.ravel()


def _may_be_in(found: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """True for all terms of the filter and a few others."""
    bits, data = found
    at = _bits_of(hashes, bits)
    return (data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _term_counts(words: DataFrame, keys: list[str], by_row: bool, ngram_range, stop_words, found=None, buckets: int = 0) -> DataFrame:
    """``(keys, term, n)``: terms counted per row, or per value of the one key
    and batch of rows. Of terms that are not in ``found`` (a broadcast filter)
    nearly all are left out.

    With ``buckets`` these rows come as blocks ``(bucket, data)``, an Arrow stream
    for each batch and bucket; all rows of a term are in one bucket. A block
    moves as one row, which spares a shuffle the work on each term."""
    stop = pa.array([w.lower() for w in (ENGLISH_STOP_WORDS if stop_words is None else stop_words)], pa.string())
    kept = T.StructType([words.schema[k] for k in keys] + [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (pc.fill_null(pc.list_value_length(batch["_words"]), 0).to_numpy(zero_copy_only=False)
                    + pc.fill_null(pc.binary_length(batch["_text"]), 0).to_numpy(zero_copy_only=False) // 6)
            cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // TASK_WORDS)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
                yield from counted(batch.slice(start, end - start))

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if by_row:
            group, values = np.arange(len(batch)), [batch[k] for k in keys]
        else:
            value = batch[keys[0]].dictionary_encode(null_encoding="encode")
            group, values = value.indices.to_numpy(zero_copy_only=False).astype(np.int64), [value.dictionary]
        place, words = _split(batch)
        group = group[place]
        for terms in _terms_of(words, ngram_range, stop):
            at, head, last, n = terms.counts(group)
            if found is not None:
                left = _may_be_in(found.value, terms.hashes(head, last))
                at, head, last, n = at[left], head[left], last[left], n[left]

            def rows(some) -> pa.RecordBatch:
                columns = [v.take(pa.array(at[some])) for v in values] + [terms.texts(head[some], last[some]), pa.array(n[some], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=kept.names)

            if buckets:
                yield from _blocks(rows, (terms.hashes(head, last) % np.uint64(buckets)).astype(np.int64))
            else:
                for i in range(0, len(n), 1 << 18):
                    yield rows(slice(i, i + (1 << 18)))

    return words.mapInArrow(run, "bucket int, data binary" if buckets else kept)


def _blocks(rows, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block for each bucket of the rows that ``rows`` gives by their places."""
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        part = rows(order[start:end])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([bucket[order[start]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                         names=["bucket", "data"])


def _unblocked(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of all blocks."""
    held = [pa.ipc.open_stream(x.as_buffer()).read_all() for b in batches for x in b["data"]]
    return pa.concat_tables(held) if held else None


def _meeting_tasks(size: int | None, ngram_range) -> int:
    """In how many tasks the terms of ``size`` bytes of text meet."""
    return max(1, -(-(size or 0) * (ngram_range[1] - ngram_range[0] + 1) // (2 * MEETING_BYTES)))


def topic_term_counts(docs: DataFrame, topic_col: str = "topic", text_col: str = "text",
                      ngram_range=(1, 2), min_df: int = 2, max_df: float = 0.9,
                      stop_words=None, size: int | None = None) -> DataFrame:
    """T4: ``(topic, term, tf, f)`` over topics-as-documents, vocabulary filtered
    by topic frequency: kept when ``min_df <= n_topics_with_term <= max_df *
    n_topics``; ``f`` is the term's count over all topics. Terms are combined per
    batch of documents, and all rows of a term meet once, for both counts, in one
    of as many tasks as the bytes of text ask for; where the caller knows them
    (``size``), the texts are read once."""
    docs = docs.select(F.col(topic_col).alias("topic"), text_col)
    words = _words(docs, text_col, ["topic"])
    if size is None:
        sizes = docs.groupBy("topic").agg(F.sum(F.octet_length(text_col).cast("long")).alias("size"))
        n_topics, size = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    else:
        n_topics = docs.select("topic").distinct().count()
    tasks = _meeting_tasks(size, ngram_range)
    blocks = _term_counts(words, ["topic"], False, ngram_range, stop_words, buckets=tasks).repartitionById(tasks, "bucket")
    return stage(_kept_terms(blocks, words.schema["topic"], min_df, max_df * n_topics), "topic-vocabulary")


def _kept_terms(blocks: DataFrame, topic_field: T.StructField, least: int, most: float) -> DataFrame:
    """``(topic, term, tf, f)`` of the terms that ``least`` to ``most`` topics hold;
    all blocks of a bucket are in one partition."""
    kept = T.StructType([topic_field, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("f", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unblocked(batches)
        if held is None:
            return
        topic = held["topic"].combine_chunks().dictionary_encode(null_encoding="encode")
        term, n = held["term"].combine_chunks().dictionary_encode(), held["n"].to_numpy()
        del held
        width, topics, terms = len(topic.dictionary), topic.dictionary, term.dictionary
        key = term.indices.to_numpy().astype(np.int64) * width + topic.indices.to_numpy()
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.add.reduceat(n[order], first)
        code, place = np.divmod(key[first], width)
        # every code occurs, so the n-th run of rows is that of the n-th term
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        n_t, f = np.diff(starts, append=len(code)), np.add.reduceat(tf, starts)
        at = np.flatnonzero(((n_t >= least) & (n_t <= most))[code])
        for i in range(0, len(at), 1 << 18):
            some = at[i:i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([topics.take(pa.array(place[some])), terms.take(pa.array(code[some])),
                                              pa.array(tf[some], pa.int64()), pa.array(f[code[some]], pa.int64())], names=kept.names)

    return blocks.mapInArrow(run, kept)


def ctfidf(counts: DataFrame) -> DataFrame:
    """T5: ``weight = tf / (terms in topic) * ln(1 + A / f_t)`` with ``A`` the
    integer mean of terms per topic and ``f_t`` the term's count over all
    topics (the noise topic counts as a topic). The logarithm is also returned
    as ``idf``. ``counts`` is read a few times; :func:`topic_term_counts` has
    written it, with ``f_t`` as ``f`` (else it is counted here).

    The topics' totals are written, so that Spark knows their size: under its
    threshold they go to the counts, which else would move to a task per topic."""
    per_topic = stage(counts.groupBy("topic").agg(F.sum("tf").alias("topic_total")), "topic-totals")
    a = per_topic.agg(F.floor(F.avg("topic_total"))).first()[0] or 0  # one number
    if "f" not in counts.columns:
        counts = counts.join(counts.groupBy("term").agg(F.sum("tf").alias("f")), "term")
    return (counts.withColumn("idf", F.ln(1 + F.lit(a) / F.col("f"))).join(per_topic, "topic")
            .select("topic", "term", "tf", (F.col("tf") / F.col("topic_total") * F.col("idf")).alias("weight"), "idf"))


def _weight_bin(weight: Column) -> Column:
    """A number that does not fall as the weight rises: first null, then all up to 0, last infinity and NaN."""
    return (F.when(weight.isNull(), F.lit(-(1 << 41))).when(F.isnan(weight) | (weight == float("inf")), F.lit(1 << 40))
            .when(weight <= 0, F.lit(-(1 << 40))).otherwise(F.floor(F.ln(weight) * WEIGHT_BINS)).cast("long"))


def _leading_terms(weights: DataFrame, n: int) -> DataFrame:
    """The terms of each topic's highest bins of weights that hold ``n``: those
    of the first ``n`` are among them. Terms are counted per topic and bin."""
    at = _weight_bin(F.col("weight").cast("double"))
    bins = weights.select("topic", at.alias("bin")).groupBy("topic", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("topic").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = bins.withColumn("n", F.sum("n").over(down)).groupBy(F.col("topic").alias("_topic")).agg(
        F.coalesce(F.max(F.when(F.col("n") >= n, F.col("bin"))), F.min("bin")).alias("_last"))
    last = stage(last, "topic-bins")  # a row per topic, of a size that Spark knows
    return weights.join(last, F.col("topic").eqNullSafe(F.col("_topic")) & (at >= F.col("_last"))).drop("_topic", "_last")


def top_keywords(weights: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest-weight terms per topic (ties by term). ``weights`` is
    read twice, and only the terms that may be among the first are sorted."""
    w = Window.partitionBy("topic").orderBy(F.col("weight").desc(), F.col("term"))
    return (_leading_terms(weights, n).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))


def topic_names(keywords: DataFrame, n_words: int = 4) -> DataFrame:
    """``{topic}_{w1}_{w2}_{w3}_{w4}``; also the ordered keyword list."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    g = keywords.groupBy("topic").agg(F.transform(pairs, lambda x: x["term"]).alias("keywords"))
    return g.select("topic", "keywords", F.concat_ws("_", F.col("topic").cast("string"),
                                                     F.slice("keywords", 1, n_words)).alias("Name"))


def _weight_blocks(weights: DataFrame, buckets: int) -> DataFrame:
    """The weights as blocks ``(bucket, data)``, in the bucket of their term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _blocks(lambda some, b=b: b.take(pa.array(some)), (_hash_of(b["term"]) % np.uint64(buckets)).astype(np.int64))

    return weights.mapInArrow(run, "bucket int, data binary")


def _document_sums(blocks: DataFrame, id_field: T.StructField, topic_field: T.StructField) -> DataFrame:
    """``(id, topic, dotw, dn2)`` of each bucket: what its terms add to the product
    of a document with its topic's weights, and to the square of its length. All
    blocks of a bucket are in one partition; rows of one document add up first."""
    out = T.StructType([id_field, topic_field, T.StructField("dotw", T.DoubleType()), T.StructField("dn2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for b in batches for x in b["data"]]
        w, d = ([p for p in parts if ("weight" in p.column_names) == side] for side in (True, False))
        if not w or not d:
            return
        w, d = pa.concat_tables(w), pa.concat_tables(d)
        w, d = w.filter(w["topic"].is_valid()), d.filter(d["topic"].is_valid())
        term, topic = (pa.chunked_array(w[c].chunks + d[c].chunks).combine_chunks().dictionary_encode() for c in ("term", "topic"))
        key = term.indices.to_numpy().astype(np.int64) * max(1, len(topic.dictionary)) + topic.indices.to_numpy()
        of_w, of_d = key[:len(w)], key[len(w):]
        if not len(of_w) or not len(of_d):
            return
        order = np.argsort(of_w)
        place = np.searchsorted(of_w[order], of_d)
        met = np.flatnonzero(of_w[order][np.minimum(place, len(order) - 1)] == of_d)
        doc = d["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        # rows of one document and term
        pair, row = np.unique(doc.indices.to_numpy().astype(np.int64)[met] * len(order) + place[met], return_inverse=True)
        c = np.bincount(row, d["n"].to_numpy()[met], len(pair))
        at, of = pair // len(order), order[pair % len(order)]
        idf, weight = w["idf"].to_numpy()[of], w["weight"].to_numpy()[of]
        group, row = np.unique(at * len(topic.dictionary) + topic.indices.to_numpy()[of], return_inverse=True)
        dotw, dn2 = np.bincount(row, c * idf * weight, len(group)), np.bincount(row, (c * idf) ** 2, len(group))
        at, of = np.divmod(group, len(topic.dictionary))
        for i in range(0, len(group), 1 << 18):
            some = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_arrays([doc.dictionary.take(pa.array(at[some])), topic.dictionary.take(pa.array(of[some])),
                                              pa.array(dotw[some]), pa.array(dn2[some])], names=out.names)

    return blocks.mapInArrow(run, out)


def representative_docs(docs: DataFrame, weights: DataFrame, n: int = 3, topic_col: str = "topic",
                        id_col: str = "row_id", text_col: str = "text", ngram_range=(1, 2),
                        stop_words=None) -> DataFrame:
    """Per topic, the ``n`` documents nearest (cosine) to the topic's
    c-TF-IDF vector. A document's own vector is term count times idf; the
    sparse dot product is a join on (topic, term) and a per-document sum;
    similarities are compared at 9 decimals, ties by id.

    Documents' terms that surely have no weight (most: they are in one topic, or
    in all) are left out in the tasks that count them. The others move as blocks
    to buckets of terms, as the weights do, and each bucket adds up its part of
    every document's sums."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(topic_col).alias("topic"), text_col)
    weights = stage(weights.select("topic", "term", "weight", "idf"), "topic-weights")
    spark = docs.sparkSession
    found = spark.sparkContext.broadcast(_term_filter(weights, weights.count()))
    buckets = _meeting_tasks(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0], ngram_range)
    words = _words(docs, text_col, ["id", "topic"])
    blocks = _term_counts(words, ["id", "topic"], True, ngram_range, stop_words, found, buckets)
    both = blocks.unionByName(_weight_blocks(weights, buckets)).repartitionById(buckets, "bucket")
    sums = _document_sums(both, words.schema["id"], words.schema["topic"])
    tnorm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("tn"))
    s = sums.groupBy("id", "topic").agg(F.sum("dotw").alias("dotw"), F.sqrt(F.sum("dn2")).alias("dn"))
    s = s.join(tnorm, "topic").withColumn(
        "similarity", F.when((F.col("dn") > 0) & (F.col("tn") > 0), F.col("dotw") / (F.col("dn") * F.col("tn")))
        .otherwise(F.lit(0.0)))
    w = Window.partitionBy("topic").orderBy(F.round("similarity", 9).desc(), F.col("id"))
    return (s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("topic", F.col("id").alias(id_col), "similarity", F.col("rank").cast("bigint")))


# ---------------------------------------------------------------------------
# Reduce, assign, zero-shot
# ---------------------------------------------------------------------------

def nearest_centroid(docs: DataFrame, cents: DataFrame, floor: float = 0.0, id_col: str = "row_id",
                     vec: str = "embedding", topic_col: str = "topic", cvec: str = "centroid") -> DataFrame:
    """Each document takes its most similar centroid, or -1 below ``floor``.
    The centroids go to every task; the documents are read once, where they lie."""
    top = similarity.top_n_similar(
        docs.select(F.col(id_col).alias("_doc"), F.col(vec).alias("embedding")),
        cents.select(F.col(topic_col).cast("long").alias("_t"), F.col(cvec).alias("embedding")),
        n=1, q_id="_doc", c_id="_t", ship="candidates")
    return top.select(F.col("_doc").alias(id_col),
                      F.when(F.col("similarity") >= floor, F.col("_t").cast("int")).otherwise(F.lit(-1)).alias(topic_col),
                      F.col("similarity"))


def topic_units(assign: DataFrame, vectors: DataFrame, id_col: str = "row_id", vec: str = "embedding") -> DataFrame:
    """(g, v): each topic's centroid, noise aside, as a unit vector."""
    a = assign.filter(F.col("topic") != -1)
    cent = centroids(a.select(id_col, "topic").join(vectors.select(id_col, vec), id_col), "topic", vec)
    return cent.select(F.col("topic").cast("long").alias("g"), vx.l2_normalize("centroid").alias("v"))


def reduce_topics(assign: DataFrame, vectors: DataFrame, target: int, id_col: str = "row_id",
                  vec: str = "embedding") -> DataFrame:
    """Merge topics down to ``target`` by average linkage on the cosine
    similarity of their centroids (see ``operators/linkage.py``); new ids by
    documents, descending, ties by the least old id. Noise stays -1; topics
    without a vector merge with none. Returns ``(old_topic, topic)``: join it to
    relabel, then rebuild T4-T6."""
    units = stage(topic_units(assign, vectors, id_col, vec), "topic-units")
    groups = linkage.merged_groups(units, target)
    sizes = assign.filter(F.col("topic") != -1).groupBy(F.col("topic").cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    old = stage(sizes.join(groups, "g", "left").withColumn("group", F.coalesce("group", "g")), "topic-groups")
    # one row per remaining topic
    order = Window.orderBy(F.col("n").desc(), "group")
    new = old.groupBy("group").agg(F.sum("n").alias("n")).select("group", (F.row_number().over(order) - 1).cast("int").alias("topic"))
    noise = assign.sparkSession.range(1).select(F.lit(-1).alias("old_topic"), F.lit(-1).alias("topic"))
    return old.join(new, "group").select(F.col("g").cast("int").alias("old_topic"), "topic").unionByName(noise)


def zero_shot(docs: DataFrame, topic_vectors: DataFrame, min_similarity: float = 0.85,
              id_col: str = "row_id", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Documents whose best similarity to a user topic is at least
    ``min_similarity`` take that topic; returns ``(assigned, rest)`` where
    ``rest`` still needs clustering (T2) and fresh ids after the user topics."""
    best = nearest_centroid(docs, topic_vectors, min_similarity, id_col, vec, "topic", "centroid")
    assigned = best.filter(F.col("topic") != -1)
    rest = docs.join(assigned.select(id_col), id_col, "left_anti")
    return assigned, rest


# ---------------------------------------------------------------------------
# Convex hull per group
# ---------------------------------------------------------------------------

def _hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain; counter-clockwise, starting at the smallest (x, y)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower, upper = [], []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(tuple(p))
    for p in pts[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(tuple(p))
    return np.array(lower[:-1] + upper[:-1])


def convex_hulls(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Closed hull ring per group with an ``order`` column.

    Phase 1 keeps only each partition's local hull points per group
    (``mapInPandas``, no shuffle); phase 2 builds the final ring per group
    from those survivors (``applyInPandas``), so a huge group sends only
    hull candidates to its task. Fewer than 3 distinct points -> the points.
    """
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(x, T.DoubleType()),
                           T.StructField(y, T.DoubleType())])
    src = df.select(group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))

    def local(batches):
        for b in batches:
            outs = []
            for g, pdf in b.groupby(group, dropna=False):
                h = _hull(pdf[[x, y]].to_numpy())
                outs.append(pd.DataFrame({group: [g] * len(h), x: h[:, 0] if len(h) else [],
                                          y: h[:, 1] if len(h) else []}))
            if outs:
                yield pd.concat(outs, ignore_index=True)

    cand = src.mapInPandas(local, schema)
    out_schema = T.StructType(list(schema.fields) + [T.StructField("order", T.LongType())])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[group].iloc[0]
        h = _hull(pdf[[x, y]].to_numpy())
        if len(h) >= 3:
            h = np.vstack([h, h[:1]])  # closed ring
        return pd.DataFrame({group: [g] * len(h), x: h[:, 0], y: h[:, 1], "order": np.arange(len(h), dtype="int64")})

    return cand.groupBy(group).applyInPandas(final, out_schema)


# ---------------------------------------------------------------------------
# persistence
# ---------------------------------------------------------------------------

MODEL_PARTS = ("topics", "topic_terms", "centroids", "components")


def component_table(spark, model) -> DataFrame:
    """The reduction's matrix (T1) as rows ``(component, loadings)``."""
    pc = model.pc.toArray().T
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(pc)],
                                 "component int, loadings array<double>")


def save_topic_model(path: str, topics: DataFrame, topic_terms: DataFrame, centroids: DataFrame,
                     components: DataFrame | None = None) -> None:
    """The fitted topics as plain Parquet tables, with the reduction's
    matrix if there was one."""
    for name, part in zip(MODEL_PARTS, (topics, topic_terms, centroids, components)):
        if part is not None:
            part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_topic_model(spark, path: str, parts=MODEL_PARTS) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in parts}


def reduced_by(docs: DataFrame, components: DataFrame, vec: str = "embedding") -> DataFrame:
    """``docs`` with ``vec`` replaced by its unit vector's coordinates on the
    saved components (at most as many rows as a vector is long); null stays null."""
    rows = components.orderBy("component").collect()
    matrix = np.array([r.loadings for r in rows], np.float64)
    rest = [c for c in docs.columns if c != vec]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(vec, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            has = b[vec].notna().to_numpy()
            out: list = [None] * len(b)
            if has.any():
                for i, v in zip(np.flatnonzero(has), similarity._unit(similarity._stack(b[vec][has])) @ matrix.T):
                    out[i] = v
            yield b[rest].assign(**{vec: pd.Series(out, index=b.index, dtype=object)})

    return docs.select(*rest, F.col(vec).cast("array<double>").alias(vec)).mapInPandas(run, schema)


def apply_topic_model(model: dict[str, DataFrame], docs: DataFrame, floor: float = 0.0, id_col: str = "row_id",
                      vec: str = "embedding") -> DataFrame:
    """T17 -> T12: new documents take the topics of a loaded model: their vectors
    go through its components, where it has them (its centroids then are in that
    space), and each document takes its most similar centroid, or -1 below ``floor``."""
    if "components" in model:
        docs = reduced_by(docs.select(id_col, vec), model["components"], vec)
    cents = model["centroids"].filter(F.col("topic") != -1)
    return nearest_centroid(docs, cents, floor, id_col, vec)


# ---------------------------------------------------------------------------
# Keyword refinement with an encoder
# ---------------------------------------------------------------------------

def _candidate_vectors(weights: DataFrame, reps: DataFrame, docs: DataFrame, n_candidates: int,
                       id_col: str, text_col: str, encoder) -> tuple[DataFrame, DataFrame]:
    """Candidate terms (the ``n_candidates`` best by c-TF-IDF) with their
    embedding, and each topic's vector: the mean embedding of its
    representative documents."""
    from themeloom.operators import embed as em

    cands = top_keywords(weights, n_candidates).select("topic", "term", "weight")
    term_vecs = em.embed(cands, "term", "tvec", encoder=encoder)
    rep_docs = reps.select("topic", F.col(id_col).alias("_id")).join(
        docs.select(F.col(id_col).alias("_id"), text_col), "_id")
    rep_vecs = em.embed(rep_docs, text_col, "dvec", encoder=encoder)
    topic_vec = centroids(rep_vecs, "topic", "dvec", "topic_vec")
    return term_vecs, topic_vec


def similarity_keywords(weights: DataFrame, reps: DataFrame, docs: DataFrame, n: int = 10,
                        n_candidates: int = 30, id_col: str = "row_id", text_col: str = "text",
                        encoder=None) -> DataFrame:
    """Candidate terms re-ranked by cosine similarity (compared at 6 decimals,
    ties by term) to the topic's representative-document vector;
    ``(topic, term, similarity, rank)``."""
    term_vecs, topic_vec = _candidate_vectors(weights, reps, docs, n_candidates, id_col, text_col, encoder)
    s = term_vecs.join(topic_vec, "topic").withColumn("similarity", vx.cosine("tvec", "topic_vec"))
    w = Window.partitionBy("topic").orderBy(F.round("similarity", 6).desc(), F.col("term"))
    return (s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("topic", "term", "similarity", F.col("rank").cast("bigint")))


def diverse_keywords(weights: DataFrame, reps: DataFrame, docs: DataFrame, n: int = 10,
                     diversity: float = 0.3, n_candidates: int = 30, id_col: str = "row_id",
                     text_col: str = "text", encoder=None) -> DataFrame:
    """Maximal marginal relevance over each topic's candidates (at most
    ``n_candidates`` rows per group, so the greedy loop runs on a bounded
    pandas frame): first the term closest to the topic vector, then the term
    maximising ``(1 - diversity) * sim(term, topic) - diversity * max sim(term,
    chosen)``."""
    term_vecs, topic_vec = _candidate_vectors(weights, reps, docs, n_candidates, id_col, text_col, encoder)
    j = term_vecs.join(topic_vec, "topic").select("topic", "term", "tvec", "topic_vec")
    schema = T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("term", T.StringType()),
                           T.StructField("rank", T.LongType())])

    def mmr(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term").reset_index(drop=True)
        tv = similarity._unit(similarity._stack(pdf["tvec"]))
        dv = similarity._unit(np.asarray(pdf["topic_vec"].iloc[0], dtype=float)[None, :])
        to_doc = (tv @ dv.T)[:, 0]
        between = tv @ tv.T
        chosen = [int(np.argmax(to_doc))]
        rest = [i for i in range(len(pdf)) if i != chosen[0]]
        while rest and len(chosen) < n:
            score = (1 - diversity) * to_doc[rest] - diversity * between[np.ix_(rest, chosen)].max(axis=1)
            pick = rest[int(np.argmax(score))]
            chosen.append(pick)
            rest.remove(pick)
        return pd.DataFrame({"topic": [int(pdf["topic"].iloc[0])] * len(chosen),
                             "term": pdf["term"].iloc[chosen].tolist(),
                             "rank": np.arange(1, len(chosen) + 1, dtype="int64")})

    return j.withColumn("topic", F.col("topic").cast("int")).groupBy("topic").applyInPandas(mmr, schema)
