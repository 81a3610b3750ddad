"""Line deduplication: lines found in many documents go from all of them.

Each document is split at line feeds. The key of a line is the line without
ASCII white space at its ends and with A-Z in lower case; a 128-bit hash stands
for it. The distinct keys of every document are written once as narrow rows,
counted (partial sums first, so a very common line costs one row per task), and
joined with the keys over the threshold. Texts move once, to meet the keys that
their document loses, and are rebuilt in line order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from themeloom.llm.common import small_batches, stage, text_hash, utf8


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows, keys = [], []
            for i, text in enumerate(utf8(b, "text")):
                found = {k for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars
                         and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)}
                rows += [i] * len(found)
                keys += [xxhash.xxh3_128_digest(k) for k in found]
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column(b.schema.get_field_index(c)).take(at) for c in ("doc_id", "text_hash")]
                                  + [pa.array(keys, pa.binary())], names=["doc_id", "text_hash", "line"])
    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        lost = b.column(b.schema.get_field_index("__lost")).to_pylist()
        texts, n, gone = [], [], []
        for text, out in zip(utf8(b, "text"), lost):
            lines = text.split(b"\n")
            n.append(len(lines))
            if out:
                out = set(out)
                # the same 128-bit keys as above; an empty key is never listed
                lines = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in out]
            gone.append(n[-1] - len(lines))
            texts.append(b"\n".join(lines).decode("utf-8", "replace"))
        keep = [c for c in b.schema.names if c != "__lost"]
        cols = [pa.array(texts, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in keep]
        yield pa.record_batch(cols + [pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                              names=keep + ["__n_lines", "__n_dropped"])


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt, plus ``__n_lines`` (before)
    and ``__n_dropped``.

    A line goes if its key has ``min_chars`` code points at least and stands in
    ``min_docs`` documents at least. Every row is a document, repeated rows and
    null ids too. A null or empty text is one empty line and comes back empty.
    """
    docs = docs.withColumn("__hash", text_hash())
    keyed = stage(docs.select("doc_id", F.col("__hash").alias("text_hash"), "text")
                  .mapInArrow(_keys(min_chars), "doc_id bigint, text_hash bigint, line binary"), "line-keys")
    common = stage(keyed.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
                   .select("line"), "common-lines")
    lost = (keyed.join(common, "line").groupBy("doc_id", "text_hash")
            .agg(F.collect_set("line").alias("__lost"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text_hash"), "__lost"))
    joined = (docs.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id"))
                        & (F.col("__hash") == F.col("__text_hash")), "left")
              .drop("__id", "__text_hash", "__hash"))
    schema = (StructType([f for f in docs.schema if f.name != "__hash"])
              .add("__n_lines", LongType()).add("__n_dropped", LongType()))
    return joined.mapInArrow(_rebuild, schema)
