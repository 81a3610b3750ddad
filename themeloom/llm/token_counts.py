"""Token counts through a digest cache.

The cache is a Parquet table ``(tokenizer, digest, n_tokens)`` in a folder the
caller names. A text's digest covers its white-space normalised form, which no
vocabulary that drops white space can tell from the text itself; ``tokenizer``
is the digest of the vocabulary file and library version. Digests of the corpus
are joined to the stored counts; of each digest without one a single document
is encoded, and the new counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm import tokens
from themeloom.llm.common import small_batches, stage, text_hash, text_or_empty, utf8

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def content_digest(text: Column, collapse: bool) -> Column:
    """SHA-256 of the text; ``collapse`` turns white-space runs into one space
    and strips both ends first."""
    if collapse:
        runs = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
        text = F.btrim(F.regexp_replace(text, runs, " "))
    return F.unhex(F.sha2(text, 256))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in small_batches(batches):
            texts, want, seen = utf8(b, "text"), b.column(b.schema.get_field_index("digest")).to_pylist(), {}
            for t, d in zip(texts, want):
                if hashlib.sha256(b" ".join(t.split()) if enc.by_word else t).digest() == d:
                    seen.setdefault(d, t)
            counts = [len(x) // 4 for x in enc.ids(list(seen.values()))]
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(counts, pa.int64())],
                                  names=["digest", "n_tokens"])
    return run


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` must be readable on every executor (it is part of the
    environment). A null text counts as empty; repeated rows and null ids each
    give a row; columns other than doc_id and text are not looked at. Counts
    are those of the whole text without added special tokens.
    """
    spark = docs.sparkSession
    version = "v" + tokens.tokenizer_version(tokenizer_path)
    by_word = tokens.encoder(tokenizer_path).by_word
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = stage(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                              text_hash().alias("h"), content_digest(F.col("text"), by_word).alias("digest")), "token-digests")
    # an append without rows makes a new cache readable
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = _stored(spark, cache_path, version)
    # one row per digest, found again by id and text, so that rows without an id do not all meet
    missing = (keyed.groupBy("digest").agg(F.min("h").alias("h"), F.min_by("doc_id", "h").alias("doc_id"))
               .join(stored, "digest", "left_anti"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.h") == F.col("m.h"))
    texts = (docs.withColumn("h", text_hash()).alias("d").join(missing.alias("m").hint("shuffle_hash"), same)
             .select("d.text", "m.digest"))
    fresh = (texts.mapInArrow(_encoded(tokenizer_path), "digest binary, n_tokens bigint")
             .dropDuplicates(["digest"]))
    (fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    # written once more, so that the join reads both sides from files and Spark
    # may split the tasks of a text with very many copies
    counts = stage(_stored(spark, cache_path, version), "token-counts")
    return (keyed.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def _stored(spark, cache_path: str, version: str) -> DataFrame:
    # a job that died between its append and its answer may append a digest twice
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
            .filter(F.col("tokenizer") == version).dropDuplicates(["digest"]).select("digest", "n_tokens"))
