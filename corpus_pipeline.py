"""The training-data pipeline: documents in, packed sequences out.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which ``run`` writes as Parquet into the shared folder
and reads again as the next stage's ``docs``. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import line_dedup, mixing, ngram_dedup, packing, quality_rules
from themeloom.llm.common import stage
from themeloom.llm.queries import TOKENIZER
from themeloom.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the calibrated forests reject go."""
    ship_package(spark)
    return quality_rules.keep_passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; ``n_chars`` follows the new text."""
    ship_package(spark)
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    size = F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    ship_package(spark)
    return ngram_dedup.keep_one_per_group(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship_package(spark)
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, with their token ids."""
    ship_package(spark)
    pieces = packing.pack_documents(docs, TOKENIZER, end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("source_mix", mixing_stage),
    ("retrieval_packing", packing_stage),
]

# isolation forests, BM25 packing and the tokenizer are beyond SQL; tests/llm
# compares every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
