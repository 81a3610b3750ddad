"""One registry from logical dataset name to a stored table.

The reference keeps one getter per artefact, each with its own path lookup.
Here a dataset is a name under ``root/prefix`` whose format follows from its
suffix, so every stage can be re-started from what the previous stage wrote.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from themeloom.sources import io

# Artefacts written and read by the jobs (name -> relative path).
DEFAULT_PATHS = {
    "works_raw": "works/works_raw.parquet",
    "works_filtered": "works/works_filtered.parquet",
    "works_bm25_filtered": "works/works_bm25_filtered.parquet",
    "works_embedded": "works/works_embedded.parquet",
    "abstracts_embedded": "abstracts/abstracts_embedded.parquet",
    "answers_raw": "answers/answers_raw.jsonl",
    "answers_long": "answers/answers_long.parquet",
    "assignments": "topics/assignments.parquet",
    "topics": "topics/topics.parquet",
    "topic_terms": "topics/topic_terms.parquet",
    "centroids": "topics/centroids.parquet",
    "summaries": "topics/summaries.json",
    "topic_summaries_clean": "topics/topic_summaries_clean.parquet",
    "vis_data": "plots/vis_data.parquet",
}


@dataclass
class Catalog:
    spark: SparkSession
    root: str
    prefix: str = ""
    paths: dict = field(default_factory=lambda: dict(DEFAULT_PATHS))

    def path(self, name: str) -> str:
        if name not in self.paths:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.paths)}")
        parts = [self.root.rstrip("/")] + ([self.prefix.strip("/")] if self.prefix else []) + [self.paths[name]]
        return "/".join(parts)

    def table(self, name: str, schema=None) -> DataFrame:
        return io.read_table(self.spark, self.path(name), schema=schema)

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        io.write_table(df, self.path(name), mode=mode)

    def register(self, name: str, relative_path: str) -> None:
        self.paths[name] = relative_path
