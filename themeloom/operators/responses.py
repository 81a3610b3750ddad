"""Model-request and model-response tables.

Requests are rows; a completer (an injected callable) runs over them inside
``mapInPandas`` so that requests are spread over executors and no table
passes through the driver. The built-in completer is extractive and offline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import text as tx
from themeloom.operators import filters, joins, ranking
from themeloom.sources.io import SUMMARY_RECORD

# The default summary request: its two places take the texts and the keywords.
SUMMARY_TEMPLATE = """Below are sample texts that belong to one theme, then terms that are typical of it.
Answer with a short title for the theme and one paragraph on what its texts have in common.

Texts:
%s

Typical terms: %s
"""


def request_table(groups: DataFrame, n_samples: int, system_message: str, question: str,
                  done: DataFrame | None = None, keys=("gpt_model", "temperature", "sample")) -> DataFrame:
    """L1: the repeated-sampling plan (J8), minus what is already collected."""
    grid = joins.request_grid(groups, n_samples).withColumns(
        {"system_message": F.lit(system_message), "research_question": F.lit(question)})
    if done is not None:
        grid = joins.pending_requests(grid, done, list(keys))
    return grid


def response_records(df: DataFrame, answer_col: str = "answer_text") -> DataFrame:
    """L2: an answer text becomes the stored record: non-empty lines
    and the time it was recorded."""
    return df.select(tx.answer_lines(answer_col).alias("answer"),
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"),
                     "gpt_model", "temperature", "research_question", "system_message")


def summary_requests(docs: DataFrame, keywords: DataFrame, n_docs: int = 5, text_col: str = "text",
                     topic_col: str = "topic", id_col: str = "row_id", cites_col: str | None = None,
                     prob_col: str = "probability", template: str = SUMMARY_TEMPLATE) -> DataFrame:
    """L3: one request per topic (noise skipped): the top ``n_docs`` texts
    as ``docs`` in rank order, joined by newlines as ``texts``, and the topic's
    keywords joined by ", " in the ``template``."""
    top = ranking.top_docs_per_topic(docs, n_docs, topic_col, prob_col, cites_col, id_col)
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.coalesce(text_col, F.lit("")).alias("t"))))
    texts = (top.groupBy(topic_col).agg(F.transform(ranked, lambda x: x["t"]).alias("docs"))
             .withColumn("texts", F.array_join("docs", "\n")))
    kw = keywords.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_k"))
    kw = kw.select(F.col("topic").alias(topic_col), F.transform("_k", lambda x: x["term"]).alias("keywords"))
    j = texts.join(kw, topic_col, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return j.select(topic_col, "docs", "texts", "keywords",
                    F.format_string(template, F.col("texts"), F.array_join("keywords", ", ")).alias("prompt"))


_SENT = re.compile(r"(?<=[.!?])\s+")


def extractive_completer(docs: list[str], keywords: list[str]) -> dict:
    """Offline stand-in: name from the first five keywords, description from
    the first sentence of the top document."""
    first_doc = docs[0].strip() if docs else ""
    return {"name": " ".join(keywords[:5]) or "unnamed", "description": _SENT.split(first_doc, maxsplit=1)[0]}


def complete(requests: DataFrame, completer: Callable[[list, list], dict] | None = None,
             model: str = "extractive", temperature: float = 0.0, topic_col: str = "topic") -> DataFrame:
    """L4: run the completer over each request; attach name and description.
    Output has the summary record fields (``Name:``, ``Description:``,
    ``Docs``, ``Keywords``, ``Model``, ``Temperature``, ``Prompt``)."""
    fn = completer or extractive_completer
    schema = T.StructType([T.StructField(topic_col, requests.schema[topic_col].dataType)] + list(SUMMARY_RECORD.fields))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = list(r.docs) if r.docs is not None else []
                k = list(r.keywords) if r.keywords is not None else []
                out = fn(d, k)
                rows.append({topic_col: getattr(r, topic_col), "Name:": out.get("name"),
                             "Description:": out.get("description"), "Docs": d,
                             "Keywords": k, "Model": model, "Temperature": float(temperature),
                             "Prompt": getattr(r, "prompt")})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return requests.select(topic_col, "docs", "keywords", "prompt").mapInPandas(run, schema)


def summary_records(completed: DataFrame, topic_col: str = "topic") -> DataFrame:
    """The summaries as (key, record) rows, the key being the topic id as text:
    what the ``*.json`` sink writes as one object and its reader gives back."""
    return completed.select(F.col(topic_col).cast("string").alias("key"),
                            *[F.col(f"`{f.name}`") for f in SUMMARY_RECORD.fields])


def flatten_summaries(summaries: DataFrame, key_col: str = "key") -> DataFrame:
    """Summary rows -> five columns: fields snake-cased and renamed, the
    topic id an integer (the reference could lose it)."""
    rows = filters.snake_case_columns(summaries.withColumnRenamed(key_col, "topic"))
    rows = filters.cast_topic(rows)
    return rows.select("topic", F.col("name").alias("topic_name"), F.col("description").alias("topic_description"),
                       F.col("docs").alias("representative_docs"), F.col("keywords").alias("topic_keywords"))
