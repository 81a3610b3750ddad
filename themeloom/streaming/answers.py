"""The answer collection (S12) read incrementally.

The reference appends model answers to a JSON-lines file and re-reads it
whole. Here the collection is a folder of JSON-lines files read as a
Structured Streaming file source: each new file is cleaned once (lines ->
rows, heading, cleaned text; X13/X14/X10/X11) and appended to a Parquet table.
The balanced sample (W6) needs the final group sizes, so it stays a batch step
(:func:`themeloom.plans.jobs.answers_long`) over the written table.

A file may come twice, or a writer may repeat records after a crash: records are
told apart by a hash of their content, which the stream keeps as state until the
watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from themeloom.functions import text as tx
from themeloom.sources.io import ANSWER_SCHEMA


def answer_records_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """New answer records as they land; ``row_id`` is a content hash (stable
    across re-reads, so a replayed file yields the same ids)."""
    s = (spark.readStream.schema(ANSWER_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
         .option("mode", "DROPMALFORMED").json(path))
    return s.withColumn("row_id", F.xxhash64("datetime", "gpt_model", "temperature", F.to_json("answer")))


def first_records(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Each record once. State holds the ids of records whose ``datetime`` is at
    most ``late`` before the newest; what arrives later than that is dropped, as
    it may have been seen. A record whose time cannot be read is not told apart
    from others by time and is dropped too."""
    timed = records.withColumn("event_time", F.try_to_timestamp("datetime"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["row_id"]).drop("event_time")


def answer_lines_stream(records: DataFrame) -> DataFrame:
    """One row per answer line with heading and cleaned text (stateless)."""
    long = records.select("row_id", "gpt_model", "temperature", "system_message", "datetime",
                          F.posexplode_outer("answer").alias("pos", "line"))
    return long.withColumns({"pos": F.col("pos").cast("bigint"), "heading": tx.first_heading("line"),
                             "answer_cleaned": tx.clean_answer_line("line")})


def start_append(lines: DataFrame, out_path: str, checkpoint_location: str,
                 available_now: bool = True) -> StreamingQuery:
    """Append to Parquet with a checkpoint (exactly-once file sink). With
    ``available_now`` the query processes what has landed and stops."""
    w = lines.writeStream.format("parquet").option("path", out_path) \
        .option("checkpointLocation", checkpoint_location).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
