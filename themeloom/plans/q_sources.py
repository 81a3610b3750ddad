"""Registered queries: readers and sinks.

Each query writes a table Spark derived from the driver's data into a fresh
folder under ``spark.checkpoint.dir`` (the shared folder of the cluster) and
reads it back through the reader under test; the oracle is the same rows
computed directly from the source tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.registry import register
from themeloom.session import checkpoint_dir
from themeloom.sources import catalog, io
from themeloom.sources import corpora as C


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}/{name}"


ABSTRACT_COLS = "file_no int, file_pos bigint, doi string, title string, category string, total_cites bigint"
ABSTRACT_SQL = V("select file_no, file_pos, doi, title, category, total_cites from abstracts", "abstracts")


def _abstracts(spark, sf):
    return C.abstract_exports(spark, sf).select("file_no", "file_pos", "doi", "title", "category", "total_cites")


@register("s1_read_by_suffix", ABSTRACT_SQL)
def s1_read_by_suffix(spark, sf):
    """S1 + S7: written as Parquet, read back by the suffix dispatcher."""
    p = _scratch(spark, "abstracts.parquet")
    io.write_table(_abstracts(spark, sf), p)
    return io.read_table(spark, p)


@register("s3_csv_roundtrip", ABSTRACT_SQL)
def s3_csv_roundtrip(spark, sf):
    """S3: CSV with header and quoted multi-line fields, declared schema."""
    p = _scratch(spark, "abstracts.csv")
    io.write_table(_abstracts(spark, sf), p)
    return io.read_table(spark, p, schema=ABSTRACT_COLS)


ANSWER_SQL = V("""
select row_id, gpt_model, temperature, system_message,
       cast(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as bigint) as n_lines
from answers""", "answers")


def _answer_records(spark, sf):
    from themeloom.functions import text as tx
    a = C.answers(spark, sf)
    return a.select("row_id", tx.answer_lines("text").alias("answer"), F.lit("2024-01-01T00:00:00").alias("datetime"),
                    "gpt_model", "temperature", F.lit("q").alias("research_question"), "system_message")


SCHEMA_WITH_ID = T.StructType([T.StructField("row_id", T.LongType())] + list(io.ANSWER_SCHEMA.fields))


def _answers_out(df):
    return df.select("row_id", "gpt_model", "temperature", "system_message",
                     F.size("answer").cast("bigint").alias("n_lines"))


@register("s4_json_lines_gzip", ANSWER_SQL)
def s4_json_lines_gzip(spark, sf):
    """S4 + S8: gzip JSON lines (one record per line), declared schema."""
    p = _scratch(spark, "answers.jsonl.gz")
    io.write_table(_answer_records(spark, sf), p)
    return _answers_out(io.read_table(spark, p, schema=SCHEMA_WITH_ID))


@register("s5_lenient_json_lines", ANSWER_SQL)
def s5_lenient_json_lines(spark, sf):
    """Malformed and blank lines among the records are skipped."""
    p = _scratch(spark, "answers_dirty")
    good = _answer_records(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    bad = C.answers(spark, sf).select(F.concat(F.lit("{broken "), F.col("row_id").cast("string")).alias("value"))
    blank = C.answers(spark, sf).select(F.lit("").alias("value"))
    good.unionByName(bad).unionByName(blank).write.text(p)
    return _answers_out(io.read_json_lines(spark, p, SCHEMA_WITH_ID, lenient=True))


@register("s6_json_object_map", V("""
select cast(topic as varchar) as key, 'topic ' || cast(topic as varchar) as "Name:", count(*) as n_docs
from topic_docs group by topic""", "topic_docs"))
def s6_json_object_map(spark, sf):
    """One whole-file JSON object (topic id -> record), read back to rows."""
    p = _scratch(spark, "summaries.json")
    io.write_table(_summaries(spark, sf), p)
    back = io.read_table(spark, p)
    return back.select("key", "`Name:`", F.element_at("Docs", 1).cast("bigint").alias("n_docs"))


def _summaries(spark, sf):
    """A summary record per topic, its document count as text in ``Docs``."""
    topic = F.col("topic").cast("string")
    return (C.topic_docs(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
            .select(topic.alias("key"), F.concat(F.lit("topic "), topic).alias("Name:"),
                    F.concat(F.lit('say "'), topic, F.lit('"\n, {é}')).alias("Description:"),
                    F.array(F.col("n").cast("string"), F.lit("}")).alias("Docs"), F.array(topic).alias("Keywords"),
                    F.lit("m").alias("Model"), (F.col("n") / 2).alias("Temperature"), F.lit(None).cast("string").alias("Prompt")))


@register("s7_summaries_through_catalog", V("""
select cast(topic as varchar) as key, 'topic ' || cast(topic as varchar) as "Name:",
       'say "' || cast(topic as varchar) || '"' || chr(10) || ', {é}' as "Description:", cast(count(*) as varchar) as docs,
       cast(topic as varchar) as keywords, 'm' as "Model", count(*) / 2 as "Temperature", cast(null as varchar) as "Prompt"
from topic_docs group by topic""", "topic_docs"))
def s7_summaries_through_catalog(spark, sf):
    """S7 with S6 and S9: the summaries object saved and read through the catalog."""
    cat = catalog.Catalog(spark, _scratch(spark, "catalog"))
    cat.save("summaries", _summaries(spark, sf))
    back = cat.table("summaries")
    return back.select("key", "`Name:`", "`Description:`", F.element_at("Docs", 1).alias("docs"),
                       F.array_join("Keywords", ",").alias("keywords"), "Model", "Temperature", "Prompt")


@register("s5_rejected_lines", V("""
select '{broken ' || cast(row_id as varchar) as line from answers""", "answers"))
def s5_rejected_lines(spark, sf):
    """The malformed lines that the lenient reader skips, listed."""
    p = _scratch(spark, "answers_dirty")
    good = _answer_records(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    bad = C.answers(spark, sf).select(F.concat(F.lit("{broken "), F.col("row_id").cast("string")).alias("value"))
    good.unionByName(bad).unionByName(C.answers(spark, sf).select(F.lit("").alias("value"))).write.text(p)
    return io.json_line_rejects(spark, p, SCHEMA_WITH_ID).select("line")


@register("s8_json_safe_decimals", V("""
select file_pos, round(cast(total_cites as double) / 7, 2) as ratio from abstracts""", "abstracts"))
def s8_json_safe_decimals(spark, sf):
    """Decimals leave the sink as JSON numbers (doubles)."""
    p = _scratch(spark, "ratios.jsonl")
    a = C.abstract_exports(spark, sf).select(
        "file_pos", F.round(F.col("total_cites").cast("decimal(20,4)") / 7, 2).alias("ratio"))
    io.write_table(a, p)
    return spark.read.schema("file_pos bigint, ratio double").json(p)


@register("s9_catalog_roundtrip", ABSTRACT_SQL)
def s9_catalog_roundtrip(spark, sf):
    """A named dataset saved and read through the catalog."""
    cat = catalog.Catalog(spark, _scratch(spark, "catalog"), prefix="rq1")
    cat.register("abstracts_raw", "abstracts/abstracts_raw.parquet")
    cat.save("abstracts_raw", _abstracts(spark, sf))
    return cat.table("abstracts_raw")


@register("s12_append_collection", V("""
select row_id, gpt_model, temperature, system_message,
       cast(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as bigint) as n_lines
from answers""", "answers"))
def s12_append_collection(spark, sf):
    """Answers appended to the collection in two batches."""
    p = _scratch(spark, "answers_collection")
    recs = _answer_records(spark, sf)
    io.append_records(recs.filter(F.col("temperature") == 0.0), p)
    io.append_records(recs.filter(F.col("temperature") != 0.0), p)
    return _answers_out(io.read_json_lines(spark, p, SCHEMA_WITH_ID))


@register("s12_answer_stream", V("""
with l as (select row_id, gpt_model, temperature, list_filter(string_split(text, chr(10)), lambda x: x <> '') as answer from answers)
select row_id as second, gpt_model, temperature, cast(generate_subscripts(answer, 1) - 1 as bigint) as pos,
       md5(unnest(answer)) as line_md5 from l where len(answer) > 0
union all select row_id, gpt_model, temperature, null, null from l where len(answer) = 0""", "answers"))
def s12_answer_stream(spark, sf):
    """S12 as a stream: two available-now rounds from one checkpoint; the second
    finds new files and the first ones once more, under other names."""
    from themeloom.streaming import answers as st

    start = 1704067200  # 2024-01-01; a second of its own for every answer
    recs = _answer_records(spark, sf).withColumn(
        "datetime", F.date_format(F.timestamp_seconds(F.col("row_id") + start), "yyyy-MM-dd'T'HH:mm:ss")).drop("row_id")
    landed, out, state = (_scratch(spark, x) for x in ("answers_landed", "answers_lines", "answers_state"))
    early = recs.filter(F.col("temperature") == 0.0)
    for batch in (early, recs.filter(F.col("temperature") != 0.0).unionByName(early)):
        io.append_records(batch, landed)
        records = st.first_records(st.answer_records_stream(spark, landed), late="10000 days")
        st.start_append(st.answer_lines_stream(records), out, state).awaitTermination()
    lines = spark.read.parquet(out)
    second = F.unix_timestamp("datetime", "yyyy-MM-dd'T'HH:mm:ss") - start
    return lines.select(second.alias("second"), "gpt_model", "temperature", "pos", F.md5("line").alias("line_md5"))


@register("s13_persist_stage", V("""
select ordinal, doi from works where relevance_score > 10""", "works"))
def s13_persist_stage(spark, sf):
    """A stage written as Parquet and continued from the written copy."""
    from themeloom.operators import filters
    stage = io.persist_stage(filters.relevance_above(C.works(spark, sf), 10), _scratch(spark, "works_filtered"))
    return stage.select("ordinal", "doi")
