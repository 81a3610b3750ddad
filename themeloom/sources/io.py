"""Readers and sinks.

All readers take an explicit schema where the format would otherwise infer
one: inference is an extra full pass over the input and is not stable across
files.
"""

from __future__ import annotations

from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Summaries file (S6): topic id -> record. Field names are the fixed ones the
# summariser writes, colons included: "Name:", "Description:", "Docs",
# "Keywords", "Model", "Temperature", "Prompt".
SUMMARY_RECORD = T.StructType([
    T.StructField("Name:", T.StringType()),
    T.StructField("Description:", T.StringType()),
    T.StructField("Docs", T.ArrayType(T.StringType())),
    T.StructField("Keywords", T.ArrayType(T.StringType())),
    T.StructField("Model", T.StringType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Prompt", T.StringType()),
])

ANSWER_SCHEMA = T.StructType([
    T.StructField("answer", T.ArrayType(T.StringType())),
    T.StructField("datetime", T.StringType()),
    T.StructField("gpt_model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("research_question", T.StringType()),
    T.StructField("system_message", T.StringType()),
])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S3: CSV with header; quoted fields may span lines."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str,
                    lenient: bool = True, keep_corrupt: bool = False) -> DataFrame:
    """One JSON record per line, plain or gzip (gzip is not splittable).

    ``lenient`` drops malformed lines (blank lines are skipped by the reader,
    a UTF-8 BOM is tolerated); :func:`json_line_rejects` lists them. With ``keep_corrupt`` bad lines are kept in a
    ``_corrupt_record`` column so callers can count them instead.
    """
    r = spark.read.schema(schema).option("encoding", "UTF-8")
    if keep_corrupt:
        s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        s = T.StructType(list(s.fields) + [T.StructField("_corrupt_record", T.StringType())])
        return (spark.read.schema(s).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if lenient:
        r = r.option("mode", "DROPMALFORMED")
    return r.json(path)


def json_line_rejects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What the lenient reader skipped, so that it can be reported: a row
    ``(file, line)`` per malformed line."""
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    s = T.StructType(list(s.fields) + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("line", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
            .filter((F.trim("line") != "") & parsed["_corrupt_record"].isNotNull()))


def read_json_object_map(spark: SparkSession, path: str,
                         value_schema: T.DataType = SUMMARY_RECORD,
                         key_name: str = "key") -> DataFrame:
    """A whole-file JSON object ``{key: record}`` (plain or gzip) -> one row per key.

    Each file is one record by construction (the producer writes a single
    object); the map is exploded right after parsing so nothing downstream
    holds the whole object.
    """
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), value_schema))
    return raw.select(F.explode(m).alias(key_name, "record")).select(key_name, "record.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str, schema=None, json_object_value=None) -> DataFrame:
    """Pick the reader from the file suffix."""
    p = path.rstrip("/")
    if fnmatch(p, "*.parquet"):
        return read_parquet(spark, path)
    if fnmatch(p, "*.csv"):
        return read_csv(spark, path, schema)
    if fnmatch(p, "*.jsonl") or fnmatch(p, "*.jsonl.gz"):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return read_json_lines(spark, path, schema)
    if fnmatch(p, "*.json") or fnmatch(p, "*.json.gz"):
        return read_json_object_map(spark, path, json_object_value or SUMMARY_RECORD)
    if fnmatch(p, "*.txt"):
        return read_text(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals become doubles so every value has a JSON number form.

    Sets do not exist in Spark (``collect_set`` already yields arrays), and
    arrays encode as JSON lists.
    """
    def fix(dt: T.DataType):
        if isinstance(dt, T.DecimalType):
            return T.DoubleType()
        if isinstance(dt, T.ArrayType):
            return T.ArrayType(fix(dt.elementType), dt.containsNull)
        if isinstance(dt, T.MapType):
            return T.MapType(dt.keyType, fix(dt.valueType), dt.valueContainsNull)
        if isinstance(dt, T.StructType):
            return T.StructType([T.StructField(f.name, fix(f.dataType), f.nullable) for f in dt.fields])
        return dt

    return df.select([F.col(f"`{f.name}`").cast(fix(f.dataType)).alias(f.name) if fix(f.dataType) != f.dataType
                      else F.col(f"`{f.name}`") for f in df.schema.fields])


def _object_lines(batches):
    """Lines of one JSON object from (key, record) JSON texts, as they come."""
    yield pd.DataFrame({"value": ["{"]})
    lead = ""
    for b in batches:
        lines = [f"{k}: {r}" for k, r in zip(b["k"], b["r"])]
        if lines:
            lines[0] = lead + lines[0]
            lead = ", "
            yield pd.DataFrame({"value": [lines[0], *(", " + x for x in lines[1:])]})
    yield pd.DataFrame({"value": ["}"]})


def write_json_object(df: DataFrame, path: str, mode: str = "overwrite", key_name: str = "key") -> None:
    """S7 for ``*.json`` / ``*.json.gz``: one object ``{key: record}`` in one
    file, which :func:`read_json_object_map` reads back. The format makes it one
    task; rows stream through it, none is gathered."""
    df = json_safe(df)
    if key_name not in df.columns:
        raise ValueError(f"a *.json file is one object: a column {key_name!r} must name its entries; use *.jsonl for rows")
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key_name])
    key = F.regexp_replace(F.to_json(F.array(F.col(f"`{key_name}`").cast("string"))), r"^\[|\]$", "")
    lines = df.select(key.alias("k"), F.to_json(record).alias("r")).repartition(1).mapInPandas(_object_lines, "value string")
    w = lines.write.mode(mode)
    (w.option("compression", "gzip") if path.rstrip("/").endswith(".gz") else w).text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink by suffix. ``*.jsonl`` is a record per line, ``*.json`` one
    object; both may end in ``.gz``."""
    p = path.rstrip("/")
    if fnmatch(p, "*.parquet"):
        df.write.mode(mode).parquet(path)
    elif fnmatch(p, "*.csv"):
        # CSV has no nested types: encode them as JSON text (read back with X16)
        cols = [F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
                for f in df.schema.fields]
        df.select(cols).write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    elif fnmatch(p, "*.json") or fnmatch(p, "*.json.gz"):
        write_json_object(df, path, mode)
    elif fnmatch(p, "*.gz"):
        json_safe(df).write.mode(mode).option("compression", "gzip").json(path)
    elif fnmatch(p, "*.jsonl"):
        json_safe(df).write.mode(mode).json(path)
    elif fnmatch(p, "*.txt"):
        df.select(F.col(df.columns[0]).cast("string")).write.mode(mode).text(path)
    else:
        json_safe(df).write.mode(mode).json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append-only collection sink (one JSON record per line)."""
    json_safe(df).write.mode("append").json(path)


def persist_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage output as Parquet and continue from the written copy.

    Re-reading truncates the lineage, so a later stage (or a retried task
    after executor loss) starts from the files rather than recomputing.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
