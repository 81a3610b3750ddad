"""Projections, filters and predicates.

Every filter is a plain ``Column`` predicate, so Catalyst pushes it into the
Parquet scan where the column is a top-level one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.text import snake_case

# Nine bibliographic columns that must be present.
BIBLIO_REQUIRED = ["doi", "volume", "issue", "first_page", "last_page", "pmid", "journal", "publisher", "issn_l"]


def relevance_above(df: DataFrame, threshold: float = 10, col: str = "relevance_score") -> DataFrame:
    """F1: strict ``>``; null scores drop."""
    return df.filter(F.col(col) > F.lit(threshold))


def drop_null(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows null in any of ``subset``."""
    return df.dropna(how="any", subset=subset)


def not_retracted(df: DataFrame, col: str = "is_retracted") -> DataFrame:
    """keep rows explicitly not retracted; null counts as drop."""
    return df.filter(F.col(col) == F.lit(False))


_RANGE = re.compile(r"^\s*(\d+)\s*-\s*(\d+)\s*$")
_CMP = re.compile(r"^\s*(>=|<=|>|<|=|!=)?\s*(-?\d+)\s*$")


def citation_predicate(col: str, spec: str) -> Column:
    """a citation filter given as text (``">4"``, ``"<10"``, ``"7"``,
    ``"5-20"``) to a Column predicate."""
    c = F.col(col)
    m = _RANGE.match(spec)
    if m:
        return c.between(int(m.group(1)), int(m.group(2)))
    m = _CMP.match(spec)
    if not m:
        raise ValueError(f"bad citation filter {spec!r}")
    op, n = m.group(1) or "=", int(m.group(2))
    return {">": c > n, "<": c < n, ">=": c >= n, "<=": c <= n, "=": c == n, "!=": c != n}[op]


def cited_or_core(df: DataFrame, min_cites: int = 5, core: str = "main",
                  cites_col: str = "total_cites", category_col: str = "category") -> DataFrame:
    """``total_cites >= min OR category = core``."""
    return df.filter((F.col(cites_col) >= min_cites) | (F.col(category_col) == core))


def known_system_message(df: DataFrame, col: str = "system_message") -> DataFrame:
    """F7."""
    return df.filter(F.col(col).isNotNull())


def drop_noise(df: DataFrame, topic_col: str = "topic", keep_noise: bool = False) -> DataFrame:
    """F8: remove the noise topic -1 unless ``keep_noise`` (the plot_na option)."""
    return df if keep_noise else df.filter(F.col(topic_col) != -1)


def select_topic(df: DataFrame, topic: int, topic_col: str = "topic") -> DataFrame:
    """F9."""
    return df.filter(F.col(topic_col) == topic)


def model_and_temperatures(df: DataFrame, model: str, temperatures: list[float],
                           model_col: str = "gpt_model", temp_col: str = "temperature") -> DataFrame:
    """F10."""
    return df.filter((F.col(model_col) == model) & F.col(temp_col).isin(*temperatures))


def unnest_works(df: DataFrame, topic_sep: str = ".") -> DataFrame:
    """nested bibliographic structs to flat columns, row by row.

    ``biblio.*``; ``ids.pmid``; ``primary_location.source.{display_name ->
    journal, host_organization_name -> publisher, issn_l}``; every
    ``primary_topic`` field as ``primary_topic<sep><field>``. Struct access
    keeps each value on its own row (the reference glued columns by index and
    could misalign them after a filter).
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    biblio = [F.col(f"biblio.{f.name}").alias(f.name) for f in df.schema["biblio"].dataType.fields]
    src = "primary_location.source"
    loc = [F.col(f"{src}.display_name").alias("journal"),
           F.col(f"{src}.host_organization_name").alias("publisher"),
           F.col(f"{src}.issn_l").alias("issn_l")]
    topic = [F.col(f"primary_topic.{f.name}").alias(f"primary_topic{topic_sep}{f.name}")
             for f in df.schema["primary_topic"].dataType.fields]
    return df.select(*cols, *biblio, F.col("ids.pmid").alias("pmid"), *loc, *topic)


def drop_nested(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """drop the listed columns, or every struct / array / map column."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.drop(*cols)


def project(df: DataFrame, columns: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """fixed schema: select (in order) and rename."""
    renames = renames or {}
    return df.select([F.col(f"`{c}`").alias(renames.get(c, c)) for c in columns])


def with_constants(df: DataFrame, values: dict) -> DataFrame:
    """constant columns (e.g. ``source``, ``gpt_model``) to align sources."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def fill_label(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """nulls -> a label such as ``"NA"`` or ``"--"``."""
    return df.fillna(values)


def cast_topic(df: DataFrame, col: str = "topic", to: str = "int") -> DataFrame:
    """F16: topic id as text -> integer."""
    return df.withColumn(col, F.col(col).cast(to))


def snake_case_columns(df: DataFrame) -> DataFrame:
    """every column name to snake case."""
    return df.toDF(*[snake_case(c) for c in df.columns])
