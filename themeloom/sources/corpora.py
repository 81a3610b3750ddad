"""The three input corpora as DataFrames (S10, S11, U1) plus their stand-ins.

The reference pulls *works* from a bibliographic API, *abstracts* from four
ranked CSV exports and *answers* from a JSON-lines collection. The readers for
landed files are in :mod:`themeloom.sources.io`; this module shapes those
inputs, and derives the same shapes from the driver's tables
(``documents``, ``labels``, ``conversations``, ``embeddings``) so every job
runs on data whose size grows with the scale factor.

Order matters to the reference (keep-first dedupe, head(n)); every corpus
carries an explicit ``ordinal`` (SURVEY P1) instead of relying on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.operators import filters, joins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


# ---------------------------------------------------------------------------
# works
# ---------------------------------------------------------------------------

def _works_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    title = _first_line(F.col("text"))
    return (
        d.join(lab, "doc_id", "left")
        .select(
            F.col("doc_id").alias("ordinal"),
            F.concat(F.lit("doi:"), F.md5("text")).alias("doi"),
            title.alias("title"),
            F.nullif(F.expr("substr(text, length(split_part(text, '\\n', 1)) + 2)"), F.lit("")).alias("abstract"),
            (F.col("n_chars").cast("double") / 100).alias("relevance_score"),
            (F.col("doc_id") % 97).alias("cited_by_count"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_retracted"),
            F.col("source"),
            F.col("lang"),
        )
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat works: exact-copy documents share a doi, equal first lines a title.

    ``ordinal`` doc_id; ``doi`` 'doi:' + md5(text); ``title`` first line;
    ``abstract`` the rest (null when empty); ``relevance_score`` n_chars/100;
    ``cited_by_count`` doc_id % 97; ``is_retracted`` toxic label.
    """
    b = _works_base(spark, sf_dir)
    return b.select(*[c for c in b.columns if c not in ("source", "lang")],
                    F.col("source").alias("journal"), "lang")


def works_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as the API returns them: bibliographic fields inside structs.

    ``biblio``, ``ids``, ``primary_location.source``, ``primary_topic`` and an
    ``authorships`` array stand in for the nested record columns; F11 unnests
    them, F12 drops them. One scan of ``documents`` (plus the label join).
    """
    b = _works_base(spark, sf_dir)
    o = F.col("ordinal")
    flat = [c for c in b.columns if c != "source"]
    return b.select(
        *flat,
        F.struct(
            (o % 50).cast("string").alias("volume"),
            F.when(o % 13 == 0, F.lit(None)).otherwise((o % 12).cast("string")).alias("issue"),
            (o * 10).cast("string").alias("first_page"),
            (o * 10 + 9).cast("string").alias("last_page"),
        ).alias("biblio"),
        F.struct(
            F.when(o % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("pm"), o.cast("string"))).alias("pmid"),
            F.concat(F.lit("W"), o.cast("string")).alias("work_id"),
        ).alias("ids"),
        F.struct(F.struct(
            F.col("source").alias("display_name"),
            F.concat(F.lit("pub "), F.col("lang")).alias("host_organization_name"),
            F.concat(F.lit("issn-"), F.col("source")).alias("issn_l"),
        ).alias("source")).alias("primary_location"),
        F.struct(
            F.concat(F.lit("T"), (o % 10).cast("string")).alias("id"),
            F.concat(F.col("lang"), F.lit(" topic")).alias("display_name"),
        ).alias("primary_topic"),
        F.array(F.struct(F.concat(F.lit("A"), (o % 31).cast("string")).alias("author"))).alias("authorships"),
    )


def works_source(works_df: DataFrame, cited_by: str = ">4", n_works: int = 10_000) -> DataFrame:
    """Records matching the citation predicate, the ``n_works`` most
    relevant (the API returns them by relevance). A capped fetch is the
    feature, so the limit stays; it plans as a top-k, not a full sort."""
    return (works_df.filter(filters.citation_predicate("cited_by_count", cited_by))
            .orderBy(F.col("relevance_score").desc_nulls_last(), F.col("ordinal"))
            .limit(n_works))


# ---------------------------------------------------------------------------
# abstracts (four ranked exports)
# ---------------------------------------------------------------------------

def abstract_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four "files": (file_no, file_pos) is the file order; doi groups of
    several rows with nulls to merge (D3)."""
    d = table(spark, sf_dir, "documents")
    file_no = F.substring("source", 4, 1_000_000).cast("int") % 4
    return d.select(
        file_no.alias("file_no"),
        F.col("doc_id").alias("file_pos"),
        F.concat(F.lit("doi:"), (F.col("doc_id") % 300).cast("string")).alias("doi"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(_first_line(F.col("text"))).alias("title"),
        F.col("text").alias("abstract"),
        F.when(file_no == 0, F.lit("main")).otherwise(F.lit("wider")).alias("category"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("doc_id") % 23).alias("total_cites"),
    )


def ranked_export(df: DataFrame, n: int = 1000, file_col: str = "file_no",
                  pos_col: str = "file_pos", category: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of each file in file order, tagged
    with ``category`` when given. ``row_number() <= n`` with a literal bound
    plans as a partial WindowGroupLimit before the shuffle."""
    if category is not None:
        df = df.withColumn("category", F.lit(category))
    w = Window.partitionBy(file_col).orderBy(pos_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def concat_exports(*dfs: DataFrame) -> DataFrame:
    """Concatenate ranked sources keeping order; ``ordinal`` is
    (source number, file position) via the ``file_no``/``file_pos`` pair."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# answers (repeated model answers)
# ---------------------------------------------------------------------------

def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of ``conversations`` as repeated answers."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("model-a")).otherwise(F.lit("model-b")).alias("gpt_model"),
        F.when(F.col("turn") % 4 == 1, F.lit(0.0)).otherwise(F.lit(0.5)).cast("double").alias("temperature"),
        F.when(F.col("conv_id") % 10 == 9, F.lit(None).cast("string")).otherwise(F.lit("be helpful")).alias("system_message"),
        "text",
    )


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers exploded on LF with a 0-based ``pos``; each line is given a
    numbered bold heading (``N. **word**: line``), which the driver's text
    never contains."""
    a = answers(spark, sf_dir)
    l = a.select("row_id", "gpt_model", "temperature", "system_message",
                 F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return l.select(
        "row_id", "gpt_model", "temperature", "system_message", F.col("pos").cast("bigint").alias("pos"),
        F.concat((F.col("pos") + 1).cast("string"), F.lit(". **"),
                 F.split_part(F.col("line"), F.lit(" "), F.lit(1)), F.lit("**: "), F.col("line")).alias("line"),
    )


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the collection's record shape (S12 schema): ``answer`` is the
    list of non-empty lines (X13) with numbered headings."""
    from themeloom.functions import text as tx

    a = answers(spark, sf_dir)
    lines = F.transform(tx.answer_lines("text"),
                        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"),
                                              F.split_part(x, F.lit(" "), F.lit(1)), F.lit("**: "), x))
    return a.select(
        "row_id", lines.alias("answer"), F.lit("2024-01-01T00:00:00").alias("datetime"),
        "gpt_model", "temperature", F.lit("what are the themes?").alias("research_question"),
        "system_message",
    )


# ---------------------------------------------------------------------------
# documents with topic assignments
# ---------------------------------------------------------------------------

def topic_docs(spark: SparkSession, sf_dir: str, with_vector: bool = False, parts: int | None = None) -> DataFrame:
    """All documents with a given topic (that of their vector's label, else the
    last digit of their id; 9 plays noise, -1) and probability; ``embedding``
    is null where there is no vector. ``with_vector`` gives only those that have
    one; the texts of the others do not move. The documents are dealt to ``parts``
    by their id, where given, or to the session's shuffle partitions if these are more.

    Even topics have many rows at probability exactly 1.0 (first branch of
    W4), odd topics none (second branch)."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if with_vector:
        e = e.filter("embedding is not null")
        d = joins.rows_with_key(d, e.select(F.col("vec_id").alias("doc_id")), "doc_id")
    if parts:
        d = d.repartition(parts, "doc_id")
    group = F.coalesce(F.col("label"), (F.col("doc_id") % 10).cast("int"))
    return d.join(e, e.vec_id == d.doc_id, "inner" if with_vector else "left").select(
        F.col("doc_id").alias("row_id"),
        F.when(group == 9, F.lit(-1)).otherwise(group).alias("topic"),
        F.when((F.col("doc_id") % 3 == 0) & (group % 2 == 0), F.lit(1.0))
        .otherwise((F.col("doc_id") % 100).cast("double") / 100).alias("probability"),
        (F.col("doc_id") % 97).alias("total_cites"),
        F.col("text").alias("title_abstract"),
        "embedding",
    )
