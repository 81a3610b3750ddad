"""Whole jobs (G1-G10), each a chain of DataFrames built from the operators; what a later step reads twice is written.

Stage outputs can be persisted with :func:`themeloom.sources.io.persist_stage`
(or a :class:`themeloom.sources.catalog.Catalog`) where a later stage is
started on its own; inside a job the plan stays lazy so Catalyst prunes
columns and pushes filters down to the scans.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions import vectors as vx
from themeloom.operators import dedupe, embed, filters, ranking, responses, retrieval, similarity, stats, topics
from themeloom.session import stage
from themeloom.sources import corpora


# ---------------------------------------------------------------- G1
def works_filtered(works: DataFrame, relevance_threshold: float = 10) -> DataFrame:
    """G1 up to the cleaning: F2 -> F1 -> F11 -> F3 -> D2 -> X6 -> X7 -> X8 -> F4."""
    w = filters.drop_null(works, ["title", "abstract"])
    w = filters.relevance_above(w, relevance_threshold)
    w = filters.unnest_works(w)
    w = filters.drop_null(w, filters.BIBLIO_REQUIRED)
    w = dedupe.dedupe_doi_then_title(w, "ordinal")
    w = w.withColumn("abstract_clean", tx.clean_abstract("abstract"))
    w = w.withColumn("title_abstract", tx.title_abstract("title", "abstract_clean"))
    w = w.withColumn("num_tokens", tx.token_count_estimate("title_abstract"))
    return filters.not_retracted(w)


def works_ranked(works: DataFrame, question: str, relevance_threshold: float = 10, top_k: int = 1000,
                 with_embeddings: bool = False, encoder=None, persist: bool = True) -> DataFrame:
    """G1: filtered works ranked by BM25 against ``question`` (M3), optionally
    embedded (M5). Nested columns are dropped from the output.

    With ``persist`` the filtered stage is written as Parquet into the shared
    folder before ranking (S13): BM25 reads its corpus twice, and then only the
    columns it needs."""
    w = works_filtered(works, relevance_threshold)
    if persist:
        w = stage(filters.drop_nested(w, ["biblio", "ids", "primary_location", "primary_topic", "authorships"]), "works")
    ranked = retrieval.bm25_filter(w, question, top_k, "title_abstract", "ordinal")
    ranked = filters.drop_nested(ranked)
    if with_embeddings:
        ranked = embed.embed(ranked, "title_abstract", "embeddings", encoder=encoder)
    return ranked


def works_funnel(works: DataFrame, relevance_threshold: float = 10, long_tokens: int = 20_000) -> DataFrame:
    """A12 for G1: rows left after each stage, and how many of the last are
    over-long (A9). Every row carries flags; the two keep-first steps number
    rows among those still in; one aggregate counts all stages."""
    w = filters.unnest_works(works)
    has = lambda cols: functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
    tokens = tx.token_count_estimate(tx.title_abstract("title", tx.clean_abstract("abstract")))
    rows = w.select("ordinal", "doi", "title", F.coalesce(~F.col("is_retracted"), F.lit(False)).alias("in_print"),
                    tokens.alias("tokens"), has(["title", "abstract"]).alias("not_null"),
                    F.coalesce(F.col("relevance_score") > relevance_threshold, F.lit(False)).alias("relevant"),
                    has(filters.BIBLIO_REQUIRED).alias("full"))
    rows = (rows.withColumn("relevance", F.col("not_null") & F.col("relevant"))
            .withColumn("biblio", F.col("relevance") & F.col("full")))
    first = lambda key, among: F.col(among) & (F.row_number().over(
        Window.partitionBy(key, among).orderBy("ordinal")) == 1)
    # numbers are needed only among rows still in; a row that is out may have any
    rows = rows.withColumn("by_doi", first("doi", "biblio"))
    rows = rows.withColumn("by_title", first("title", "by_doi"))
    rows = rows.withColumn("not_retracted", F.col("by_title") & F.col("in_print"))
    return rows.agg(F.count("*").alias("input"), *[F.count_if(F.col(c)).alias(c) for c in (
        "not_null", "relevance", "biblio", "by_doi", "by_title", "not_retracted")],
        F.count_if(F.col("not_retracted") & (F.col("tokens") > long_tokens)).alias("over_long"))


# ---------------------------------------------------------------- G2
def abstracts_prepared(exports: DataFrame, n_per_file: int = 1000, min_cites: int = 5) -> DataFrame:
    """G2 without the encoder: S11 -> F2 -> D1 -> D3 -> X6 -> X7 -> D4 -> F6."""
    a = corpora.ranked_export(exports, n_per_file)
    a = filters.drop_null(a, ["title", "abstract"])
    a = dedupe.distinct_rows(a, ["file_no", "file_pos"])
    a = dedupe.merge_first_non_null(a, "doi", ["file_no", "file_pos"])
    a = a.withColumn("abstract_clean", tx.clean_abstract("abstract"))
    a = a.withColumn("title_abstract", tx.title_abstract("title", "abstract_clean"))
    a = dedupe.title_dedupe_smallest_doi(a)
    return filters.cited_or_core(a, min_cites)


def abstracts_embedded(exports: DataFrame, encoder=None, truncate_dim: int = 384) -> DataFrame:
    """+ M5 and the fixed output schema."""
    a = abstracts_prepared(exports)
    a = embed.embed(a, "title_abstract", "embeddings", encoder=encoder, truncate_dim=truncate_dim)
    return a.select("doi", "title", "abstract", "abstract_clean", "title_abstract", "category", "total_cites",
                    "embeddings")


# ---------------------------------------------------------------- G3
def answers_long(records: DataFrame, cap: int = 100, seed: int = 42) -> DataFrame:
    """F7 -> A4/W6 balanced sample -> X14 explode lines -> X10 heading -> X11."""
    a = filters.known_system_message(records)
    a = ranking.balanced_sample(a, ["gpt_model", "temperature"], "row_id", cap, seed)
    long = a.select("*", F.posexplode_outer("answer").alias("pos", "line")).drop("answer")
    return long.withColumns({"heading": tx.first_heading("line"), "answer_cleaned": tx.clean_answer_line("line"),
                             "pos": F.col("pos").cast("bigint")})


# ---------------------------------------------------------------- G4 / G5
def discover_topics(docs: DataFrame, threshold: float, min_size: int, id_col: str = "row_id",
                    vec: str = "embedding", text_col: str = "text", n_keywords: int = 10,
                    ngram_range=(1, 2), block_rows: int = 1024, reduce_to: int | None = None,
                    n_topics: int | None = None, save_to: str | None = None) -> dict[str, DataFrame]:
    """T1 -> T2 -> T3 -> T11 -> T4 -> T5 -> T6/T7 -> T10 -> T17. Returns the
    documents with ``topic, probability`` and the topic tables. Vectors are
    reduced to ``reduce_to`` dimensions and topics merged to ``n_topics`` where
    given; ``save_to`` is a folder for the fitted topics."""
    points, model = docs, None
    if reduce_to is not None:
        points, model = topics.reduce_dimensions(docs, reduce_to, vec, "_reduced")
        points = points.drop(vec).withColumnRenamed("_reduced", vec)
    assign, edges = topics.density_clusters(points, threshold, min_size, id_col, vec, block_rows)
    prob = stage(topics.membership_probability(assign, edges, id_col), "topic-assignment")
    d = docs.join(prob, id_col)
    if n_topics is not None:
        merged = topics.reduce_topics(prob, docs.select(id_col, vec), n_topics, id_col, vec)
        d = (d.join(merged.withColumnRenamed("topic", "_merged"), F.col("topic") == F.col("old_topic"))
             .withColumn("topic", F.col("_merged")).drop("old_topic", "_merged"))
    texts = stage(d.select(id_col, "topic", text_col), "topic-texts")  # read a few times: a text moves once
    counts = topics.topic_term_counts(texts, "topic", text_col, ngram_range)
    weights = topics.ctfidf(counts)
    kw = topics.top_keywords(weights, n_keywords)
    names = topics.topic_names(kw)
    reps = topics.representative_docs(texts, weights, 3, "topic", id_col, text_col, ngram_range)
    info = stats.topic_info(d).join(names.withColumnRenamed("topic", "Topic"), "Topic", "left")
    if save_to is not None:
        parts = topics.component_table(docs.sparkSession, model) if model is not None else None
        topics.save_topic_model(save_to, info, weights, topics.centroids(d, "topic", vec), parts)
    return {"documents": d, "edges": edges, "topic_terms": weights, "keywords": kw, "topics": info,
            "representative_docs": reps}


def summarise_topics(docs: DataFrame, keywords: DataFrame, completer=None, text_col: str = "text",
                     n_docs: int = 5) -> DataFrame:
    """W4 -> L3 -> L4 -> L5. ``keywords`` are the similarity-refined ones
    (T8) in the jobs; any (topic, term, rank) table will do."""
    req = responses.summary_requests(docs, keywords, n_docs, text_col)
    done = responses.complete(req, completer)
    return responses.flatten_summaries(responses.summary_records(done))


def refined_keywords(docs: DataFrame, text_col: str = "text", id_col: str = "row_id", n: int = 10,
                     encoder=None) -> tuple[DataFrame, DataFrame]:
    """T4 -> T5 -> T10 -> T8: the topics' weights and their keywords refined by
    similarity to the representative documents."""
    docs = stage(docs.select(id_col, "topic", text_col), "topic-texts")  # read many times
    weights = topics.ctfidf(topics.topic_term_counts(docs, "topic", text_col))
    reps = topics.representative_docs(docs, weights, 3, "topic", id_col, text_col)
    return weights, topics.similarity_keywords(weights, reps, docs, n, 30, id_col, text_col, encoder)


# ---------------------------------------------------------------- G6 / T15
def plot_table(docs: DataFrame, text_col: str = "text", id_col: str = "row_id", vec: str = "embedding",
               cites_col: str = "total_cites", completer=None, plot_noise: bool = False) -> DataFrame:
    """Coordinates + topic + name + text + metadata + summary columns;
    nested columns dropped; citation band (X17); missing names filled (F15).
    Noise goes before the bands are set, unless ``plot_noise`` asks for it.
    A document without a vector has no coordinates."""
    d = docs.withColumnRenamed(text_col, "doc")
    xy = topics.project_2d(d.filter(F.col(vec).isNotNull()), vec, id_col).select(id_col, "x", "y")
    weights, refined = refined_keywords(d, "doc", id_col)
    names = topics.topic_names(topics.top_keywords(weights, 10)).select("topic", "Name")
    summ = summarise_topics(d, refined, completer, "doc")
    shown = d if plot_noise else filters.drop_noise(d)
    out = (shown.join(xy, id_col, "left").join(names, "topic", "left")
           .join(summ.select("topic", "topic_name", "topic_description"), "topic", "left"))
    if cites_col in out.columns:
        # joined one to one, so the documents that are shown have the plot table's quartiles
        qs = [F.lit(q) for q in stats.quartile_values(shown, cites_col)]
        out = out.withColumn("citation_band", tx.citation_band(cites_col, *qs))
    out = filters.drop_nested(out)
    return filters.fill_label(out, {"Name": "NA", "topic_name": "NA"})


def topic_bar_counts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """G6 bar chart table: topic counts joined with names (J4), noise dropped."""
    counts = filters.drop_noise(docs).groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(names, "topic", "inner")


def topic_map(plot_rows: DataFrame, sigma: float = 0.05, seed: int = 7, id_col: str = "row_id") -> DataFrame:
    """G6 map: the plot table's points jittered (X23) so that copies do not
    cover each other, with the citation band that sizes them."""
    return plot_rows.filter(F.col("x").isNotNull()).withColumns({
        "x_shown": vx.gaussian_jitter("x", sigma, seed, id_col), "y_shown": vx.gaussian_jitter("y", sigma, seed + 1, id_col)})


def topic_hulls(plot_rows: DataFrame) -> DataFrame:
    """G6 outlines: the closed hull ring (T16) of each topic's points, in order."""
    return topics.convex_hulls(filters.drop_noise(plot_rows).filter(F.col("x").isNotNull()), "topic")


# ---------------------------------------------------------------- G7
def user_topics(keywords: DataFrame, encoder=None, **embed_options) -> DataFrame:
    """(topic, name, centroid) of a user's topics given as (topic, keywords),
    the keywords a comma-separated text (X19 -> M5)."""
    named = keywords.withColumn("name", F.array_join(tx.keyword_list("keywords", trim_only=True), " "))
    return embed.embed(named, "name", "centroid", encoder=encoder, **embed_options).select("topic", "name", "centroid")


def recluster_topic(docs: DataFrame, topic: int, keywords: DataFrame, min_similarity: float,
                    threshold: float, min_size: int, id_col: str = "row_id", text_col: str = "text",
                    encoder=None, completer=None) -> dict[str, DataFrame]:
    """One topic's documents re-split. They and the user's keywords (topic,
    keywords) are embedded alike; documents near a user topic take it (T13),
    the rest is clustered (T2) with fresh ids after the user's, and what
    results is summarised and prepared for plotting (W4 -> L3 -> L5 -> T15).
    Returns ``documents``, ``user_topics``, ``summaries`` and ``plot``."""
    sub = stage(embed.embed(filters.select_topic(docs, topic).drop("topic", "probability", "embedding"), text_col,
                            "embedding", encoder=encoder), "recluster")
    wanted = stage(user_topics(keywords, encoder), "user-topics")
    assigned, rest = topics.zero_shot(sub, wanted, min_similarity, id_col, "embedding")
    first_free = (wanted.agg(F.max("topic")).first()[0] or 0) + 1  # one number
    clustered, edges = topics.density_clusters(rest, threshold, min_size, id_col, "embedding")
    found = topics.membership_probability(clustered, edges, id_col).withColumn(
        "topic", F.when(F.col("topic") == -1, -1).otherwise(F.col("topic") + first_free))
    merged = assigned.select(id_col, "topic", F.col("similarity").alias("probability")).unionByName(found)
    d = stage(sub.join(merged, id_col), "reclustered")
    refined = refined_keywords(d, text_col, id_col)[1]
    return {"documents": d, "user_topics": wanted, "summaries": summarise_topics(d, refined, completer, text_col),
            "plot": plot_table(d, text_col, id_col)}


# ---------------------------------------------------------------- G8
JOINT_COLUMNS = ["row_id", "text", "topic", "total_cites", "embedding"]


def joint_corpora(abstracts: DataFrame, answers: DataFrame) -> DataFrame:
    """Both corpora in one schema (F13, F14 -> U2) with the coordinates of
    one projection over both (T14). Answers have no citations."""
    a = filters.with_constants(filters.project(abstracts, JOINT_COLUMNS), {"source": "abstracts"})
    g = filters.project(answers.withColumn("total_cites", F.lit(None).cast("bigint")), JOINT_COLUMNS)
    both = a.unionByName(filters.with_constants(g, {"source": "answers"}))
    return topics.project_2d(both.filter(F.col("embedding").isNotNull()), "embedding", "row_id")


def corpus_overlap(abstracts: DataFrame, answers: DataFrame, n: int = 3, vec: str = "embedding") -> DataFrame:
    """For each answer topic's first representative answer, of those that
    have a vector, the ``n`` most similar abstracts (W4 -> M6)."""
    reps = ranking.top_docs_per_topic(answers.filter(F.col(vec).isNotNull()), 5).filter(F.col("rank") == 1)
    q = reps.select(F.col("topic").cast("long").alias("topic"), F.col(vec).alias("embedding"))
    c = abstracts.select(F.col("row_id"), F.col(vec).alias("embedding"))
    return similarity.top_n_similar(q, c, n=n, q_id="topic")


# ---------------------------------------------------------------- G9
def heading_report(lines: DataFrame, top_per_group: int = 5, top_overall: int = 15) -> dict[str, DataFrame]:
    """Heading counts per (model, temperature) (A1), distinct headings
    (A2), top-5 per group with labels (W2 + X20), overall top-15 (A3 + W3)."""
    h = lines.withColumn("heading", tx.first_heading("line"))
    per = stats.count_per_group(h, ["gpt_model", "temperature", "heading"], drop_null=["heading"])
    top = ranking.top_n_per_group(per, ["gpt_model", "temperature"], [F.col("count").desc(), F.col("heading")],
                                  top_per_group)
    top = top.withColumn("label", tx.heading_label("heading", "gpt_model", "temperature"))
    overall = stats.count_per_group(h, ["heading"], drop_null=["heading"])
    return {"per_group": per, "distinct": stats.distinct_per_group(h, ["gpt_model", "temperature"], "heading"),
            "top_per_group": top,
            "top_overall": ranking.top_k(overall, [F.col("count").desc(), F.col("heading")], top_overall)}


# ---------------------------------------------------------------- G10
def temperature_table(plot_rows: DataFrame, model: str, temperatures: list[float]) -> DataFrame:
    """The plot table of one model at the chosen temperatures."""
    return filters.model_and_temperatures(plot_rows, model, temperatures)
