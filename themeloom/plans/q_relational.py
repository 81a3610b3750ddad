"""Registered queries: sources, filters, dedupe, joins, aggregates, ranking, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import dedupe, filters, joins, ranking, stats
from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.registry import register
from themeloom.sources import corpora as C


def _r(c, name=None):
    """round a double to 6 digits (both sides of the oracle do)"""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# ---------------------------------------------------------------- sources
@register("s2_parquet_scan", "select doc_id, lang, n_chars from documents where lang = 'en' and n_chars > 1000")
def s2_parquet_scan(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.filter((F.col("lang") == "en") & (F.col("n_chars") > 1000)).select("doc_id", "lang", "n_chars")


@register("s10_works_source", V("""
select ordinal, doi, cited_by_count, relevance_score from works where cited_by_count > 4
order by relevance_score desc, ordinal limit 100""", "works"))
def s10_works_source(spark, sf):
    return C.works_source(C.works(spark, sf), ">4", 100).select("ordinal", "doi", "cited_by_count", "relevance_score")


@register("s11_ranked_exports", V("""
select file_no, file_pos, doi, category from (
  select *, row_number() over (partition by file_no order by file_pos) as rn from abstracts) where rn <= 100""",
                                  "abstracts"))
def s11_ranked_exports(spark, sf):
    return C.ranked_export(C.abstract_exports(spark, sf), 100).select("file_no", "file_pos", "doi", "category")


# ---------------------------------------------------------------- filters
@register("f1_relevance_above", V("select ordinal, relevance_score from works where relevance_score > 10", "works"))
def f1_relevance_above(spark, sf):
    return filters.relevance_above(C.works(spark, sf), 10).select("ordinal", "relevance_score")


@register("f2_drop_null_title_abstract",
          V("select ordinal, title from works where title is not null and abstract is not null", "works"))
def f2_drop_null_title_abstract(spark, sf):
    return filters.drop_null(C.works(spark, sf), ["title", "abstract"]).select("ordinal", "title")


@register("f3_drop_null_biblio", V("""
select ordinal, volume, issue, pmid, journal, publisher, issn_l from works_flat
where volume is not null and issue is not null and first_page is not null and last_page is not null
  and pmid is not null and journal is not null and publisher is not null and issn_l is not null""", "works_flat"))
def f3_drop_null_biblio(spark, sf):
    flat = filters.unnest_works(C.works_nested(spark, sf))
    return filters.drop_null(flat, filters.BIBLIO_REQUIRED).select(
        "ordinal", "volume", "issue", "pmid", "journal", "publisher", "issn_l")


@register("f4_not_retracted", V("select ordinal from works where is_retracted = false", "works"))
def f4_not_retracted(spark, sf):
    return filters.not_retracted(C.works(spark, sf)).select("ordinal")


@register("f5_citation_predicate", V("""
select ordinal, cited_by_count, 'gt' as spec from works where cited_by_count > 4
union all select ordinal, cited_by_count, 'range' from works where cited_by_count between 10 and 20
union all select ordinal, cited_by_count, 'eq' from works where cited_by_count = 7""", "works"))
def f5_citation_predicate(spark, sf):
    w = C.works(spark, sf).select("ordinal", "cited_by_count")
    parts = [w.filter(filters.citation_predicate("cited_by_count", s)).withColumn("spec", F.lit(tag))
             for s, tag in ((">4", "gt"), ("10-20", "range"), ("7", "eq"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("f6_cited_or_core", V("""
select file_no, file_pos, total_cites, category from abstracts where total_cites >= 5 or category = 'main'""",
                                "abstracts"))
def f6_cited_or_core(spark, sf):
    return filters.cited_or_core(C.abstract_exports(spark, sf), 5).select("file_no", "file_pos", "total_cites", "category")


@register("f7_known_system_message", V("select row_id, gpt_model from answers where system_message is not null", "answers"))
def f7_known_system_message(spark, sf):
    return filters.known_system_message(C.answers(spark, sf)).select("row_id", "gpt_model")


@register("f8_drop_noise", V("select row_id, topic from topic_docs where topic <> -1", "topic_docs"))
def f8_drop_noise(spark, sf):
    return filters.drop_noise(C.topic_docs(spark, sf)).select("row_id", "topic")


@register("f9_select_topic", V("select row_id, topic from topic_docs where topic = 2", "topic_docs"))
def f9_select_topic(spark, sf):
    return filters.select_topic(C.topic_docs(spark, sf), 2).select("row_id", "topic")


@register("f10_model_temperatures", V("""
select row_id, gpt_model, temperature from answers where gpt_model = 'model-a' and temperature in (0.0, 0.5)""",
                                      "answers"))
def f10_model_temperatures(spark, sf):
    return filters.model_and_temperatures(C.answers(spark, sf), "model-a", [0.0, 0.5]).select(
        "row_id", "gpt_model", "temperature")


@register("f11_unnest_structs", V("""
select ordinal, volume, issue, first_page, last_page, pmid, journal, publisher, issn_l,
       "primary_topic.id", "primary_topic.display_name" from works_flat""", "works_flat"))
def f11_unnest_structs(spark, sf):
    flat = filters.unnest_works(C.works_nested(spark, sf))
    return flat.select("ordinal", "volume", "issue", "first_page", "last_page", "pmid", "journal",
                       "publisher", "issn_l", "`primary_topic.id`", "`primary_topic.display_name`")


@register("f12_drop_nested", V("select ordinal, doi, title, abstract, relevance_score, cited_by_count, is_retracted, lang from works",
                               "works"))
def f12_drop_nested(spark, sf):
    return filters.drop_nested(C.works_nested(spark, sf))


@register("f13_fixed_schema", V("""
select file_no, file_pos, title, total_cites as citations, abstract as doc from abstracts""", "abstracts"))
def f13_fixed_schema(spark, sf):
    return filters.project(C.abstract_exports(spark, sf), ["file_no", "file_pos", "title", "total_cites", "abstract"],
                           {"total_cites": "citations", "abstract": "doc"})


@register("f14_constant_columns", V("""
select row_id, 'gpt' as source, cast(null as bigint) as total_cites from answers""", "answers"))
def f14_constant_columns(spark, sf):
    a = C.answers(spark, sf).select("row_id")
    return filters.with_constants(a, {"source": "gpt"}).withColumn("total_cites", F.lit(None).cast("bigint"))


@register("f15_fill_label", V("""
select file_pos, coalesce(title, 'NA') as title, coalesce(cast(total_cites as varchar), '--') as total_cites
from abstracts""", "abstracts"))
def f15_fill_label(spark, sf):
    a = C.abstract_exports(spark, sf).select("file_pos", "title", F.col("total_cites").cast("string").alias("total_cites"))
    return filters.fill_label(a, {"title": "NA", "total_cites": "--"})


@register("f16_cast_topic", V("select row_id, cast(cast(topic as varchar) as integer) as topic from topic_docs",
                              "topic_docs"))
def f16_cast_topic(spark, sf):
    t = C.topic_docs(spark, sf).select("row_id", F.col("topic").cast("string").alias("topic"))
    return filters.cast_topic(t)


@register("f17_snake_case_columns", """
select doc_id as doc_id, lang as language_code, n_chars as n_chars_total from documents""")
def f17_snake_case_columns(spark, sf):
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("Doc ID"), F.col("lang").alias("Language-Code:"),
                                               F.col("n_chars").alias("__N chars (total)"))
    return filters.snake_case_columns(d)


# ---------------------------------------------------------------- dedupe
@register("d1_distinct_rows", V("""
select doi, title, category, total_cites, min(cast(file_no as bigint) * 1000000000 + file_pos) as first_pos
from abstracts group by doi, title, category, total_cites""", "abstracts"))
def d1_distinct_rows(spark, sf):
    a = C.abstract_exports(spark, sf).select("file_no", "file_pos", "doi", "title", "category", "total_cites")
    d = dedupe.distinct_rows(a, ["file_no", "file_pos"])
    return d.select("doi", "title", "category", "total_cites",
                    (F.col("file_no").cast("bigint") * 1_000_000_000 + F.col("file_pos")).alias("first_pos"))


@register("d2_dedupe_doi_then_title", V("""
select ordinal, doi, title from (
  select *, row_number() over (partition by title order by ordinal) as rt from (
    select *, row_number() over (partition by doi order by ordinal) as rd from works) where rd = 1)
where rt = 1""", "works"))
def d2_dedupe_doi_then_title(spark, sf):
    return dedupe.dedupe_doi_then_title(C.works(spark, sf)).select("ordinal", "doi", "title")


D3_SQL = """
select doi,
  arg_min(title, cast(file_no as bigint) * 1000000000 + file_pos) filter (where title is not null) as title,
  arg_min(category, cast(file_no as bigint) * 1000000000 + file_pos) filter (where category is not null) as category,
  arg_min(total_cites, cast(file_no as bigint) * 1000000000 + file_pos) filter (where total_cites is not null) as total_cites,
  md5(arg_min(abstract, cast(file_no as bigint) * 1000000000 + file_pos) filter (where abstract is not null)) as abstract_md5
from abstracts where doi is not null group by doi"""


@register("d3_merge_first_non_null", V(D3_SQL, "abstracts"))
def d3_merge_first_non_null(spark, sf):
    m = dedupe.merge_first_non_null(C.abstract_exports(spark, sf), "doi", ["file_no", "file_pos"])
    return m.select("doi", "title", "category", "total_cites", F.md5("abstract").alias("abstract_md5"))


@register("d4_title_dedupe_smallest_doi", V(f"""
select doi, title from (select *, row_number() over (partition by title order by doi) as rn from ({D3_SQL}))
where rn = 1""", "abstracts"))
def d4_title_dedupe_smallest_doi(spark, sf):
    m = dedupe.merge_first_non_null(C.abstract_exports(spark, sf), "doi", ["file_no", "file_pos"])
    return dedupe.title_dedupe_smallest_doi(m).select("doi", "title")


# ---------------------------------------------------------------- joins
TOPIC_INFO_SQL = """
select topic as "Topic", count(*) as "Count",
       cast(topic as varchar) || '_' || 'topic' as "Name"
from topic_docs group by topic"""


def _topic_info(spark, sf):
    td = C.topic_docs(spark, sf)
    info = stats.topic_info(td)
    return info.withColumn("Name", F.concat(F.col("Topic").cast("string"), F.lit("_topic")))


@register("j1_docs_with_topic_info", V(f"""
select d.row_id, d.topic, i."Name" from topic_docs d
left join (select * from ({TOPIC_INFO_SQL}) where "Topic" <> 3) i on d.topic = i."Topic"
""", "topic_docs"))
def j1_docs_with_topic_info(spark, sf):
    td = C.topic_docs(spark, sf).select("row_id", "topic")
    info = _topic_info(spark, sf).filter(F.col("Topic") != 3)  # topic 3 unnamed: its rows get nulls
    return joins.with_topic_info(td, info).select("row_id", "topic", "Name")


@register("j2_join_on_text", V("""
select a.file_pos, t.row_id from abstracts a left join topic_docs t on a.abstract = t.title_abstract""",
                                "abstracts", "topic_docs"))
def j2_join_on_text(spark, sf):
    a = C.abstract_exports(spark, sf).select("file_pos", F.col("abstract").alias("doc"))
    t = C.topic_docs(spark, sf).select("row_id", "title_abstract")
    return joins.with_documents_by_text(a, t, "doc", "title_abstract").select("file_pos", "row_id")


@register("j3_rows_with_summaries", V("""
select d.row_id, s.topic_name from topic_docs d left join
  (select topic, 'name ' || cast(topic as varchar) as topic_name from topic_docs where topic % 2 = 0 group by topic) s
on d.topic = s.topic""", "topic_docs"))
def j3_rows_with_summaries(spark, sf):
    td = C.topic_docs(spark, sf)
    summ = (td.filter(F.col("topic") % 2 == 0).select("topic").distinct()
            .withColumn("topic_name", F.concat(F.lit("name "), F.col("topic").cast("string"))))
    return joins.with_summaries(td.select("row_id", "topic"), summ).select("row_id", "topic_name")


@register("j4_counts_with_names", V("""
select c.topic, c.n, s.topic_name from (select topic, count(*) as n from topic_docs group by topic) c
join (select topic, 'name ' || cast(topic as varchar) as topic_name from topic_docs where topic % 2 = 0 group by topic) s
on c.topic = s.topic""", "topic_docs"))
def j4_counts_with_names(spark, sf):
    td = C.topic_docs(spark, sf)
    counts = td.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    names = (td.filter(F.col("topic") % 2 == 0).select("topic").distinct()
             .withColumn("topic_name", F.concat(F.lit("name "), F.col("topic").cast("string"))))
    return joins.counts_with_names(counts, names).select("topic", "n", "topic_name")


@register("j5_align_by_row_id", V("""
select a.row_id, a.gpt_model, t.topic, e.vec_id % 7 as x
from answers a join (select row_id, row_id % 5 as topic from answers) t on a.row_id = t.row_id
join (select vec_id, vec_id * 100 + unnest(range(0, 100)) as row_id from embeddings) e on a.row_id = e.row_id""", "answers"))
def j5_align_by_row_id(spark, sf):
    a = C.answers(spark, sf).select("row_id", "gpt_model")
    t = C.answers(spark, sf).select("row_id", (F.col("row_id") % 5).alias("topic"))
    # a vector stands for all turns of its conversation
    turn = F.explode(F.sequence(F.lit(0), F.lit(99)))
    e = C.table(spark, sf, "embeddings").select("vec_id", turn.alias("turn")).select(
        (F.col("vec_id") * 100 + F.col("turn")).alias("row_id"), (F.col("vec_id") % 7).alias("x"))
    return joins.align_by_row_id(a, t, e).select("row_id", "gpt_model", "topic", "x")


@register("j7_pending_requests", V("""
with g as (select distinct gpt_model, temperature from answers where system_message is not null),
grid as (select gpt_model, temperature, cast(unnest(range(0, 50)) as bigint) as sample from g),
done as (select gpt_model, temperature,
           cast(row_number() over (partition by gpt_model, temperature order by row_id) - 1 as bigint) as sample
         from answers where system_message is not null)
select * from grid anti join done using (gpt_model, temperature, sample)""", "answers"))
def j7_pending_requests(spark, sf):
    from pyspark.sql import Window
    a = filters.known_system_message(C.answers(spark, sf))
    grid = joins.request_grid(a.select("gpt_model", "temperature").distinct(), 50)
    w = Window.partitionBy("gpt_model", "temperature").orderBy("row_id")
    done = a.select("gpt_model", "temperature", (F.row_number().over(w) - 1).cast("bigint").alias("sample"))
    return joins.pending_requests(grid, done, ["gpt_model", "temperature", "sample"])


@register("j8_request_grid", V("""
select gpt_model, temperature, cast(unnest(range(0, 50)) as bigint) as sample
from (select distinct gpt_model, temperature from answers)""", "answers"))
def j8_request_grid(spark, sf):
    return joins.request_grid(C.answers(spark, sf).select("gpt_model", "temperature").distinct(), 50)


# ---------------------------------------------------------------- aggregates
HEADING_SQL_EXPR = """lower(trim(regexp_replace(regexp_replace(
  regexp_extract(line, '\\d+\\.\\s*(\\*\\*.*?\\*\\*|[^:*]*):', 1), '^\\*\\*(.*?)\\*\\*$', '\\1'), '[.:]+$', '')))"""

HEADINGS_SQL = f"""
select row_id, gpt_model, temperature, pos,
  case when regexp_matches(line, '\\d+\\.\\s*(\\*\\*.*?\\*\\*|[^:*]*):') then {HEADING_SQL_EXPR} end as heading
from answer_lines"""


def _headings(spark, sf):
    from themeloom.functions import text as tx
    al = C.answer_lines(spark, sf)
    return al.select("row_id", "gpt_model", "temperature", "pos", tx.first_heading("line").alias("heading"))


@register("a1_count_per_group", V(f"""
select gpt_model, temperature, heading, count(*) as count from ({HEADINGS_SQL})
where heading is not null group by all""", "answer_lines"))
def a1_count_per_group(spark, sf):
    return stats.count_per_group(_headings(spark, sf), ["gpt_model", "temperature", "heading"], drop_null=["heading"])


@register("a2_distinct_per_group", V(f"""
select gpt_model, temperature, count(distinct heading) as n_distinct from ({HEADINGS_SQL}) group by all""",
                                     "answer_lines"))
def a2_distinct_per_group(spark, sf):
    return stats.distinct_per_group(_headings(spark, sf), ["gpt_model", "temperature"], "heading")


@register("a3_count_per_heading", V(f"""
select heading, count(*) as count from ({HEADINGS_SQL}) where heading is not null group by heading""",
                                    "answer_lines"))
def a3_count_per_heading(spark, sf):
    return stats.count_per_group(_headings(spark, sf), ["heading"], drop_null=["heading"])


@register("a4_smallest_group", V("""
select min(n) as min_group_size from (select count(*) as n from answers where system_message is not null
group by gpt_model, temperature)""", "answers"))
def a4_smallest_group(spark, sf):
    return stats.smallest_group_size(filters.known_system_message(C.answers(spark, sf)), ["gpt_model", "temperature"])


@register("a5_count_at_minimum", V("""
select min(cited_by_count) as min_value,
       count(*) filter (where cited_by_count = (select min(cited_by_count) from works where relevance_score > 10))
         as n_at_min
from works where relevance_score > 10""", "works"))
def a5_count_at_minimum(spark, sf):
    return stats.count_at_minimum(filters.relevance_above(C.works(spark, sf), 10), "cited_by_count")


@register("a6_quartiles", V("""
select round(quantile_cont(cited_by_count, 0.25), 6) as q25, round(quantile_cont(cited_by_count, 0.5), 6) as q50,
       round(quantile_cont(cited_by_count, 0.75), 6) as q75 from works""", "works"))
def a6_quartiles(spark, sf):
    q = stats.quartiles(C.works(spark, sf), "cited_by_count")
    return q.select(_r("q25"), _r("q50"), _r("q75"))


@register("a7_value_counts", V("""
select journal, count(*) as count from works group by journal
union all select 'lang:' || coalesce(lang, 'null'), count(*) from works group by lang""", "works"))
def a7_value_counts(spark, sf):
    w = C.works(spark, sf)
    a = stats.value_counts(w, "journal")
    b = stats.value_counts(w, "lang", include_null=True).select(
        F.concat(F.lit("lang:"), F.coalesce(F.col("lang"), F.lit("null"))).alias("journal"), "count")
    return a.unionByName(b)


@register("a8_distinct_values", V("select distinct topic from topic_docs", "topic_docs"))
def a8_distinct_values(spark, sf):
    return stats.distinct_values(C.topic_docs(spark, sf), "topic")


PRETOKEN_SQL = "len(regexp_extract_all(title || '. ' || abstract, '\\p{L}+|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]+'))"


@register("a9_count_over_limit", V(f"""
select cast(count(*) filter (where {PRETOKEN_SQL} > 2000) as bigint) as n_over from works""", "works"))
def a9_count_over_limit(spark, sf):
    from themeloom.functions import text as tx
    w = C.works(spark, sf).withColumn("num_tokens", tx.token_count_estimate(
        F.concat(F.col("title"), F.lit(". "), F.col("abstract"))))
    return stats.count_over(w, "num_tokens", 2000)


@register("a10_row_max_probability", V("""
select vec_id, round(cast(list_max(embedding) as double), 6) as probability
from embeddings"""))
def a10_row_max_probability(spark, sf):
    e = C.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(stats.row_max_probability(F.col("embedding").cast("array<double>")), 6)
                    .alias("probability"))


@register("a11_topic_info", V(TOPIC_INFO_SQL, "topic_docs"))
def a11_topic_info(spark, sf):
    return _topic_info(spark, sf)


@register("a12_filter_funnel", V("""
select cast(count(*) as bigint) as input,
  cast(count(*) filter (where relevance_score > 10) as bigint) as relevance,
  cast(count(*) filter (where relevance_score > 10 and title is not null and abstract is not null) as bigint) as not_null,
  cast(count(*) filter (where relevance_score > 10 and title is not null and abstract is not null
                        and is_retracted = false) as bigint) as not_retracted
from works""", "works"))
def a12_filter_funnel(spark, sf):
    return stats.funnel(C.works(spark, sf), [
        ("relevance", F.col("relevance_score") > 10),
        ("not_null", F.col("title").isNotNull() & F.col("abstract").isNotNull()),
        ("not_retracted", F.col("is_retracted") == F.lit(False)),
    ])


@register("a13_join_ranked_texts", V("""
select topic, string_agg(title_abstract, chr(10) order by rank) as texts from (
  select topic, title_abstract, row_number() over (partition by topic order by probability desc, row_id) as rank
  from topic_docs) where rank <= 3 group by topic""", "topic_docs"))
def a13_join_ranked_texts(spark, sf):
    td = C.topic_docs(spark, sf)
    top = ranking.top_n_per_group(td, ["topic"], [F.col("probability").desc(), F.col("row_id")], 3)
    return stats.join_ranked_texts(top, "topic", "rank", "title_abstract")


# ---------------------------------------------------------------- ranking
@register("w1_sort_mixed", V(f"""
select gpt_model, temperature, heading, count(*) as count from ({HEADINGS_SQL})
where heading is not null group by all""", "answer_lines"))
def w1_sort_mixed(spark, sf):
    c = stats.count_per_group(_headings(spark, sf), ["gpt_model", "temperature", "heading"], drop_null=["heading"])
    return ranking.sort_mixed(c, [("gpt_model", True), ("temperature", True), ("count", False)])


@register("w2_top5_per_group", V(f"""
select * from (select gpt_model, temperature, heading, count,
   cast(row_number() over (partition by gpt_model, temperature order by count desc, heading) as bigint) as rank
 from (select gpt_model, temperature, heading, count(*) as count from ({HEADINGS_SQL})
       where heading is not null group by all)) where rank <= 5""", "answer_lines"))
def w2_top5_per_group(spark, sf):
    c = stats.count_per_group(_headings(spark, sf), ["gpt_model", "temperature", "heading"], drop_null=["heading"])
    return ranking.top_n_per_group(c, ["gpt_model", "temperature"], [F.col("count").desc(), F.col("heading")], 5)


@register("w3_global_top15", V(f"""
select heading, count(*) as count from ({HEADINGS_SQL}) where heading is not null
group by heading order by count desc, heading limit 15""", "answer_lines"))
def w3_global_top15(spark, sf):
    c = stats.count_per_group(_headings(spark, sf), ["heading"], drop_null=["heading"])
    return ranking.top_k(c, [F.col("count").desc(), F.col("heading")], 15)


W4_SQL = """
select row_id, topic, rank from (
  select *, cast(row_number() over (partition by topic order by
      (case when n1 >= 5 then cast(total_cites as double) else probability end) desc nulls last, row_id) as bigint) as rank
  from (select d.*, f.n1 from topic_docs d join
        (select topic, sum(case when probability = 1.0 then 1 else 0 end) as n1 from topic_docs where topic <> -1
         group by topic) f on d.topic = f.topic)
  where n1 < 5 or probability = 1.0)
where rank <= 5"""


@register("w4_top_docs_per_topic", V(W4_SQL, "topic_docs"))
def w4_top_docs_per_topic(spark, sf):
    return ranking.top_docs_per_topic(C.topic_docs(spark, sf), 5).select("row_id", "topic", "rank")


@register("w5_top_k", V("""
select ordinal, relevance_score from works order by relevance_score desc, ordinal limit 100""", "works"))
def w5_top_k(spark, sf):
    return ranking.top_k(C.works(spark, sf), [F.col("relevance_score").desc(), F.col("ordinal")], 100).select(
        "ordinal", "relevance_score")


@register("w6_balanced_sample", V("""
with a as (select * from answers where system_message is not null),
n as (select least(100, min(c)) as n from (select count(*) as c from a group by gpt_model, temperature))
select row_id, gpt_model, temperature from (
  select *, row_number() over (partition by gpt_model, temperature
                               order by md5('42' || '|' || cast(row_id as varchar)), row_id) as rn from a)
where rn <= (select n from n)""", "answers"))
def w6_balanced_sample(spark, sf):
    a = filters.known_system_message(C.answers(spark, sf))
    return ranking.balanced_sample(a, ["gpt_model", "temperature"], "row_id", 100, 42).select(
        "row_id", "gpt_model", "temperature")


@register("w7_file_order_head", V("""
select file_no, file_pos, 'wider' as category from (
  select *, row_number() over (partition by file_no order by file_pos) as rn from abstracts where file_no <> 0) where rn <= 20""",
                                   "abstracts"))
def w7_file_order_head(spark, sf):
    """The first rows of each file in file order."""
    a = C.abstract_exports(spark, sf).filter("file_no <> 0").drop("category")
    return C.ranked_export(a, 20, category="wider").select("file_no", "file_pos", "category")


# ---------------------------------------------------------------- sets
@register("u1_concat_exports", V("""
select file_no, file_pos, doi, category from abstracts where file_no = 0
union all select file_no, file_pos, doi, 'wider' from abstracts where file_no <> 0""", "abstracts"))
def u1_concat_exports(spark, sf):
    a = C.abstract_exports(spark, sf).select("file_no", "file_pos", "doi")
    files = [a.filter(F.col("file_no") == i).withColumn("category", F.lit("main" if i == 0 else "wider")) for i in range(4)]
    return C.concat_exports(*files)


@register("u2_concat_corpora", V("""
select 'abstracts' as source, file_pos as id, total_cites, cast(null as varchar) as gpt_model from abstracts
union all select 'gpt', row_id, null, gpt_model from answers""", "abstracts", "answers"))
def u2_concat_corpora(spark, sf):
    a = filters.with_constants(C.abstract_exports(spark, sf).select(F.col("file_pos").alias("id"), "total_cites"),
                               {"source": "abstracts"})
    g = filters.with_constants(C.answers(spark, sf).select(F.col("row_id").alias("id"), "gpt_model"),
                               {"source": "gpt"})
    return a.unionByName(g, allowMissingColumns=True)


@register("u3_concat_group_results", V("""
select gpt_model, temperature, count(*) as n, null as longest from answers where temperature = 0.0 group by all
union all select gpt_model, temperature, null, max(length(text)) from answers where temperature <> 0.0 group by all""", "answers"))
def u3_concat_group_results(spark, sf):
    """Results of separately run groups, of different columns, as one table."""
    a = C.answers(spark, sf)
    cold = a.filter(F.col("temperature") == 0.0).groupBy("gpt_model", "temperature").agg(F.count("*").alias("n"))
    warm = a.filter(F.col("temperature") != 0.0).groupBy("gpt_model", "temperature").agg(
        F.max(F.length("text")).cast("bigint").alias("longest"))
    return C.concat_exports(cold, warm)
