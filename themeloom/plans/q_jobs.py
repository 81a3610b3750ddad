"""Registered queries: whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import topics
from themeloom.plans import jobs
from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.q_retrieval import QUESTION, bm25_sql
from themeloom.plans.q_text import SQL_HEADINGS, fill, sql_clean
from themeloom.plans.q_text import drawn
from themeloom.plans.q_topics import CTFIDF_SQL, FIRST_SENTENCE, TOP_SQL, embed_sql
from themeloom.plans.registry import register
from themeloom.session import shared_folder
from themeloom.sources import corpora as C

G1_SQL = V(f"""
with base as (
  select w.ordinal, w.doi, w.title, w.abstract, w.relevance_score, w.is_retracted,
         f.volume, f.issue, f.first_page, f.last_page, f.pmid, f.journal, f.publisher, f.issn_l
  from works w join works_flat f using (ordinal)
  where w.title is not null and w.abstract is not null and w.relevance_score > 10 and w.doi is not null
    and f.volume is not null and f.issue is not null and f.first_page is not null and f.last_page is not null
    and f.pmid is not null and f.journal is not null and f.publisher is not null and f.issn_l is not null),
d1 as (select * exclude (rn) from (select *, row_number() over (partition by doi order by ordinal) as rn from base)
       where rn = 1),
d2 as (select * exclude (rn) from (select *, row_number() over (partition by title order by ordinal) as rn from d1)
       where rn = 1),
cl as (select *, {sql_clean('abstract')} as abstract_clean from d2),
ta as (select *, title || case when title like '%.' then ' ' else '. ' end || abstract_clean as title_abstract
       from cl where is_retracted = false),
sc as ({bm25_sql(QUESTION, 'select ordinal, title_abstract from ta', 'ordinal', 'title_abstract')})
select ta.ordinal, ta.doi, round(sc.bm25_score, 6) as bm25_score,
       cast(len(regexp_extract_all(ta.title_abstract, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+')) as bigint)
         as num_tokens
from ta join sc using (ordinal)
order by sc.bm25_score desc, ta.ordinal limit 100""", "works", "works_flat")


@register("g1_works_ranked", G1_SQL)
def g1_works_ranked(spark, sf):
    r = jobs.works_ranked(C.works_nested(spark, sf), QUESTION, 10, 100)
    return r.select("ordinal", "doi", F.round("bm25_score", 6).alias("bm25_score"), "num_tokens")


@register("g1_works_funnel", V("""
with a as (select w.ordinal, w.doi, w.title, w.abstract, w.is_retracted,
             w.title is not null and w.abstract is not null as s1,
             s1 and coalesce(w.relevance_score > 10, false) as s2,
             s2 and w.doi is not null and f.volume is not null and f.issue is not null and f.first_page is not null
               and f.last_page is not null and f.pmid is not null and f.journal is not null and f.publisher is not null
               and f.issn_l is not null as s3
           from works w join works_flat f using (ordinal)),
b as (select *, s3 and row_number() over (partition by doi, s3 order by ordinal) = 1 as s4 from a),
c as (select *, s4 and row_number() over (partition by title, s4 order by ordinal) = 1 as s5 from b),
d as (select *, s5 and not is_retracted as s6, <CLEAN> as abstract_clean from c),
e as (select *, title || case when title like '%.' then ' ' else '. ' end || abstract_clean as ta from d)
select count(*) as input, count_if(s1) as not_null, count_if(s2) as relevance, count_if(s3) as biblio, count_if(s4) as by_doi,
       count_if(s5) as by_title, count_if(s6) as not_retracted,
       count_if(s6 and len(regexp_extract_all(ta, '\\p{L}+|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]+')) > 500) as over_long
from e""".replace("<CLEAN>", sql_clean("abstract")), "works", "works_flat"))
def g1_works_funnel(spark, sf):
    """The G1 filter funnel as one row of stage counts."""
    return jobs.works_funnel(C.works_nested(spark, sf), long_tokens=500)


G2_CTES = f"""
a as (select * exclude (rn) from (
             select *, row_number() over (partition by file_no order by file_pos) as rn from abstracts)
           where rn <= 1000),
b as (select *, cast(file_no as bigint) * 1000000000 + file_pos as ord from a
      where title is not null and abstract is not null and doi is not null),
m as (select doi,
        arg_min(title, ord) filter (where title is not null) as title,
        arg_min(abstract, ord) filter (where abstract is not null) as abstract,
        arg_min(category, ord) filter (where category is not null) as category,
        arg_min(total_cites, ord) filter (where total_cites is not null) as total_cites
      from b group by doi),
c as (select *, {sql_clean('abstract')} as abstract_clean from m),
t as (select *, title || case when title like '%.' then ' ' else '. ' end || abstract_clean as title_abstract from c),
d as (select * exclude (rn) from (select *, row_number() over (partition by title order by doi) as rn from t)
      where rn = 1),
prepared as (select * from d where total_cites >= 5 or category = 'main')"""
G2_SQL = V(f"""with {G2_CTES}
select doi, title, md5(title_abstract) as ta_md5, category, total_cites from prepared""", "abstracts")


@register("g2_abstracts_prepared", G2_SQL)
def g2_abstracts_prepared(spark, sf):
    a = jobs.abstracts_prepared(C.abstract_exports(spark, sf), 1000)
    return a.select("doi", "title", F.md5("title_abstract").alias("ta_md5"), "category", "total_cites")


@register("g2_abstracts_embedded", V(f"""with {G2_CTES},
texts as (select doi, title_abstract as text from prepared),
{embed_sql('texts', 'doi', 384)},
nz as (select doi, count(*) as n from ef where abs(v) > 1e-6 group by doi)
select p.doi, p.title, md5(p.abstract) as abstract_md5, md5(p.abstract_clean) as clean_md5, md5(p.title_abstract) as ta_md5,
       p.category, p.total_cites, 384 as dim, coalesce(nz.n, 0) as n_nonzero
from prepared p left join nz using (doi)""", "abstracts"))
def g2_abstracts_embedded(spark, sf):
    """G2 to its end: the first 1,000 of each export, merged, cleaned, deduplicated, embedded, in the fixed columns."""
    a = jobs.abstracts_embedded(C.abstract_exports(spark, sf))
    if a.columns != ["doi", "title", "abstract", "abstract_clean", "title_abstract", "category", "total_cites", "embeddings"]:
        raise ValueError(f"columns of the prepared abstracts: {a.columns}")
    found = F.filter("embeddings", lambda x: F.abs(x) > 1e-8)
    return a.select("doi", "title", F.md5("abstract").alias("abstract_md5"), F.md5("abstract_clean").alias("clean_md5"),
                    F.md5("title_abstract").alias("ta_md5"), "category", "total_cites", F.size("embeddings").alias("dim"),
                    F.size(found).cast("bigint").alias("n_nonzero"))


G3_SQL = V(f"""
with rec as (
  select row_id, gpt_model, temperature, system_message,
         list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
                        lambda x, i: cast(i as varchar) || '. **' || split_part(x, ' ', 1) || '**: ' || x) as answer
  from answers),
f as (select * from rec where system_message is not null),
n as (select least(100, min(c)) as n from (select count(*) as c from f group by gpt_model, temperature)),
s as (select * from (select *, row_number() over (partition by gpt_model, temperature
                       order by md5('42' || '|' || cast(row_id as varchar)), row_id) as rn from f)
      where rn <= (select n from n)),
l as (select row_id, cast(generate_subscripts(answer, 1) - 1 as bigint) as pos, unnest(answer) as line
      from s where len(answer) > 0
      union all select row_id, null, null from s where len(answer) = 0)
select row_id, pos, {fill(SQL_HEADINGS, 'line')}[1] as heading,
       regexp_replace(line, '^\\d+\\.|[*]', '', 'g') as answer_cleaned from l""", "answers")


@register("g3_answers_long", G3_SQL)
def g3_answers_long(spark, sf):
    long = jobs.answers_long(C.answer_records(spark, sf))
    return long.select("row_id", "pos", "heading", "answer_cleaned")


G4_SQL = f"""
with recursive base as (select vec_id, embedding from embeddings where vec_id in (select doc_id from documents)),
e as (select a.vec_id as s, b.vec_id as d from base a join base b on a.vec_id <> b.vec_id
      where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.35),
r(id, c) as (select vec_id, vec_id from base union select e.d, r.c from r join e on r.id = e.s),
comp as (select id, min(c) as label from r group by id),
sz as (select label, count(*) as size from comp group by label),
num as (select label, cast(row_number() over (order by size desc, label) - 1 as integer) as topic from sz where size >= 10),
topic_docs as (select coalesce(num.topic, -1) as topic, d.text as title_abstract
               from comp left join num using (label) join documents d on d.doc_id = comp.id), {CTFIDF_SQL},
names as (select topic, cast(topic as varchar) || '_' || string_agg(term, '_' order by rank) as nm
          from kw where rank <= 4 group by topic)
select t.topic as "Topic", count(*) as "Count", n.nm as "Name" from topic_docs t left join names n using (topic) group by all"""


@register("g4_discover_topics", G4_SQL)
def g4_discover_topics(spark, sf):
    """Reduction, density topics on the vectors, keywords from the texts, saved
    and read back. All 64 dimensions are kept, which leaves similarities as
    they are, so that SQL can restate the topics."""
    td = C.topic_docs(spark, sf, with_vector=True)
    td = td.drop("topic", "probability").withColumnRenamed("title_abstract", "text")
    folder = shared_folder(spark, "topic-model")
    jobs.discover_topics(td, 0.35, 10, block_rows=128, reduce_to=64, save_to=folder)
    return topics.load_topic_model(spark, folder)["topics"].select("Topic", "Count", "Name")


# the same topics merged to two, one merge at a time
G4_MERGED_SQL = G4_SQL.replace("""topic_docs as (select coalesce(num.topic, -1) as topic, d.text as title_abstract
               from comp left join num using (label) join documents d on d.doc_id = comp.id)""", """found as (
  select comp.id, coalesce(num.topic, -1) as topic from comp left join num using (label)),
part as (select f.topic, cast(generate_subscripts(b.embedding, 1) as bigint) as i, cast(unnest(b.embedding) as double) as v
         from found f join base b on b.vec_id = f.id where f.topic <> -1),
cent as (select topic, list(v order by i) as centroid from (select topic, i, avg(v) as v from part group by all) group by topic),
near as (select a.topic as x, b.topic as y, list_cosine_similarity(a.centroid, b.centroid) as s from cent a join cent b on a.topic <> b.topic),
merging(step, topic, grp) as (
  select 0, topic, topic from cent
  union all
  select m.step + 1, m.topic, case when m.grp = p.b then p.a else m.grp end
  from merging m, (select a.grp as a, b.grp as b from merging a join merging b on a.grp < b.grp
                   join near on near.x = a.topic and near.y = b.topic
                   group by a.grp, b.grp order by round(avg(s), 9) desc, a.grp, b.grp limit 1) p),
old as (select topic, grp from merging where step = greatest((select count(*) from cent) - 2, 0)),
by_size as (select grp, cast(row_number() over (order by count(*) desc, grp) - 1 as integer) as fresh
            from old join found using (topic) group by grp),
topic_docs as (select coalesce(by_size.fresh, -1) as topic, d.text as title_abstract
               from found left join old using (topic) left join by_size using (grp) join documents d on d.doc_id = found.id)""")


@register("g4_discover_merged", G4_MERGED_SQL)
def g4_discover_merged(spark, sf):
    """G4 with the topics merged to two (T11), named from the merged texts."""
    td = C.topic_docs(spark, sf, with_vector=True)
    td = td.drop("topic", "probability").withColumnRenamed("title_abstract", "text")
    found = jobs.discover_topics(td, 0.35, 10, block_rows=128, reduce_to=64, n_topics=2)
    return found["topics"].select("Topic", "Count", "Name")


@register("g5_summarise_topics", V(f"""with {TOP_SQL}
select topic, count(*) as n_docs, md5(string_agg(title_abstract, chr(10) order by rank)) as docs_md5,
       {FIRST_SENTENCE} as topic_description from top group by topic""", "topic_docs"))
def g5_summarise_topics(spark, sf):
    """W4 -> L3 -> L4 -> L5 on the given topics, from the refined keywords
    (which the offline encoder ranks: SQL cannot restate the name made of them)."""
    d = C.topic_docs(spark, sf).withColumnRenamed("title_abstract", "text")
    s = jobs.summarise_topics(d, jobs.refined_keywords(d)[1])
    return s.select("topic", F.size("representative_docs").cast("bigint").alias("n_docs"),
                    F.md5(F.array_join("representative_docs", "\n")).alias("docs_md5"), "topic_description")


@register("g6_topic_bar_counts", V("""
with n as (select topic, 'name ' || cast(topic as varchar) as topic_name from topic_docs where topic % 2 = 0
           group by topic)
select c.topic, c.count, n.topic_name from (select topic, count(*) as count from topic_docs where topic <> -1
  group by topic) c join n using (topic)""", "topic_docs"))
def g6_topic_bar_counts(spark, sf):
    td = C.topic_docs(spark, sf)
    names = (td.filter(F.col("topic") % 2 == 0).select("topic").distinct()
             .withColumn("topic_name", F.concat(F.lit("name "), F.col("topic").cast("string"))))
    return jobs.topic_bar_counts(td, names)


@register("g6_topic_map", V(f"""
with q as (select cast(floor(quantile_cont(cast(total_cites as double), 0.25)) as bigint) as q1,
             cast(floor(quantile_cont(cast(total_cites as double), 0.5)) as bigint) as q2,
             cast(floor(quantile_cont(cast(total_cites as double), 0.75)) as bigint) as q3 from topic_docs where topic <> -1)
select row_id, topic, case when total_cites < q1 then '5-' || (q1 - 1) when total_cites < q2 then q1 || '-' || (q2 - 1)
         when total_cites < q3 then q2 || '-' || (q3 - 1) else q3 || '+' end as citation_band,
       round(0.05 * sqrt(-2 * ln({drawn(7, 0, 'row_id')})) * cos(2 * pi() * {drawn(7, 1, 'row_id')}), 6) as dx,
       round(0.05 * sqrt(-2 * ln({drawn(8, 0, 'row_id')})) * cos(2 * pi() * {drawn(8, 1, 'row_id')}), 6) as dy
from topic_docs, q where topic <> -1 and embedding is not null""", "topic_docs"))
def g6_topic_map(spark, sf):
    """The citation-sized map: bands, and how far each point is moved."""
    m = jobs.topic_map(jobs.plot_table(C.topic_docs(spark, sf), text_col="title_abstract"))
    return m.select("row_id", "topic", "citation_band", F.round(F.col("x_shown") - F.col("x"), 6).alias("dx"),
                    F.round(F.col("y_shown") - F.col("y"), 6).alias("dy"))


@register("g6_topic_hulls", V("""
select topic, true as closed, true as enough from topic_docs where topic <> -1 and embedding is not null
group by topic having count(*) >= 3""", "topic_docs"))
def g6_topic_hulls(spark, sf):
    """The outline of each topic on the map: a closed ring of three corners or more."""
    xy = topics.project_2d(C.topic_docs(spark, sf).filter("embedding is not null"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("order", "x", "y"))), lambda p: F.struct(p["x"], p["y"]))
    return (jobs.topic_hulls(xy).groupBy("topic").agg(ring.alias("ring"))
            .select("topic", (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"), (F.size("ring") >= 4).alias("enough")))


@register("g7_recluster_topic", V("""
select row_id, true as placed, true as in_range from topic_docs where topic = 2""", "topic_docs"))
def g7_recluster_topic(spark, sf):
    """Topic 2 re-split by two keyword lists, the rest clustered: every document
    comes back once, with coordinates unless it is noise, and a topic of the
    user's, a fresh one or -1."""
    td = C.topic_docs(spark, sf).withColumnRenamed("title_abstract", "text")
    lists = spark.createDataFrame([(0, "the, and, of the"), (1, "der, die, das")], "topic int, keywords string")
    out = jobs.recluster_topic(td, 2, lists, 0.3, 0.6, 5)
    plot = out["plot"].select("row_id", F.col("x").isNotNull().alias("seen"), F.col("Name").alias("named"))
    d = out["documents"].join(plot, "row_id", "left")
    return d.select("row_id", (F.coalesce("seen", F.lit(False)) == (F.col("topic") != -1)).alias("placed"),
                    (F.col("topic") >= -1).alias("in_range"))


def _embedded_corpora(spark, sf):
    """Documents as abstracts and assistant turns as answers, embedded alike."""
    from themeloom.operators import embed
    from themeloom.session import stage

    d = C.topic_docs(spark, sf).select("row_id", F.col("title_abstract").alias("text"), "topic", "total_cites")
    a = C.answers(spark, sf).select("row_id", "text", (F.col("row_id") % 5).cast("int").alias("topic"),
                                    ((F.col("row_id") % 100) / 100).alias("probability"))
    return [stage(embed.embed(x, "text", "embedding", dim=64), "g8") for x in (d, a)]


@register("g8_joint_corpora", V("""
select 'abstracts' as source, row_id, topic, total_cites, true as placed from topic_docs
union all select 'answers', row_id, cast(row_id % 5 as integer), null, true from answers""", "topic_docs", "answers"))
def g8_joint_corpora(spark, sf):
    """Both corpora in one schema with the coordinates of one projection."""
    abstracts, answers = _embedded_corpora(spark, sf)
    j = jobs.joint_corpora(abstracts, answers)
    return j.select("source", "row_id", "topic", "total_cites", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))


@register("g8_corpus_overlap", V(f"""
with best as (select topic, row_id, text from (
  select cast(row_id % 5 as integer) as topic, row_id, text, row_number() over (partition by row_id % 5 order by row_id % 100 desc, row_id) as rank
  from answers) where rank = 1),
texts as (select 'answer' as kind, row_id as id, text from best
          union all select 'abstract', row_id, title_abstract from topic_docs),
{embed_sql('texts', 'kind, id', 64)},
dots as (select a.id as answer, b.id as row_id, sum(a.v * b.v) as dot from unit a join unit b on a.i = b.i
         where a.kind = 'answer' and b.kind = 'abstract' group by all),
s as (select cast(best.topic as bigint) as topic, d.row_id, coalesce(dots.dot, 0) as similarity
      from best cross join topic_docs d left join dots on dots.answer = best.row_id and dots.row_id = d.row_id)
select topic, row_id, rank, round(similarity, 3) as similarity from (
  select *, cast(row_number() over (partition by topic order by round(similarity, 9) desc, row_id) as bigint) as rank from s)
where rank <= 3""", "topic_docs", "answers"))
def g8_corpus_overlap(spark, sf):
    """For each topic's first representative answer, the 3 most similar
    abstracts (the offline encoder's vectors on both sides)."""
    found = jobs.corpus_overlap(*_embedded_corpora(spark, sf), 3)
    return found.select("topic", "row_id", "rank", F.round("similarity", 3).alias("similarity"))


G9_SQL = V("""
select gpt_model, temperature, heading, count, rank,
       heading || ', (' || gpt_model || ', ' || cast(temperature as varchar) || ')' as label from (
  select *, cast(row_number() over (partition by gpt_model, temperature order by count desc, heading) as bigint) as rank
  from (select gpt_model, temperature, heading, count(*) as count from (
          select gpt_model, temperature, """ + fill(SQL_HEADINGS, 'line') + """[1] as heading from answer_lines)
        where heading is not null group by all))
where rank <= 5""", "answer_lines")


@register("g9_heading_report", G9_SQL)
def g9_heading_report(spark, sf):
    return jobs.heading_report(C.answer_lines(spark, sf))["top_per_group"]


@register("g10_temperature_table", V("""
select row_id, gpt_model, temperature from answers where gpt_model = 'model-a' and temperature in (0.0, 0.5)""",
                                     "answers"))
def g10_temperature_table(spark, sf):
    """Rows of one model at the chosen temperatures (F10 over the answer rows)."""
    a = C.answers(spark, sf)
    return jobs.temperature_table(a, "model-a", [0.0, 0.5]).select("row_id", "gpt_model", "temperature")
