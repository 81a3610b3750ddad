"""Registered queries: vectors and BM25 retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions import vectors as vx
from themeloom.operators import ranking, retrieval, similarity
from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.registry import register
from themeloom.sources import corpora as C

QUESTION = "the and. attion eren and. zzzunknown"


def bm25_sql(question: str, corpus: str, id_col: str, text_col: str, tokenizer: str = "space",
             score_col: str = "bm25_score") -> str:
    """The BM25 contract of :mod:`themeloom.operators.retrieval` in SQL."""
    if tokenizer == "space":
        toks = f"string_split({text_col}, ' ')"
        q = question.split(" ")
    else:
        toks = f"string_split_regex(regexp_replace({text_col}, '^\\s+|\\s+$', '', 'g'), '\\s+')"
        q = question.split()
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(q))
    return f"""
with c as ({corpus}),
tok as (select {id_col} as id, unnest({toks}) as term from c),
dl as (select {id_col} as id, len({toks}) as dl from c),
st as (select cast(count(*) as double) as n, avg(dl) as avgdl from dl),
vocab as (select term, count(distinct id) as n_t from tok group by term),
idf as (select term, ln(n - n_t + 0.5) - ln(n_t + 0.5) as idf from vocab, st),
mean as (select avg(idf) as m from idf),
q as (select * from (values {values}) t(qpos, term)),
qidf as (select q.qpos, q.term, coalesce(case when i.idf < 0 then 0.25 * m else i.idf end, 0) as w
         from q left join idf i on q.term = i.term, mean),
tf as (select id, term, count(*) as f from tok where term in (select term from q) group by id, term),
s as (select d.id, sum(qidf.w * coalesce(tf.f, 0) * 2.5 /
             (coalesce(tf.f, 0) + 1.5 * (0.25 + 0.75 * d.dl / st.avgdl))) as score
      from dl d cross join qidf left join tf on tf.id = d.id and tf.term = qidf.term, st group by d.id)
select id as {id_col}, score as {score_col} from s"""


@register("m1_cosine_to_label_centroid", """
with p as (select label, cast(generate_subscripts(embedding, 1) as bigint) as i,
                  cast(unnest(embedding) as double) as v from embeddings),
c as (select label, list(v order by i) as centroid from (select label, i, avg(v) as v from p group by all) group by label)
select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), c.centroid), 6) as similarity
from embeddings e join c on e.label = c.label""")
def m1_cosine_to_label_centroid(spark, sf):
    from themeloom.operators import topics
    e = C.table(spark, sf, "embeddings")
    cent = topics.centroids(e, "label", "embedding")
    j = e.join(cent, "label")
    return j.select("vec_id", F.round(vx.cosine("embedding", "centroid"), 6).alias("similarity"))


@register("m2_bm25_scores", f"""
select doc_id, round(bm25_score, 6) as bm25_score from ({bm25_sql(QUESTION, 'select doc_id, text from documents',
                                                                  'doc_id', 'text')})""")
def m2_bm25_scores(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", "text")
    s = retrieval.bm25_scores(d, QUESTION, "text")
    return s.select("doc_id", F.round("bm25_score", 6).alias("bm25_score"))


@register("m3_bm25_top_k", f"""
select doc_id, round(bm25_score, 6) as bm25_score from ({bm25_sql(QUESTION, 'select doc_id, text from documents',
                                                                  'doc_id', 'text')})
order by bm25_score desc, doc_id limit 100""")
def m3_bm25_top_k(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", "text")
    s = retrieval.bm25_filter(d, QUESTION, 100, "text", "doc_id")
    return s.select("doc_id", F.round("bm25_score", 6).alias("bm25_score"))


@register("m4_bm25_retriever", f"""
select a.doc_id, round(a.bm25_score, 6) as bm25_score, round(b.retriever_score, 6) as retriever_score
from ({bm25_sql(QUESTION, 'select doc_id, text from documents', 'doc_id', 'text')}) a
join ({bm25_sql(QUESTION, 'select doc_id, text from documents', 'doc_id', 'text', 'whitespace', 'retriever_score')}) b
  using (doc_id)
order by b.retriever_score desc, doc_id limit 100""")
def m4_bm25_retriever(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", "text")
    s = retrieval.bm25_retrieve(d, QUESTION, 100, "text", "doc_id")
    return s.select("doc_id", F.round("bm25_score", 6).alias("bm25_score"),
                    F.round("retriever_score", 6).alias("retriever_score"))


W4_RANK1 = """
select row_id, topic from (
  select *, row_number() over (partition by topic order by
      (case when n1 >= 5 then cast(total_cites as double) else probability end) desc nulls last, row_id) as rank
  from (select d.*, f.n1 from topic_docs d join
        (select topic, sum(case when probability = 1.0 then 1 else 0 end) as n1 from topic_docs where topic <> -1
         group by topic) f on d.topic = f.topic)
  where n1 < 5 or probability = 1.0)
where rank = 1"""
# the same among the documents that have a vector
W4_RANK1_VECTOR = W4_RANK1.replace("topic_docs", "(select * from topic_docs where embedding is not null)")


@register("m6_most_similar_per_topic", V(f"""
select topic, row_id, round(similarity, 6) as similarity, rank from (
  select q.topic, e.vec_id as row_id,
         list_cosine_similarity(cast(qe.embedding as double[]), cast(e.embedding as double[])) as similarity,
         cast(row_number() over (partition by q.topic order by
              list_cosine_similarity(cast(qe.embedding as double[]), cast(e.embedding as double[])) desc, e.vec_id)
              as bigint) as rank
  from ({W4_RANK1_VECTOR}) q join embeddings qe on q.row_id = qe.vec_id, embeddings e)
where rank <= 3""", "topic_docs"))
def m6_most_similar_per_topic(spark, sf):
    td = C.topic_docs(spark, sf)
    reps = ranking.top_docs_per_topic(td.filter("embedding is not null"), 5).filter(F.col("rank") == 1)
    queries = reps.select(F.col("topic").cast("long").alias("topic"), "embedding")
    cands = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    top = similarity.top_n_similar(queries, cands, n=3, q_id="topic")
    return top.select(F.col("topic").cast("int").alias("topic"), "row_id", F.round("similarity", 6).alias("similarity"),
                      "rank")


@register("j6_similarity_top_n_tiled", V(f"""
select topic, row_id, round(similarity, 6) as similarity, rank from (
  select q.topic, e.vec_id as row_id,
         list_cosine_similarity(cast(qe.embedding as double[]), cast(e.embedding as double[])) as similarity,
         cast(row_number() over (partition by q.topic order by
              list_cosine_similarity(cast(qe.embedding as double[]), cast(e.embedding as double[])) desc, e.vec_id)
              as bigint) as rank
  from ({W4_RANK1_VECTOR}) q join embeddings qe on q.row_id = qe.vec_id, embeddings e)
where rank <= 3""", "topic_docs"))
def j6_similarity_top_n_tiled(spark, sf):
    """J6 where the query side is too big to ship at once: parts of at most 2 KiB of vectors."""
    td = C.topic_docs(spark, sf)
    reps = ranking.top_docs_per_topic(td.filter("embedding is not null"), 5).filter(F.col("rank") == 1)
    queries = reps.select(F.col("topic").cast("long").alias("topic"), "embedding")
    cands = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    top = similarity.top_n_similar(queries, cands, n=3, q_id="topic", block_rows=64, ship_bytes=2 << 10)
    return top.select(F.col("topic").cast("int").alias("topic"), "row_id", F.round("similarity", 6).alias("similarity"),
                      "rank")
