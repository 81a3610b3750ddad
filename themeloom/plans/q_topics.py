"""Registered queries: embedding, topic modelling and model-response tables
(M5, T1-T17, L1-L5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from themeloom.operators import embed as em
from themeloom.operators import filters, responses, topics
from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.registry import register
from themeloom.session import checkpoint_dir, stage
from themeloom.sources import corpora as C

THRESHOLD, MIN_SIZE = 0.35, 10
#: Bytes of text that a task counts.
PART_BYTES = 16 << 20

# the five best documents of each topic (W4), and the first sentence of the best
TOP_SQL = """
top as (select * from (
  select *, row_number() over (partition by topic order by
      (case when n1 >= 5 then cast(total_cites as double) else probability end) desc nulls last, row_id) as rank
  from (select d.*, f.n1 from topic_docs d join
        (select topic, sum(case when probability = 1.0 then 1 else 0 end) as n1 from topic_docs where topic <> -1
         group by topic) f on d.topic = f.topic)
  where n1 < 5 or probability = 1.0) where rank <= 5)"""
FIRST_SENTENCE = r"""rtrim(regexp_extract(regexp_replace(trim(arg_min(title_abstract, rank), ' ' || chr(9) || chr(10) || chr(13)) || ' ',
                                   '([.!?])\s', '\1' || chr(1)), '^[^' || chr(1) || ']*'))"""

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in topics.ENGLISH_STOP_WORDS) + "]"

CTFIDF_SQL = f"""
docs as (select topic, title_abstract as text from topic_docs),
w as (select topic, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                lambda x: not list_contains({STOP_SQL}, x)) as w from docs),
terms as (select topic, unnest(w) as term from w
          union all
          select topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term
          from w where len(w) >= 2),
tf as (select topic, term, count(*) as tf from terms group by all),
nt as (select count(distinct topic) as n from docs),
keep as (select term from tf group by term having count(*) >= 2 and count(*) <= 0.9 * (select n from nt)),
c as (select tf.* from tf join keep using (term)),
pt as (select topic, sum(tf) as tot from c group by topic),
ft as (select term, sum(tf) as f from c group by term),
av as (select floor(avg(tot)) as a from pt),
wt as (select c.topic, c.term, c.tf, c.tf / pt.tot * ln(1 + av.a / ft.f) as weight
       from c join pt using (topic) join ft using (term), av),
kw as (select topic, term, weight,
              cast(row_number() over (partition by topic order by weight desc, term) as bigint) as rank from wt)"""


def _docs(spark, sf):
    return C.topic_docs(spark, sf).withColumnRenamed("title_abstract", "text")


def _counts(spark, sf):
    """T4 of the documents: their texts move once, to parts of even size."""
    size = C.table(spark, sf, "documents").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    docs = C.topic_docs(spark, sf, parts=max(1, -(-size // PART_BYTES)))
    return topics.topic_term_counts(docs, text_col="title_abstract", size=size)


def _weights(spark, sf):
    return topics.ctfidf(_counts(spark, sf))


def _texts(spark, sf):
    """The documents' texts and topics written, for jobs that read them many times: a text moves once."""
    return stage(_docs(spark, sf).select("row_id", "topic", "text"), "topic-texts")


def embed_sql(texts: str, keys: str, dim: int) -> str:
    """CTEs that embed the relation ``texts`` (``keys``, text) as the default
    encoder does: ``unit`` holds the non-zero components (``keys``, i, v)."""
    return f"""
ew as (select {keys}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as word from {texts}),
etf as (select {keys}, word, count(*) as n from ew group by all),
ef as (select {keys}, cast('0x' || substr(md5(word), 1, 8) as bigint) % {dim} as i,
              sum((case when cast('0x' || substr(md5(word), 9, 1) as int) < 8 then 1 else -1 end) * (1 + ln(n))) as v
       from etf group by all),
en as (select {keys}, sqrt(sum(v * v)) as norm from ef group by all),
unit as (select {keys}, i, v / norm as v from ef join en using ({keys}) where norm > 0)"""


# ---------------------------------------------------------------- M5
@register("m5_embed", """
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as word from documents),
tf as (select doc_id, word, count(*) as n from w group by all),
f as (select doc_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 384 as i,
             (case when cast('0x' || substr(md5(word), 9, 1) as int) < 8 then 1 else -1 end) * (1 + ln(n)) as v from tf),
e as (select doc_id, i, sum(v) as v from f group by all),
s as (select doc_id, string_agg(i || case when v > 0 then '+' else '-' end, ' ' order by i) as signs,
             arg_max(i, round(abs(v), 9) - i / 1e9) as largest
      from e where abs(v) > 1e-6 group by doc_id)
select d.doc_id, 384 as dim, coalesce(md5(s.signs), '') as signs, s.largest, case when s.signs is null then 0 else 1 end as norm2
from documents d left join s using (doc_id)""")
def m5_embed(spark, sf):
    """Default offline encoder: 384-d unit vectors, batches of 10; which
    components have which sign, and the largest."""
    d = C.table(spark, sf, "documents").select("doc_id", "text")
    e = em.embed(d, "text", "embedding", dim=384, batch_size=10)
    found = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))),
                     lambda c: F.abs(c["v"]) > 1e-8)
    signs = F.array_join(F.transform(found, lambda c: F.concat(c["i"].cast("string"), F.when(c["v"] > 0, "+").otherwise("-"))), " ")
    largest = F.array_max(F.transform(found, lambda c: F.struct(F.round(F.abs(c["v"]), 6), -c["i"])))["col2"]
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.when(F.size(found) > 0, F.md5(signs)).otherwise("").alias("signs"),
                    (-largest).cast("bigint").alias("largest"), F.round(norm2).cast("int").alias("norm2"))


# ---------------------------------------------------------------- T1-T3
@register("t1_reduce_dimensions", """
select count(*) as n, least(50, count(*) - 2, any_value(len(embedding))) as k, true as orthonormal, true as by_variance,
       true as uncorrelated from embeddings""")
def t1_reduce_dimensions(spark, sf):
    """PCA on unit vectors, k clamped to min(k, n-2, width); what it must satisfy, as a row."""
    e = C.table(spark, sf, "embeddings")
    red, model = topics.reduce_dimensions(e, 50, "embedding", "reduced")
    pc = model.pc.toArray()
    orthonormal = bool(np.allclose(pc.T @ pc, np.eye(pc.shape[1]), atol=1e-8))
    v = [F.col("reduced")[i] for i in range(3)]
    s = red.agg(F.count("*").alias("n"), F.max(F.size("reduced")).cast("bigint").alias("k"),
                *[F.variance(v[i]).alias(f"v{i}") for i in range(3)], F.corr(v[0], v[1]).alias("c1"), F.corr(v[1], v[2]).alias("c2"))
    return s.select("n", "k", F.lit(orthonormal).alias("orthonormal"),
                    ((F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2"))).alias("by_variance"),
                    ((F.abs("c1") < 1e-6) & (F.abs("c2") < 1e-6)).alias("uncorrelated"))


T2_SQL = f"""
with recursive e as (
  select a.vec_id as s, b.vec_id as d from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= {THRESHOLD}),
r(id, c) as (select vec_id, vec_id from embeddings union select e.d, r.c from r join e on r.id = e.s),
comp as (select id, min(c) as label from r group by id),
sz as (select label, count(*) as size from comp group by label),
num as (select label, cast(row_number() over (order by size desc, label) - 1 as integer) as topic
        from sz where size >= {MIN_SIZE})
select comp.id as row_id, coalesce(num.topic, -1) as topic from comp left join num using (label)"""


@register("t2_density_clusters", T2_SQL)
def t2_density_clusters(spark, sf):
    checkpoint_dir(spark)
    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    assign, _ = topics.density_clusters(e, THRESHOLD, MIN_SIZE, "row_id", "embedding", block_rows=128)
    return assign


@register("t2_leaf_topics")
def t2_leaf_topics(spark, sf):
    """Topics from the leaves of the single-linkage tree instead of its
    components: the finest groups of at least three above the threshold."""
    checkpoint_dir(spark)
    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    assign, _ = topics.density_clusters(e, THRESHOLD, 3, "row_id", "embedding", block_rows=128, select="leaves")
    return assign


T3_SQL = f"""
with recursive pairs as (
  select a.vec_id as s, b.vec_id as d,
         list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as sim
  from embeddings a join embeddings b on a.vec_id <> b.vec_id),
e as (select * from pairs where sim >= {THRESHOLD}),
r(id, c) as (select vec_id, vec_id from embeddings union select e.d, r.c from r join e on r.id = e.s),
comp as (select id, min(c) as label from r group by id),
sz as (select label, count(*) as size from comp group by label),
num as (select label, cast(row_number() over (order by size desc, label) - 1 as integer) as topic
        from sz where size >= {MIN_SIZE}),
a as (select comp.id, coalesce(num.topic, -1) as topic from comp left join num using (label)),
near as (select e.s as id, a.topic, 1 - max(e.sim) as dist from e join a on e.d = a.id where a.topic <> -1 group by all),
own as (select a.id, a.topic, near.dist from a left join near on a.id = near.id and a.topic = near.topic),
least_ as (select topic, min(dist) as tmin from own group by topic),
p as (select own.id, own.topic, case when own.topic = -1 then 0 when own.dist is null then 0
        when own.dist <= 0 then 1 else least(1, tmin / own.dist) end as probability from own left join least_ using (topic)),
v as (select near.id, max(case when near.dist <= 0 then 1 else least(1, tmin / near.dist) end) as max_p
      from near join least_ using (topic) group by near.id)
select p.id as row_id, p.topic, round(cast(p.probability as double), 6) as probability,
       case when (select max(topic) from a) < 0 then null else round(cast(coalesce(v.max_p, 0) as double), 6) end as max_p
from p left join v on p.id = v.id"""


@register("t3_membership_probability", T3_SQL)
def t3_membership_probability(spark, sf):
    """Probability per document in [0, 1], and the largest of its vector form."""
    checkpoint_dir(spark)
    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    assign, edges = topics.density_clusters(e, THRESHOLD, MIN_SIZE, "row_id", "embedding", block_rows=128)
    p = topics.membership_probability(assign, edges)
    # a vector has a number for each topic: its largest is taken before the join, so that none moves
    v = topics.probability_vectors(assign, edges).select("row_id", F.round(F.array_max("probabilities"), 6).alias("max_p"))
    return p.join(v, "row_id").select("row_id", "topic", F.round("probability", 6).alias("probability"), "max_p")


# ---------------------------------------------------------------- T4-T7, T10
@register("t4_topic_vocabulary", V(f"with {CTFIDF_SQL}\nselect topic, term, tf from c", "topic_docs"))
def t4_topic_vocabulary(spark, sf):
    return _counts(spark, sf).select("topic", "term", "tf")


@register("t5_ctfidf", V(f"with {CTFIDF_SQL}\nselect topic, term, round(weight, 6) as weight from wt", "topic_docs"))
def t5_ctfidf(spark, sf):
    return _weights(spark, sf).select("topic", "term", F.round("weight", 6).alias("weight"))


@register("t6_top_keywords", V(f"with {CTFIDF_SQL}\nselect topic, term, rank from kw where rank <= 10", "topic_docs"))
def t6_top_keywords(spark, sf):
    return topics.top_keywords(_weights(spark, sf), 10).select("topic", "term", "rank")


@register("t7_topic_names", V(f"""with {CTFIDF_SQL}
select topic, cast(topic as varchar) || '_' || string_agg(term, '_' order by rank) as "Name"
from kw where rank <= 4 group by topic""", "topic_docs"))
def t7_topic_names(spark, sf):
    return topics.topic_names(topics.top_keywords(_weights(spark, sf), 10), 4).select("topic", "Name")


DOC_TERMS_SQL = f"""
dw as (select row_id, topic, list_filter(regexp_extract_all(lower(title_abstract), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                         lambda x: not list_contains({STOP_SQL}, x)) as w from topic_docs),
dterms as (select row_id, topic, unnest(w) as term from dw
           union all
           select row_id, topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term
           from dw where len(w) >= 2),
dtf as (select row_id, topic, term, count(*) as n from dterms group by all),
sim as (select d.row_id, d.topic, sum(d.n * x.idf * x.weight) as dotw, sqrt(sum((d.n * x.idf) ** 2)) as dn
        from dtf d join (select wt.*, ln(1 + av.a / ft.f) as idf from wt join ft using (term), av) x
          on d.topic = x.topic and d.term = x.term group by all),
norm as (select topic, sqrt(sum(weight ** 2)) as tn from wt group by topic)"""


@register("t10_representative_docs", V(f"""with {CTFIDF_SQL}, {DOC_TERMS_SQL}
select topic, row_id, round(similarity, 6) as similarity from (
  select topic, row_id, case when dn > 0 and tn > 0 then dotw / (dn * tn) else 0 end as similarity,
         row_number() over (partition by topic order by round(case when dn > 0 and tn > 0 then dotw / (dn * tn) else 0 end, 9) desc,
                            row_id) as rank
  from sim join norm using (topic)) where rank <= 3""", "topic_docs"))
def t10_representative_docs(spark, sf):
    """3 documents per topic nearest to the topic's c-TF-IDF vector."""
    d = _texts(spark, sf)
    r = topics.representative_docs(d, topics.ctfidf(topics.topic_term_counts(d)), 3)
    return r.select("topic", "row_id", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- T11-T13
CENT_SQL = """
p as (select topic, cast(generate_subscripts(embedding, 1) as bigint) as i, cast(unnest(embedding) as double) as v
      from topic_docs where topic <> -1),
cent as (select topic, list(v order by i) as centroid from (select topic, i, avg(v) as v from p group by all)
         group by topic)"""


# average linkage one merge at a time: the groups that are left, as (group, topic) rows
T11_SQL = f"""with recursive {CENT_SQL.strip()},
sim as (select a.topic as x, b.topic as y, round(list_cosine_similarity(a.centroid, b.centroid), 12) as s
        from cent a join cent b on a.topic <> b.topic),
m(step, topic, grp) as (
  select 0, topic, topic from cent
  union all
  select m.step + 1, m.topic, case when m.grp = p.b then p.a else m.grp end
  from m, (select a.grp as a, b.grp as b from m a join m b on a.grp < b.grp join sim on sim.x = a.topic and sim.y = b.topic
           group by a.grp, b.grp order by round(avg(s), 9) desc, a.grp, b.grp limit 1) p),
old as (select topic as old_topic, grp from m where step = (select count(*) from cent) - 4),
size as (select grp, count(*) as n from old join topic_docs d on d.topic = old.old_topic where d.embedding is not null group by grp),
num as (select grp, cast(row_number() over (order by n desc, grp) - 1 as integer) as topic from size)
select old_topic, topic from old join num using (grp) union all select -1, -1"""


@register("t11_reduce_topics", V(T11_SQL, "topic_docs"))
def t11_reduce_topics(spark, sf):
    """The topics merged down to 4: which old topic is in which new one."""
    td = C.topic_docs(spark, sf).filter("embedding is not null")
    return topics.reduce_topics(td.select("row_id", "topic"), td.select("row_id", "embedding"), 4)


T12_SQL = V(f"""with {CENT_SQL},
s as (select e.vec_id, c.topic, list_cosine_similarity(cast(e.embedding as double[]), c.centroid) as sim
      from embeddings e, cent c),
b as (select vec_id, topic, sim, row_number() over (partition by vec_id order by sim desc, topic) as rn from s)
select vec_id as row_id, case when sim >= 0.2 then topic else -1 end as topic, round(sim, 6) as similarity
from b where rn = 1""", "topic_docs")


@register("t12_assign_nearest_centroid", T12_SQL)
def t12_assign_nearest_centroid(spark, sf):
    td = filters.drop_noise(C.topic_docs(spark, sf))
    cent = topics.centroids(td, "topic", "embedding")
    docs = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    a = topics.nearest_centroid(docs, cent, 0.2)
    return a.select("row_id", "topic", F.round("similarity", 6).alias("similarity"))


@register("t13_zero_shot_assignment", V(f"""with {CENT_SQL},
s as (select e.vec_id, c.topic, list_cosine_similarity(cast(e.embedding as double[]), c.centroid) as sim
      from embeddings e, cent c where c.topic in (0, 2, 4)),
b as (select vec_id, topic, sim, row_number() over (partition by vec_id order by sim desc, topic) as rn from s)
select vec_id as row_id, topic, round(sim, 6) as similarity from b where rn = 1 and sim >= 0.25""", "topic_docs"))
def t13_zero_shot_assignment(spark, sf):
    """Exact for the assignment part: user topics are given as vectors (here
    three topic centroids); documents at >= 0.25 take the best one."""
    td = filters.drop_noise(C.topic_docs(spark, sf))
    cent = topics.centroids(td, "topic", "embedding").filter(F.col("topic").isin(0, 2, 4))
    docs = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    assigned, _rest = topics.zero_shot(docs, cent, 0.25)
    return assigned.select("row_id", "topic", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- T14-T17
def _placed(spark, sf):
    return topics.project_2d(C.topic_docs(spark, sf).filter("embedding is not null"))


@register("t14_project_2d", V("""
select count(*) as n, count(distinct row_id) as n_ids, true as uncorrelated, true as by_variance
from topic_docs where embedding is not null""", "topic_docs"))
def t14_project_2d(spark, sf):
    """2-D PCA coordinates with fixed axis signs; what they must satisfy, as a row."""
    s = _placed(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_ids"), F.corr("x", "y").alias("c"),
                               F.variance("x").alias("vx"), F.variance("y").alias("vy"))
    return s.select("n", "n_ids", (F.abs("c") < 1e-6).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("by_variance"))


@register("t15_plot_table", V(f"""with {CTFIDF_SQL}, {TOP_SQL},
names as (select topic, cast(topic as varchar) || '_' || string_agg(term, '_' order by rank) as nm
          from kw where rank <= 4 group by topic),
told as (select topic, {FIRST_SENTENCE} as topic_description from top group by topic),
q as (select cast(floor(quantile_cont(cast(total_cites as double), 0.25)) as bigint) as q1,
             cast(floor(quantile_cont(cast(total_cites as double), 0.5)) as bigint) as q2,
             cast(floor(quantile_cont(cast(total_cites as double), 0.75)) as bigint) as q3 from topic_docs where topic <> -1)
select d.row_id, d.topic, coalesce(n.nm, 'NA') as "Name", d.total_cites, md5(d.title_abstract) as doc_md5,
       t.topic_description,
       case when total_cites < q1 then '5-' || (q1 - 1) when total_cites < q2 then q1 || '-' || (q2 - 1)
            when total_cites < q3 then q2 || '-' || (q3 - 1) else q3 || '+' end as citation_band,
       d.embedding is not null as placed
from topic_docs d left join names n using (topic) left join told t using (topic), q where d.topic <> -1""", "topic_docs"))
def t15_plot_table(spark, sf):
    """Topic, name, text, metadata, summary and whether there are coordinates."""
    from themeloom.plans import jobs
    p = jobs.plot_table(C.topic_docs(spark, sf), text_col="title_abstract")
    return p.select("row_id", "topic", "Name", "total_cites", F.md5("doc").alias("doc_md5"), "topic_description",
                    "citation_band", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))


@register("t16_convex_hulls", V("""
select 'g' || cast(row_id % 4 as varchar) as "group", count(*) as n_points, true as closed, true as convex, true as around_all
from topic_docs where embedding is not null group by 1""", "topic_docs"))
def t16_convex_hulls(spark, sf):
    """Closed hull ring per group of 2-D coordinates; what a ring must satisfy, a row per group."""
    from themeloom.session import stage

    xy = stage(_placed(spark, sf).select(F.concat(F.lit("g"), (F.col("row_id") % 4).cast("string")).alias("group"), "x", "y"), "hull-points")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("order", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rings = topics.convex_hulls(xy, "group").groupBy("group").agg(ring.alias("ring"))  # hull points only
    left = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    corners = F.sequence(F.lit(0), F.size("ring") - 3)
    at = lambda i: F.get("ring", i)
    sides = F.sequence(F.lit(0), F.size("ring") - 2)
    point = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
    held = xy.join(rings, "group").groupBy("group").agg(
        F.count("*").alias("n_points"), F.bool_and(F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"),
        F.bool_and(F.forall(corners, lambda i: left(at(i), at(i + 1), at(i + 2)) > 0)).alias("convex"),
        F.bool_and(F.forall(sides, lambda i: left(at(i), at(i + 1), point) >= -1e-9)).alias("around_all"))
    return held


@register("t17_save_load_topics", """
select unnest(['centroids', 'components', 'topic_terms', 'topics']) as part, true as any_rows, true as equal""")
def t17_save_load_topics(spark, sf):
    """Fitted topics written as Parquet tables and read back: each part holds rows, the same ones."""
    import uuid
    root = checkpoint_dir(spark).rstrip("/") + f"/topic-model-{uuid.uuid4().hex}"
    w = _weights(spark, sf)
    kw = topics.top_keywords(w, 10)
    names = topics.topic_names(kw)
    cent = topics.centroids(C.topic_docs(spark, sf), "topic", "embedding")
    _, model = topics.reduce_dimensions(C.table(spark, sf, "embeddings"), 20)
    kept = {"topics": names, "topic_terms": w, "centroids": cent, "components": topics.component_table(spark, model)}
    topics.save_topic_model(root, **kept)
    out = None
    for part, back in topics.load_topic_model(spark, root).items():
        # rows by digest, counted on both sides
        row = F.xxhash64(F.to_json(F.struct(*kept[part].columns))).alias("row")
        both = kept[part].select(row, F.lit(1).alias("n")).unionByName(back.select(row, F.lit(-1).alias("n")))
        check = both.groupBy("row").agg(F.sum("n").alias("n")).agg(
            F.lit(part).alias("part"), (F.count("*") > 0).alias("any_rows"), F.bool_and(F.col("n") == 0).alias("equal"))
        out = check if out is None else out.unionByName(check)
    return out


@register("t17_apply_saved_topics", T12_SQL)
def t17_apply_saved_topics(spark, sf):
    """Fitted topics saved, loaded again and applied to the table of vectors."""
    import uuid
    root = checkpoint_dir(spark).rstrip("/") + f"/topic-model-{uuid.uuid4().hex}"
    w = _weights(spark, sf)
    cent = topics.centroids(filters.drop_noise(C.topic_docs(spark, sf)), "topic", "embedding")
    topics.save_topic_model(root, topics.topic_names(topics.top_keywords(w, 10)), w, cent)
    model = topics.load_topic_model(spark, root, topics.MODEL_PARTS[:3])
    docs = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return topics.apply_topic_model(model, docs, 0.2).select("row_id", "topic", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- L1-L5
@register("l1_request_table", V("""
with g as (select distinct gpt_model, temperature from answers where system_message is not null),
grid as (select gpt_model, temperature, cast(unnest(range(0, 50)) as bigint) as sample from g),
done as (select gpt_model, temperature,
           cast(row_number() over (partition by gpt_model, temperature order by row_id) - 1 as bigint) as sample
         from answers where system_message is not null)
select gpt_model, temperature, sample, 'be helpful' as system_message, 'what are the themes?' as research_question
from grid anti join done using (gpt_model, temperature, sample)""", "answers"))
def l1_request_table(spark, sf):
    from pyspark.sql import Window
    a = filters.known_system_message(C.answers(spark, sf))
    w = Window.partitionBy("gpt_model", "temperature").orderBy("row_id")
    done = a.select("gpt_model", "temperature", (F.row_number().over(w) - 1).cast("bigint").alias("sample"))
    return responses.request_table(a.select("gpt_model", "temperature").distinct(), 50, "be helpful",
                                   "what are the themes?", done)


@register("l2_response_records", V("""
select array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '|') as lines,
       gpt_model, temperature, 'what are the themes?' as research_question, system_message, true as timed
from answers""", "answers"))
def l2_response_records(spark, sf):
    """Answer texts to stored records (lines, time, model, ...); the time is only checked for its form."""
    a = C.answers(spark, sf).withColumns({"research_question": F.lit("what are the themes?")})
    r = responses.response_records(a.withColumnRenamed("text", "answer_text"))
    timed = F.col("datetime").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$")
    return r.select(F.array_join("answer", "|").alias("lines"), "gpt_model", "temperature", "research_question",
                    "system_message", timed.alias("timed"))


@register("l3_summary_requests", V(f"""with {CTFIDF_SQL},
top as (select * from (
  select *, row_number() over (partition by topic order by
      (case when n1 >= 5 then cast(total_cites as double) else probability end) desc nulls last, row_id) as rank
  from (select d.*, f.n1 from topic_docs d join
        (select topic, sum(case when probability = 1.0 then 1 else 0 end) as n1 from topic_docs where topic <> -1
         group by topic) f on d.topic = f.topic)
  where n1 < 5 or probability = 1.0) where rank <= 5),
texts as (select topic, string_agg(title_abstract, chr(10) order by rank) as texts from top group by topic),
kws as (select topic, string_agg(term, ', ' order by rank) as keywords from kw where rank <= 10 group by topic)
select t.topic, md5(t.texts) as texts_md5, coalesce(k.keywords, '') as keywords from texts t left join kws k using (topic)
""", "topic_docs"))
def l3_summary_requests(spark, sf):
    d = _docs(spark, sf)
    kw = topics.top_keywords(_weights(spark, sf), 10)
    r = responses.summary_requests(d, kw, 5)
    return r.select("topic", F.md5("texts").alias("texts_md5"), F.array_join("keywords", ", ").alias("keywords"))


@register("l4_complete", V(f"""with {CTFIDF_SQL}, {TOP_SQL},
kws as (select topic, string_agg(term, ' ' order by rank) as name from kw where rank <= 5 group by topic),
told as (select topic, {FIRST_SENTENCE} as description from top group by topic)
select t.topic, coalesce(k.name, 'unnamed') as name, t.description from told t left join kws k using (topic)""", "topic_docs"))
def l4_complete(spark, sf):
    """The built-in extractive completer over the summary requests."""
    d = _docs(spark, sf)
    kw = topics.top_keywords(_weights(spark, sf), 10)
    done = responses.complete(responses.summary_requests(d, kw, 5))
    return done.select("topic", F.col("`Name:`").alias("name"), F.col("`Description:`").alias("description"))


@register("l5_flatten_summaries", V(f"""with {CTFIDF_SQL}, {TOP_SQL},
kws as (select topic, string_agg(term, ' ' order by rank) filter (rank <= 5) as name,
               string_agg(term, ', ' order by rank) as topic_keywords from kw where rank <= 10 group by topic),
told as (select topic, count(*) as n_docs, md5(string_agg(title_abstract, chr(10) order by rank)) as docs_md5,
                {FIRST_SENTENCE} as topic_description from top group by topic)
select t.topic, coalesce(k.name, 'unnamed') as topic_name, t.topic_description, t.n_docs, t.docs_md5,
       coalesce(k.topic_keywords, '') as topic_keywords from told t left join kws k using (topic)""", "topic_docs"))
def l5_flatten_summaries(spark, sf):
    """Summaries -> five snake-cased columns, integer topic."""
    d = _docs(spark, sf)
    kw = topics.top_keywords(_weights(spark, sf), 10)
    done = responses.complete(responses.summary_requests(d, kw, 5))
    flat = responses.flatten_summaries(responses.summary_records(done))
    return flat.select("topic", "topic_name", "topic_description", F.size("representative_docs").cast("bigint").alias("n_docs"),
                       F.md5(F.array_join("representative_docs", "\n")).alias("docs_md5"),
                       F.array_join("topic_keywords", ", ").alias("topic_keywords"))


@register("t8_similarity_keywords", V(f"""with {CTFIDF_SQL}, {DOC_TERMS_SQL},
reps as (select topic, row_id from (
  select topic, row_id, row_number() over (partition by topic order by
           round(case when dn > 0 and tn > 0 then dotw / (dn * tn) else 0 end, 9) desc, row_id) as rank
  from sim join norm using (topic)) where rank <= 3),
cand as (select topic, term from kw where rank <= 30),
texts as (select 'doc' as kind, d.topic, cast(d.row_id as varchar) as id, d.title_abstract as text from reps join topic_docs d using (topic, row_id)
          union all select 'term', topic, term, term from cand),
{embed_sql('texts', 'kind, topic, id', 384)},
tv as (select topic, i, sum(v) as v from unit where kind = 'doc' group by all),
tl as (select topic, sqrt(sum(v * v)) as len from tv group by topic),
dots as (select u.topic, u.id as term, sum(u.v * tv.v) as dot from unit u join tv on u.topic = tv.topic and u.i = tv.i
         where u.kind = 'term' group by all),
s as (select c.topic, c.term, coalesce(d.dot / tl.len, 0) as similarity
      from cand c left join dots d using (topic, term) left join tl using (topic))
select topic, term, rank, round(similarity, 3) as similarity from (
  select *, cast(row_number() over (partition by topic order by round(similarity, 6) desc, term) as bigint) as rank from s)
where rank <= 10""", "topic_docs"))
def t8_similarity_keywords(spark, sf):
    """c-TF-IDF candidates re-ranked by similarity to the topic's representative
    documents (default offline encoder)."""
    d = _texts(spark, sf)
    w = topics.ctfidf(topics.topic_term_counts(d))
    reps = topics.representative_docs(d, w, 3)
    found = topics.similarity_keywords(w, reps, d, 10, 30)
    return found.select("topic", "term", "rank", (F.round("similarity", 3) + 0.0).alias("similarity"))


@register("t9_diverse_keywords")
def t9_diverse_keywords(spark, sf):
    """Rows-only: maximal marginal relevance keywords (diversity 0.3)."""
    d = _texts(spark, sf)
    w = topics.ctfidf(topics.topic_term_counts(d))
    reps = topics.representative_docs(d, w, 3)
    return topics.diverse_keywords(w, reps, d, 10, 0.3, 30)
