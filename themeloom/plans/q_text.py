"""Registered queries: scalar text / array / JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions import vectors as vx
from themeloom.operators import stats
from themeloom.plans.fixture_sql import with_views as V
from themeloom.plans.registry import register
from themeloom.sources import corpora as C

# SQL forms of the cleaning steps (RE2 in DuckDB)
PUNCT = r"[!()\-{};:,<>./?@#$%\^&*_~]"
SQL_X1 = "regexp_replace({x}, '\\r|\\n', '', 'g')"
SQL_X2 = "regexp_replace({x}, '(" + PUNCT + ")" + PUNCT + "+', '\\1', 'g')"
SQL_X3 = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
SQL_X4 = "regexp_replace({x}, '^[Aa]bstract[,.!?;:\\-]?', '')"
SQL_X5 = "regexp_replace({x}, '<[^>]+>', '', 'g')"


def fill(template: str, x: str) -> str:
    """put the SQL expression ``x`` where a template says {x}"""
    return template.replace("{x}", x)


def sql_clean(x: str) -> str:
    for step in (SQL_X1, SQL_X2, SQL_X3, SQL_X4, SQL_X5):
        x = fill(step, x)
    return x


def _pages(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", "html")


def _digest(col, name):
    return [F.md5(col).alias(f"{name}_md5"), F.length(col).cast("bigint").alias(f"{name}_len")]


def _sql_digest(expr, name):
    return f"md5({expr}) as {name}_md5, cast(length({expr}) as bigint) as {name}_len"


@register("x1_remove_line_breaks", f"select page_id, {_sql_digest(fill(SQL_X1, 'html'), 'out')} from pages")
def x1_remove_line_breaks(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(tx.remove_line_breaks("html"), "out"))


@register("x2_collapse_punctuation", f"select page_id, {_sql_digest(fill(SQL_X2, 'html'), 'out')} from pages")
def x2_collapse_punctuation(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(tx.collapse_punctuation("html"), "out"))


@register("x3_collapse_whitespace", f"select page_id, {_sql_digest(fill(SQL_X3, 'html'), 'out')} from pages")
def x3_collapse_whitespace(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(tx.collapse_whitespace("html"), "out"))


@register("x4_drop_leading_abstract", f"""
select doc_id, {_sql_digest(fill(SQL_X4, "(case doc_id % 3 when 0 then 'Abstract: ' when 1 then 'abstraction ' else '' end || text)"), 'out')}
from documents""")
def x4_drop_leading_abstract(spark, sf):
    d = C.table(spark, sf, "documents")
    pre = F.when(F.col("doc_id") % 3 == 0, F.lit("Abstract: ")).when(F.col("doc_id") % 3 == 1, F.lit("abstraction ")) \
        .otherwise(F.lit(""))
    return d.select("doc_id", *_digest(tx.drop_leading_abstract(F.concat(pre, F.col("text"))), "out"))


@register("x5_strip_html_tags", f"select page_id, {_sql_digest(fill(SQL_X5, 'html'), 'out')} from pages")
def x5_strip_html_tags(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(tx.strip_html_tags("html"), "out"))


@register("x6_clean_abstract", f"select page_id, {_sql_digest(sql_clean('html'), 'out')} from pages")
def x6_clean_abstract(spark, sf):
    return _pages(spark, sf).select("page_id", *_digest(tx.clean_abstract("html"), "out"))


@register("x7_title_abstract", V("""
select ordinal, md5(title || case when title like '%.' then ' ' else '. ' end || abstract) as ta_md5
from works where abstract is not null""", "works"))
def x7_title_abstract(spark, sf):
    w = C.works(spark, sf).filter(F.col("abstract").isNotNull())
    return w.select("ordinal", F.md5(tx.title_abstract("title", "abstract")).alias("ta_md5"))


@register("x8_token_count_estimate", """
select doc_id, cast(len(regexp_extract_all(text, '\\p{L}+|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]+')) as bigint) as num_tokens
from documents""")
def x8_token_count_estimate(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", tx.token_count_estimate("text").alias("num_tokens"))


HEAD_RE = "\\d+\\.\\s*(\\*\\*.*?\\*\\*|[^:*]*):"
SQL_HEADINGS = ("list_transform(regexp_extract_all({x}, '" + HEAD_RE + "', 1), "
                "lambda h: lower(trim(regexp_replace(regexp_replace(h, '^\\*\\*(.*?)\\*\\*$', '\\1'), '[.:]+$', ''))))")


@register("x9_theme_headings", V(f"""
select row_id, pos, array_to_string({fill(SQL_HEADINGS, "line || ' ' || line")}, '|') as headings
from answer_lines""", "answer_lines"))
def x9_theme_headings(spark, sf):
    al = C.answer_lines(spark, sf)
    h = tx.theme_headings(F.concat(F.col("line"), F.lit(" "), F.col("line")))
    return al.select("row_id", "pos", F.array_join(h, "|").alias("headings"))


@register("x10_first_heading", V(f"""
select row_id, pos, {fill(SQL_HEADINGS, 'line')}[1] as heading from answer_lines""", "answer_lines"))
def x10_first_heading(spark, sf):
    al = C.answer_lines(spark, sf)
    return al.select("row_id", "pos", tx.first_heading("line").alias("heading"))


@register("x11_clean_answer_line", V("""
select row_id, pos, regexp_replace(line, '^\\d+\\.|[*]', '', 'g') as answer_cleaned from answer_lines""",
                                     "answer_lines"))
def x11_clean_answer_line(spark, sf):
    al = C.answer_lines(spark, sf)
    return al.select("row_id", "pos", tx.clean_answer_line("line").alias("answer_cleaned"))


SQL_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@register("x12_conclusion", V(f"""
select row_id, case when regexp_matches(({SQL_LINES})[-1], '^[A-Za-z]') then ({SQL_LINES})[-1] end as conclusion
from answers""", "answers"))
def x12_conclusion(spark, sf):
    a = C.answers(spark, sf)
    return a.select("row_id", tx.conclusion(tx.answer_lines("text")).alias("conclusion"))


@register("x13_answer_lines", V(f"""
select row_id, cast(len({SQL_LINES}) as bigint) as n_lines, md5(array_to_string({SQL_LINES}, '|')) as lines_md5
from answers""", "answers"))
def x13_answer_lines(spark, sf):
    a = C.answers(spark, sf).withColumn("l", tx.answer_lines("text"))
    return a.select("row_id", F.size("l").cast("bigint").alias("n_lines"), F.md5(F.array_join("l", "|")).alias("lines_md5"))


@register("x14_explode_lines", V(f"""
select row_id, cast(generate_subscripts({SQL_LINES}, 1) - 1 as bigint) as pos, unnest({SQL_LINES}) as line
from answers where len({SQL_LINES}) > 0
union all select row_id, null, null from answers where len({SQL_LINES}) = 0""", "answers"))
def x14_explode_lines(spark, sf):
    a = C.answers(spark, sf)
    e = a.select("row_id", F.posexplode_outer(tx.answer_lines("text")).alias("pos", "line"))
    return e.withColumn("pos", F.col("pos").cast("bigint"))


@register("x15_text_from_inverted_index", """
select doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) as abstract_md5
from documents""")
def x15_text_from_inverted_index(spark, sf):
    d = C.table(spark, sf, "documents")
    # a document's text moves once, before it becomes a row per word
    words = d.repartition("doc_id").select("doc_id", F.posexplode(tx.whitespace_tokens("text")).alias("pos", "word"))
    postings = words.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    index = postings.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("abstract_inverted_index"))
    # documents without a word still get a (empty) text
    rebuilt = d.select("doc_id").join(index, "doc_id", "left").select(
        "doc_id", F.coalesce(tx.text_from_inverted_index("abstract_inverted_index"), F.lit("")).alias("abstract"))
    return rebuilt.select("doc_id", F.md5("abstract").alias("abstract_md5"))


@register("x16_parse_list_text", """
select vec_id, cast(len(embedding) as bigint) as n, round(cast(embedding[1] as double), 6) as first,
       round(cast(embedding[len(embedding)] as double), 6) as last from embeddings""")
def x16_parse_list_text(spark, sf):
    e = C.table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("as_text"))
    arr = tx.parse_list_text("as_text", "float").cast("array<double>")
    return e.select("vec_id", F.size(arr).cast("bigint").alias("n"), F.round(arr[0], 6).alias("first"),
                    F.round(F.element_at(arr, -1), 6).alias("last"))


def _bands_sql(zero_na: bool) -> str:
    q = ("(select cast(floor(quantile_cont(cited_by_count, 0.25)) as bigint) as a, "
         "cast(floor(quantile_cont(cited_by_count, 0.5)) as bigint) as b, "
         "cast(floor(quantile_cont(cited_by_count, 0.75)) as bigint) as c from works)")
    x = "(cited_by_count % 40)"
    first = (f"when {x} = 0 then 'NA' when {x} > 0 and {x} < a then '5-' || cast(a - 1 as varchar) "
             if zero_na else f"when {x} < a then '5-' || cast(a - 1 as varchar) ")
    return V(f"""
select ordinal, case {first}
  when {x} >= a and {x} < b then cast(a as varchar) || '-' || cast(b - 1 as varchar)
  when {x} >= b and {x} < c then cast(b as varchar) || '-' || cast(c - 1 as varchar)
  else cast(c as varchar) || '+' end as citation_band
from works, {q} q""", "works")


def _bands(spark, sf, zero_na):
    w = C.works(spark, sf)
    qs = [F.lit(q) for q in stats.quartile_values(w, "cited_by_count")]
    return w.select("ordinal", tx.citation_band(F.col("cited_by_count") % 40, *qs, zero_na=zero_na)
                    .alias("citation_band"))


@register("x17_citation_band", _bands_sql(False))
def x17_citation_band(spark, sf):
    return _bands(spark, sf, False)


@register("x18_citation_band_na", _bands_sql(True))
def x18_citation_band_na(spark, sf):
    return _bands(spark, sf, True)


@register("x19_keyword_list", """
select doc_id, md5(array_to_string(string_split(replace(text, ' ', ''), ','), '|')) as keywords_md5,
       cast(len(string_split(replace(text, ' ', ''), ',')) as bigint) as n_keywords
from documents""")
def x19_keyword_list(spark, sf):
    d = C.table(spark, sf, "documents")
    kw = tx.keyword_list(F.col("text"))
    return d.select("doc_id", F.md5(F.array_join(kw, "|")).alias("keywords_md5"),
                    F.size(kw).cast("bigint").alias("n_keywords"))


@register("x20_heading_label", V(f"""
select row_id, pos, {fill(SQL_HEADINGS, 'line')}[1] || ', (' || gpt_model || ', ' || cast(temperature as varchar) || ')'
  as label from answer_lines""", "answer_lines"))
def x20_heading_label(spark, sf):
    al = C.answer_lines(spark, sf)
    return al.select("row_id", "pos", tx.heading_label(tx.first_heading("line"), F.col("gpt_model"),
                                                       F.col("temperature")).alias("label"))


@register("x21_parse_name_description", """
select doc_id, case when doc_id % 5 <> 0 then text end as name, case when doc_id % 5 <> 0 then lang end as description,
       doc_id % 5 = 0 as parse_failed from documents""")
def x21_parse_name_description(spark, sf):
    """Every fifth response loses its closing brace and must come back flagged."""
    d = C.table(spark, sf, "documents")
    js = F.to_json(F.struct(F.col("text").alias("name"), F.col("lang").alias("description")))
    resp = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(js, "}$", "")).otherwise(js)
    p = tx.parse_name_description(resp)
    return d.select("doc_id", p["name"].alias("name"), p["description"].alias("description"),
                    (p.isNull() | p["name"].isNull()).alias("parse_failed"))


@register("x22_two_tokenisations", """
select doc_id, cast(len(string_split(text, ' ')) as bigint) as n_space_tokens,
       cast(len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) as bigint) as n_ws_tokens
from documents""")
def x22_two_tokenisations(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", F.size(tx.space_tokens("text")).cast("bigint").alias("n_space_tokens"),
                    F.size(tx.whitespace_tokens("text")).cast("bigint").alias("n_ws_tokens"))


def drawn(seed: int, part: int, row_id: str = "vec_id") -> str:
    """The draw of ``vectors._uniform`` in SQL."""
    h = f"substr(md5('{seed}|' || cast({row_id} as varchar)), {1 + 12 * part}, 12)"
    return f"(cast(cast('0x' || {h} as bigint) as double) + 0.5) / 281474976710656.0"


@register("x23_jitter", f"""
select vec_id, round(cast(embedding[1] as double) + 0.5 * sqrt(-2 * ln({drawn(7, 0)})) * cos(2 * pi() * {drawn(7, 1)}), 6) as x,
       round(cast(embedding[2] as double) + ({drawn(11, 0)} - 0.5) * 0.4, 6) as y
from embeddings""")
def x23_jitter(spark, sf):
    """Gaussian jitter and uniform offset of plot coordinates, drawn by row id."""
    e = C.table(spark, sf, "embeddings")
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.select("vec_id", F.round(vx.gaussian_jitter(x, 0.5, 7, "vec_id"), 6).alias("x"),
                    F.round(vx.uniform_offset(y, 0.4, 11, "vec_id"), 6).alias("y"))
