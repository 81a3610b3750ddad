"""The corpus stand-ins of :mod:`themeloom.sources.corpora`, written as
portable SQL for the independent (DuckDB) oracle. Each constant is a CTE body;
``with_views(...)`` prefixes a query with the views it names."""

from __future__ import annotations

VIEWS = {
    "works": """
select d.doc_id as ordinal, 'doi:' || md5(d.text) as doi,
       split_part(d.text, chr(10), 1) as title,
       nullif(substr(d.text, length(split_part(d.text, chr(10), 1)) + 2), '') as abstract,
       cast(d.n_chars as double) / 100 as relevance_score,
       d.doc_id % 97 as cited_by_count,
       coalesce(l.toxic, 0) = 1 as is_retracted,
       d.source as journal, d.lang
from documents d left join labels l on d.doc_id = l.doc_id""",
    "works_flat": """
select doc_id as ordinal, cast(doc_id % 50 as varchar) as volume,
       case when doc_id % 13 = 0 then null else cast(doc_id % 12 as varchar) end as issue,
       cast(doc_id * 10 as varchar) as first_page, cast(doc_id * 10 + 9 as varchar) as last_page,
       case when doc_id % 17 = 0 then null else 'pm' || cast(doc_id as varchar) end as pmid,
       source as journal, 'pub ' || lang as publisher, 'issn-' || source as issn_l,
       'T' || cast(doc_id % 10 as varchar) as "primary_topic.id",
       lang || ' topic' as "primary_topic.display_name"
from documents""",
    "abstracts": """
select cast(substr(source, 4) as int) % 4 as file_no, doc_id as file_pos,
       'doi:' || cast(doc_id % 300 as varchar) as doi,
       case when doc_id % 7 = 0 then null else split_part(text, chr(10), 1) end as title,
       text as abstract,
       case when cast(substr(source, 4) as int) % 4 = 0 then 'main' else 'wider' end as category,
       case when doc_id % 11 = 0 then null else doc_id % 23 end as total_cites
from documents""",
    "answers": """
select conv_id * 100 + turn as row_id,
       case when conv_id % 3 = 0 then 'model-a' else 'model-b' end as gpt_model,
       cast(case turn % 4 when 1 then 0.0 else 0.5 end as double) as temperature,
       case when conv_id % 10 = 9 then null else 'be helpful' end as system_message, text
from conversations where role = 'assistant'""",
    "answer_lines_raw": """
select row_id, gpt_model, temperature, system_message,
       cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) as pos,
       unnest(string_split(text, chr(10))) as line
from answers""",
    "answer_lines": """
select row_id, gpt_model, temperature, system_message, pos,
       cast(pos + 1 as varchar) || '. **' || split_part(line, ' ', 1) || '**: ' || line as line
from answer_lines_raw""",
    "topic_docs": """
select d.doc_id as row_id,
       case when coalesce(e.label, cast(d.doc_id % 10 as integer)) = 9 then -1
            else coalesce(e.label, cast(d.doc_id % 10 as integer)) end as topic,
       case when d.doc_id % 3 = 0 and coalesce(e.label, cast(d.doc_id % 10 as integer)) % 2 = 0 then 1.0e0
            else cast(d.doc_id % 100 as double) / 100 end as probability,
       d.doc_id % 97 as total_cites, d.text as title_abstract, e.embedding
from documents d left join embeddings e on e.vec_id = d.doc_id""",
}

# views that other views read
DEPENDS = {"answer_lines": ["answers", "answer_lines_raw"], "answer_lines_raw": ["answers"]}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    body = sql.lstrip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{sql}"
