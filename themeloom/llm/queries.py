"""One query per training-data operator, over the whole of its table.

``QUERIES[name](spark, sf_dir)`` applies the operator with production
parameters and derives the digest columns from its output; ``ORACLE[name]`` is
the same in DuckDB's SQL where SQL can state it at this size (the others are
tested against brute force in ``tests/llm``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import alignment, byte_bpe, collocations, hamming, line_dedup, mixing, ngram_join, packing, pii, quality_rules, rule_ensemble, textstats, token_counts, warc
from themeloom.llm.common import shared_folder, stage
from themeloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run starts a cache of its own, so every distinct text is encoded."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     shared_folder(spark, "token-cache"), TOKENIZER)


@query("op7_line_dedup", r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), common as (
  select key from k where key <> '' group by key having count(distinct doc_id) >= 10
), m as (
  select k.*, c.key is not null as dropped from k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
            .select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                    F.sha2("text", 256).alias("kept_sha256")))


@query("op6_source_mix", r"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), k as (
  select doc_id, source, size,
         -ln((('0x' || substr(md5('mix' || chr(10) || coalesce(doc_id::varchar, '') || chr(10) || t), 1, 13))::bigint
              ::double + 0.5) / 4503599627370496.0)
         / (1.0 / (1.0 + 20.0 * (strlen(t) - strlen(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(size, 1)))
         as key
  from d
), s as (
  select source, sum(size)::bigint as source_size,
         ([3.0, 1.0, 2.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w
  from k group by source
), f as (
  select *, 2 * source_size as cap, sum(source_size) over () * 1.5::double as total from s
), g as (
  select *, cap / w <= (total - coalesce(sum(cap) over (order by cap / w, source nulls last
                          rows between unbounded preceding and 1 preceding), 0))::double
                     / sum(w) over (order by cap / w, source nulls last
                          rows between current row and unbounded following) as capped
  from f
), h as (
  select source, source_size,
         case when capped then cap::double
              else w * ((total - coalesce(sum(case when capped then cap end) over (), 0))::double
                        / sum(case when not capped then w end) over ()) end as target
  from g
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from h
), r as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs,
         sum(k.size) over (partition by k.source order by k.key) - k.size / 2.0
           <= e.target - e.epochs * e.source_size as once_more
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target, (size * (epochs + once_more::int))::bigint as taken from r""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = stage(mixing.sized(docs).select("doc_id", "source", "__size", "__key"), "mix-sizes")
    out = mixing.mixed(rows, mixing.mixing_plan(rows))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


@query("op3_warc_round_trip", """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from f""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    return warc.restored_pages(warc.reassemble(warc.read_segments(spark, archives))).drop("error")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stage(textstats.text_counts(table(spark, sf_dir, "documents")), "rule-counts")
    model = quality_rules.fit_rules(counts, table(spark, sf_dir, "labels"))
    return quality_rules.judge(counts, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_retrieval_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op9_hamming_top_k", """
with c as (
  select vec_id, list_aggregate(list_transform(embedding, lambda x: case when x >= 0 then '1' else '0' end),
                                'string_agg', '') as code
  from embeddings
), d as (
  select q.vec_id as query_id, v.vec_id, hamming(q.code, v.code)::int as distance
  from c q cross join c v where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by distance, vec_id)::int as rank, vec_id, distance
from d qualify rank <= 10""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.hamming_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=10, segments=4)


@query("op10_disclosure_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind_no"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}")
         for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query("op4_rule_ensemble")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stage(textstats.text_counts(table(spark, sf_dir, "documents")), "rule-counts")
    return rule_ensemble.scored(counts, rule_ensemble.fit_ensemble(counts, table(spark, sf_dir, "labels")))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode_ids(made, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_collocations", r"""
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select row_number() over () as id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p
), x as (
  select id, lang, unnest(w) as w1, generate_subscripts(w, 1) as i from w
), y as (
  select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3 from x window o as (partition by id order by i)
), f as (
  select lang, [w1] as g, count(*) as a from y group by lang, w1
  union all select lang, [w1, w2], count(*) from y where w2 is not null group by lang, w1, w2
  union all select lang, [w1, w2, w3], count(*) from y where w3 is not null group by lang, w1, w2, w3
), n as (
  select lang, sum(a)::bigint as n from f where len(g) = 1 group by lang
), c as (
  select * from f where len(g) >= 2 and a >= 10
), longer as (
  select lang, g, max(a) as best
  from (select lang, g[1:2] as g, a from c where len(g) = 3 union all select lang, g[2:3] as g, a from c where len(g) = 3)
  group by lang, g
), cut as (
  select c.lang, c.g, c.a, unnest(range(1, len(c.g))) as k
  from c left join longer using (lang, g) where 100 * coalesce(longer.best, 0) < 50 * c.a
), halves as (
  select lang, array_to_string(g, ' ') as phrase, a, k,
         lang || chr(9) || array_to_string(g[1:k], ' ') as head, lang || chr(9) || array_to_string(g[k + 1:], ' ') as tail from cut
), t as (
  select lang || chr(9) || array_to_string(g, ' ') as key, a from f where a >= 10
), s as (
  select lang, phrase, h.a, k, x.a as l, y.a as r, (1000000::hugeint * h.a * h.a) // (x.a::hugeint * y.a) as score
  from halves h join t x on x.key = h.head join t y on y.key = h.tail
), one as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
       phrase, a, l, r, n.n, score::bigint as score
from one join n using (lang) qualify rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, inside_percent=50, limit=2000)
