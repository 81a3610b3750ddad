"""BM25 ranking of documents against a research question.

Contract (Okapi BM25 as the reference computes it, SURVEY 2.9.1):

* ``k1 = 1.5, b = 0.75, epsilon = 0.25``
* ``idf(t) = ln(N - n_t + 0.5) - ln(n_t + 0.5)`` over the whole vocabulary;
  every negative idf becomes ``epsilon * mean(idf over the vocabulary)``
  (the mean includes the negative ones)
* ``score(d) = sum over query tokens q (repeats count) of
  idf(q) * f * (k1 + 1) / (f + k1 * (1 - b + b * |d| / avgdl))``;
  unknown tokens add 0
* case and punctuation are kept; documents are tokenised by single spaces
  (empty tokens included) for the score, by whitespace runs for the
  retriever variant (M4).

Plan shape: one aggregate counts document frequencies (a token moves once per
document, partial aggregation first) and folds them to numbers that are bound
as literals, so the scoring plan is one scan: lengths and frequencies of the
question's tokens are counted within the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.session import stage

K1, B, EPSILON = 1.5, 0.75, 0.25


def _tokens(text: Column, tokenizer: str) -> Column:
    if tokenizer == "space":
        return tx.space_tokens(text)
    if tokenizer == "whitespace":
        return tx.whitespace_tokens(text)
    raise ValueError(tokenizer)


def query_tokens(question: str, tokenizer: str = "space") -> list[str]:
    return question.split(" ") if tokenizer == "space" else question.split()


def bm25_scores(df: DataFrame, question: str, text_col: str = "title_abstract",
                score_col: str = "bm25_score", tokenizer: str = "space",
                k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """M2: ``df`` with a ``score_col`` (double) for every row; rows that match
    nothing score 0 and stay in."""
    q = query_tokens(question, tokenizer)
    counts = corpus_statistics(df, sorted(set(q)), text_col, tokenizer)
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.size("_tok").cast("double") / F.lit(counts.avgdl))
    # one look at each token; the score then reads the few that the question holds
    out = df.withColumn("_tok", _tokens(F.col(text_col), tokenizer)).withColumn(
        "_hits", F.filter("_tok", lambda x: x.isin(*set(q))))
    score = F.lit(0.0)
    for t in q:  # query order, repeats included
        raw = counts.idf.get(t, 0.0)
        w = epsilon * counts.mean_idf if raw < 0 else raw
        f = (F.size("_hits") - F.size(F.array_remove("_hits", t))).cast("double")
        score = score + F.lit(w) * (f * (k1 + 1)) / (f + norm)
    return out.withColumn(score_col, score).drop("_tok", "_hits")


@dataclass
class CorpusStatistics:
    """What the score needs of the whole corpus: a few numbers."""

    avgdl: float
    mean_idf: float
    idf: dict[str, float]


def corpus_statistics(df: DataFrame, terms: list[str], text_col: str = "title_abstract",
                      tokenizer: str = "space") -> CorpusStatistics:
    """One pass over the corpus; a few numbers come to the driver.

    Each document gives its distinct tokens and, under a null token, its length;
    a token's document frequency and the corpus sums then meet in one
    aggregation by token, and the vocabulary is folded to one row."""
    toks = _tokens(F.col(text_col), tokenizer)
    held = (df.select(toks.alias("_tok")).select(F.size("_tok").alias("dl"), F.explode(
        F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_tok"))).alias("term"), F.lit(1).alias("one")))
    vocab = held.groupBy("term").agg(F.count("one").alias("n_t"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))
    total = F.sum(F.when(F.col("term").isNull(), F.col("n_t")))
    # every idf needs the number of documents, so the vocabulary is folded by frequency and written first
    by_value = stage(vocab.groupBy(F.when(F.col("term").isNotNull(), F.col("n_t")).alias("n_t")).agg(
        F.count("*").alias("terms"), total.alias("docs"), F.sum("length").alias("length"),
        F.collect_list(F.when(F.col("term").isin(*terms), F.col("term"))).alias("asked")), "bm25-frequencies")
    sums = by_value.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    docs, length = sums["docs"] or 0, sums["length"] or 0
    known = by_value.filter("n_t is not null").withColumn(
        "idf", F.ln(F.lit(float(docs)) - F.col("n_t") + 0.5) - F.ln(F.col("n_t") + 0.5))
    mean = known.agg((F.sum(F.col("idf") * F.col("terms")) / F.sum("terms")).alias("mean")).first()["mean"]
    found = known.filter(F.size("asked") > 0).select(F.explode("asked").alias("term"), "idf").collect()  # the question's tokens
    return CorpusStatistics(length / docs if docs else 0.0, mean or 0.0, {r["term"]: r["idf"] for r in found})


def bm25_filter(df: DataFrame, question: str, k: int = 1000, text_col: str = "title_abstract",
                order_col: str = "ordinal", score_col: str = "bm25_score") -> DataFrame:
    """M3 = M2 + W5: the ``k`` best-scoring rows (ties by ``order_col``)."""
    scored = bm25_scores(df, question, text_col, score_col)
    return scored.orderBy(F.col(score_col).desc(), F.col(order_col)).limit(k)


def bm25_retrieve(df: DataFrame, question: str, k: int = 1000, text_col: str = "title_abstract",
                  order_col: str = "ordinal") -> DataFrame:
    """M4: the retriever variant. The ``bm25_score`` column comes from
    single-space tokens, but the ranking (``retriever_score``) from
    whitespace tokens, as the reference's retriever tokenises with
    ``str.split()``."""
    scored = bm25_scores(df, question, text_col, "bm25_score", "space")
    scored = bm25_scores(scored, question, text_col, "retriever_score", "whitespace")
    return scored.orderBy(F.col("retriever_score").desc(), F.col(order_col)).limit(k)
