"""Column functions on literal rows."""
from pyspark.sql import functions as F

from themeloom.functions import text as tx


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col(F.col("s")).alias("o")).first()["o"]


def test_docstring_heading(spark):
    s = "12. **River Floods and Dams**: how towns near a river plan for high water, and who pays for it"
    assert one(spark, tx.theme_headings, s) == ["river floods and dams"]


def test_headings_plain_and_trailing_marks(spark):
    assert one(spark, tx.theme_headings, "1. Alpha: x 2. Beta.: y") == ["alpha", "beta"]
    assert one(spark, tx.first_heading, "no heading here") is None


def test_clean_abstract_reference_order(spark):
    # punctuation collapse runs before tag removal: adjacent tags are damaged
    assert one(spark, tx.clean_abstract, "<p>one</p><p>two</p>") == "onep>two"
    assert one(spark, lambda c: tx.clean_abstract(c, tags_first=True), "<p>one</p><p>two</p>") == "onetwo"


def test_abstraction_quirk(spark):
    assert one(spark, tx.clean_abstract, "Abstraction of things") == "ion of things"
    assert one(spark, lambda c: tx.clean_abstract(c, whole_word=True), "Abstraction of things") == "Abstraction of things"
    assert one(spark, tx.clean_abstract, "Abstract: The text") == " The text"


def test_line_breaks_joined_without_space(spark):
    assert one(spark, tx.remove_line_breaks, "a\r\nb\nc") == "abc"


def test_unicode_whitespace(spark):
    assert one(spark, tx.collapse_whitespace, "a   b  ") == "a b"


def test_duplicate_punctuation(spark):
    assert one(spark, tx.collapse_punctuation, "wow!!! really?!. ok") == "wow! really? ok"


def test_null_passes_through(spark):
    assert one(spark, tx.clean_abstract, None) is None


def test_title_abstract(spark):
    df = spark.createDataFrame([("A title.", "body"), ("No dot", "body")], "t string, a string")
    got = [r[0] for r in df.select(tx.title_abstract("t", "a")).collect()]
    assert got == ["A title. body", "No dot. body"]


def test_answer_line_cleaning(spark):
    assert one(spark, tx.clean_answer_line, "12. **Bold**: text*") == " Bold: text"
    assert one(spark, lambda c: tx.conclusion(tx.answer_lines(c)), "1. x\n\nIn sum, yes") == "In sum, yes"
    assert one(spark, lambda c: tx.conclusion(tx.answer_lines(c)), "1. x\n2. y") is None


def test_keyword_list(spark):
    assert one(spark, tx.keyword_list, "machine learning, ai") == ["machinelearning", "ai"]
    assert one(spark, lambda c: tx.keyword_list(c, trim_only=True), "machine learning, ai") == ["machine learning", "ai"]


def test_tokenisations(spark):
    assert one(spark, tx.space_tokens, "a  b") == ["a", "", "b"]
    assert one(spark, tx.whitespace_tokens, " a \n b ") == ["a", "b"]


def test_inverted_index_roundtrip(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "m map<string,array<int>>")
    assert df.select(tx.text_from_inverted_index("m")).first()[0] == "a b c b"


def test_citation_bands(spark):
    df = spark.createDataFrame([(0,), (3,), (10,), (25,), (60,), (None,)], "c bigint")
    got = [r[0] for r in df.select(tx.citation_band("c", F.lit(10.7), F.lit(20.0), F.lit(50.0))).collect()]
    assert got == ["5-9", "5-9", "10-19", "20-49", "50+", "50+"]
    got = [r[0] for r in df.select(tx.citation_band("c", F.lit(10.7), F.lit(20.0), F.lit(50.0), zero_na=True)).collect()]
    assert got == ["NA", "5-9", "10-19", "20-49", "50+", "50+"]


def test_snake_case():
    assert tx.snake_case("Name:") == "name"
    assert tx.snake_case("__N chars (total)") == "n_chars_total"


def test_a_vector_takes_its_norm_once(spark):
    from themeloom.functions import vectors as vx

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(vx.l2_normalize("v").alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_an_index_moves_texts_not_words(spark, tmp_path):
    from themeloom.plans import q_text

    rows = [(1, "b a  b"), (2, None), (3, " "), (4, "x"), (4, "y x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_text.x15_text_from_inverted_index(spark, str(tmp_path))
    moves = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert moves and not any("word" in x for x in moves)
    assert out.count() == 5


def test_the_encoder_hashes_a_word_once_and_keeps_so_many(monkeypatch):
    from themeloom.operators import embed

    calls = []
    plain = embed.hashlib.md5
    monkeypatch.setattr(embed.hashlib, "md5", lambda b: calls.append(b) or plain(b))
    enc = embed.HashingEncoder(16)
    first = enc(["red fish"])
    assert (enc(["fish red"]) == first).all() and len(calls) == 2
    monkeypatch.setattr(embed.HashingEncoder, "KEPT", 2)
    assert (enc(["blue"]) == embed.HashingEncoder(16)(["blue"])).all() and len(enc.met) == 2
