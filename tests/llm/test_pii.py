import hashlib
import math
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from tests.conftest import SF0001
from themeloom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id bigint, text string, spans string, base string, kind_no string"


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def base_of(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items())
                  for m in re.finditer(p, text or "") if valid(k, m[0]))


def tokens(line):
    return [m for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", line)]


def spans_of(rows, disclosure=pii.DISCLOSURE, bits_left=pii.BITS_LEFT):
    """All spans of each row by plain counting."""
    lines = [line for _, t in rows for line in (t or "").split("\n")]
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    for line in lines:
        held = {m[0].lower() for m in tokens(line)}
        n_t.update(held)
        base = base_of(line)
        bare = list(line)
        for start, _, end in base:
            bare[start:end] = " " * (end - start)
        near = set()
        for start, kind, end in base:
            for m in tokens("".join(bare)):
                if (start - pii.WINDOW <= m.start() and m.end() <= start) or (end <= m.start() and m.end() <= end + pii.WINDOW):
                    near.add(((kind, line[start:end].lower()), m[0].lower()))
        n_e.update({(k, line[a:z].lower()) for a, k, z in base})
        n_te.update((e, t) for e, t in near if t in held)
    shown = set()
    for (e, t), n in n_te.items():
        whole, left = math.log2(len(lines) / n_e[e]), math.log2((n_t[t] + 1) / n)
        if whole > 0 and left <= bits_left + 1e-9 and whole - left >= disclosure * whole - 1e-9:
            shown.add(t)
    return [sorted([*base_of(t), *((m.start(), 4, m.end()) for m in tokens(t or "") if m[0].lower() in shown)]) for _, t in rows]


def listing(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    got = pii.find_personal_data(df, **how).select("doc_id", pii.listed(F.col("base")), pii.listed(F.col("spans"))).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    want = spans_of(rows)
    got = {r.doc_id: r for r in queries.QUERIES["op10_disclosure_pii"](spark, SF0001).collect()}
    assert len(got) == len(rows)
    for (i, text), spans in zip(rows, want):
        base = base_of(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(listing(base).encode()).hexdigest()
        assert r.spans == listing(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]


def test_odd_texts(spark):
    texts = [None, "", "\n", "a@b.c_x@d.e", "a@b.c.@d.e x@y", "%a@-.-é\U0001f600 b@c.d.e..f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.000000255.4",
             "1.1.1.999999999999999999999999", "4111 1111-1111 1111 and 4111111111111112", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 14,
             "+49 (30) 123-4567 89", "+1+22 333 444 5555 ", "+1 2.3.4.5678901", "++1 (((((((((1234567890123456", "é+33 1 23 45 67 89\U0001f600a@b.c 10.0.0.1",
             "9" * 5000, "a" * 5000, "a" * 3000 + "@" + "b." * 3000 + "c", "1." * 4000, "1 " * 3000, "a@b.c " * 700, "+1 " + "(" * 3000 + "234567890", " a@b.c\x85"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "other a@b.c"), (None, texts[4]), (None, texts[4])]
    want = sorted([(i, listing(base_of(t)), listing(s)) for (i, t), s in zip(rows, spans_of(rows))], key=str)
    assert found(spark, rows) == want
    assert found(spark, []) == []


def corpus():
    """1,200 plain lines, names beside an address written once, and a name that mostly stands elsewhere."""
    rows = [(i, f"plain words number {chr(97 + i % 26)} of the text\nand the rest {chr(97 + i % 7)}") for i in range(600)]
    rows += [(1000 + i, f"ask Zorblat, of the {w} house (zb@x.org)\nmore of the text") for i, w in enumerate(["red", "old", "big"])]
    rows += [(1010, "call +49 30 1234567 or Quimby\u0301 now!"), (1011, "the rest: zorblat's"), (1012, "Zorblatt is of plain words"),
             (1013, "account K7731 of the 10.1.2.3"), (1014, "the text " + "of the rest " * 8 + "Farwell, once" + " and the rest" * 8 + " f@y.org"),
             (1020, "Elsewhere e@z.org"), (1021, "Elsewhere"), (1022, "elsewhere of"), (1030, "é_e1@z.org_\U0001f600ß 4111111111111111x")]
    return rows


def test_terms_follow_co_occurrence(spark):
    rows = corpus() + [(None, "of Zorblat\nand\tZorblat"), (None, None), (1011, "the rest: zorblat's"), (1011, "other Zorblat")]
    for disclosure, bits_left in ((.9, 1.0), (.5, 3.0), (1.0, 1.0), (.8, .5)):
        want = spans_of(rows, disclosure, bits_left)
        got = found(spark, rows, disclosure=disclosure, bits_left=bits_left)
        assert got == sorted([(i, listing(base_of(t)), listing(s)) for (i, t), s in zip(rows, want)], key=str)


def test_query_finds_names_beside_a_one_off_address(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.QUERIES["op10_disclosure_pii"](spark, str(tmp_path)).collect()}
    assert got == {i: listing(s) for (i, _), s in zip(rows, spans_of(rows))}
    assert "term:23:30" in got[1010] and "term:8:13" in got[1013]     # written once, beside what is written once
    assert "term:4:11" in got[1000] and got[1011] == "term:10:17"     # also where the address does not stand
    assert "term" not in got[1014]                                    # too far from the address
    assert got[1012] == ""                                            # another word
    assert got[1020] == "email:10:17" and got[1021] == ""             # stands elsewhere twice in three
    assert all(got[i] == "" for i in range(600))


def test_sanitised_text(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in corpus()], DOCS)
    out = pii.sanitised(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    # "ask" and "house" stand beside the address only: removed; "Zorblat" also elsewhere: generalised
    assert text[1000] == " [NAME], of the red  ([EMAIL])\nmore of the text"
    assert text[1011] == "the rest: [TERM]'s" and text[1010] == " [PHONE]   !"
    assert text[1013] == "  of the [IP]" and text[1012] == "Zorblatt is of plain words" and text[0] == corpus()[0][1]
