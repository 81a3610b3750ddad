import hashlib
import re
from collections import Counter

import pytest

from themeloom.llm import line_dedup
from themeloom.session import ship_package

DOCS = "doc_id bigint, text string, line string, text_hash string, n_lines string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(FOLD)


def brute(rows, min_docs, min_chars):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 4), (1, 1), (50, 1)])
def test_matches_brute_force(spark, min_docs, min_chars):
    ship_package(spark)
    common = ["Home", " home\t", "HOME\r", "Éa", "éa", "", "  ", "\x85x", "aé\U0001f600", "İ"]
    rows = [(i, "\n".join([common[i % 10], f"own {i}", common[(i * 3) % 10], common[i % 7], "all of them"])) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (None, "home\nx"), (None, "home\nx"), (5, rows[5][1]), (5, "home\nother"),
             (43, "home\n" * 20_000 + "end"), (44, "k " * 50_000)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    out = line_dedup.drop_common_lines(df, min_docs, min_chars)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    got = sorted([(r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in out.collect()], key=str)
    digest = lambda rows: [(i, hashlib.sha256(t.encode()).hexdigest(), *n) for i, t, *n in rows]
    assert digest(got) == digest(brute(rows, min_docs, min_chars))


def test_empty_table(spark):
    ship_package(spark)
    assert line_dedup.drop_common_lines(spark.createDataFrame([], DOCS)).count() == 0
