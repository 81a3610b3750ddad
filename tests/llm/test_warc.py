import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.llm import warc
from themeloom.llm.common import shared_folder
from themeloom.session import ship_package

PAGES = "page_id bigint, url string, html string, n_words int, record_type string"


@given(st.binary(max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_chunk_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"])
def test_broken_chunks_raise(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        seen = first.get(html) if i is not None and len(b) >= 100 else None
        revisit = seen is not None and seen < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", seen if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, **how):
    ship_package(spark)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], PAGES)
    path = shared_folder(spark, "warc-test")
    warc.write_archives(df, path, **how)
    records = warc.reassemble(warc.read_segments(spark, path)).cache()
    return records, warc.restored_pages(records)


@pytest.mark.parametrize("segment_bytes", [1, 2, 3, 7, 64, 4096])
def test_round_trip(spark, segment_bytes):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n" + "x" * 40
    rows = [(1, "http://a b\r\nX: y", long), (2, None, long), (3, "u", long), (4, "u", None), (5, "u", ""), (6, "u", "short"),
            (7, "u", "short"), (7, "u", "short"), (8, "u", "\r\n" * 70), (9, "u", "\r\n" * 70), (9, "u", "\r\n" * 70),
            (None, "u", long), (None, "u", long), (10, "u", "z" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99), (13, "u", "z" * 100)]
    records, pages = round_trip(spark, rows, segment_bytes=segment_bytes, chunk_bytes=16)
    assert records.filter("error is not null").count() == 0
    got = sorted([tuple(r) for r in pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)
    assert got == expected(rows)
    texts = {bytes(r.payload) for r in records.filter("record_type = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h in rows}
    if segment_bytes < 4096:
        assert records.agg(F.max("segments")).first()[0] > 1


def test_empty_table(spark):
    records, pages = round_trip(spark, [])
    assert pages.count() == 0


def test_damage_is_reported(spark):
    records, _ = round_trip(spark, [(1, "u", "a" * 500), (2, "u", "b" * 500), (3, "u", "c" * 500)], segment_bytes=100)
    path = shared_folder(spark, "warc-damage")
    warc.write_archives(spark.createDataFrame([(i, "u", c * 500, 0, "") for i, c in ((1, "a"), (2, "b"), (3, "c"))], PAGES),
                        path, segment_bytes=100)
    segments = warc.read_segments(spark, path)
    origin = F.coalesce("page_id", F.lit(0))
    ids = {r.page_id: r.record_id for r in segments.filter("page_id is not null").collect()}
    # page 1 loses its third segment, page 2 its first, page 3 has a wrong total
    cut = (segments.filter(~((F.col("origin_id") == ids[1]) & (F.col("segment") == 3)))
           .filter(origin != 2)
           .withColumn("total_bytes", F.when(F.col("origin_id") == ids[3], F.col("total_bytes") + 1).otherwise(F.col("total_bytes"))))
    errors = sorted(r.error for r in warc.reassemble(cut).collect())
    assert errors == ["origin segment is missing", "segment numbers have a gap", "total length differs from the segments' bytes"]
