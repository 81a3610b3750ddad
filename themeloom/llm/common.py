"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.session import shared_folder, stage  # noqa: F401  (the operators' way to written tables)

#: ASCII white space, as a Java character class. Python's ``bytes.split`` and
#: ``bytes.strip`` use exactly this set, and ``bytes.lower`` maps A-Z only.
SPACE = r"[\x20\x09-\x0D]"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_hash(col: str = "text") -> Column:
    """With the document id this names a row; equal rows share the name."""
    return F.xxhash64(F.col(col))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null becomes b''."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` (at least a row)."""
    for b in batches:
        rows = max(1, int(b.num_rows * max_bytes / max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
