"""Rule statistics of whole texts, as narrow rows.

Words are runs of anything but ASCII white space; lines are what stands between
line feeds. Per row: the counts of ``COUNTS`` and the shares of ``SHARES``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import small_batches, utf8

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
MARKS = b"!?"
STOPS = b".,;:"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_stops", "n_distinct", "n_wide", "top_word"]


def _among(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more (the first
    occurrence included); a word inside two such windows counts once."""
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) == max(0, len(words) - 2):
        return 0
    n, free = 0, 0  # free: first position not yet counted
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            n += i + 3 - max(i, free)
            free = i + 3
    return n


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    word_bytes = sum(map(len, words))
    seen, lines, dup = set(), text.split(b"\n"), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    often = Counter(words)
    shown = len(text.decode("utf-8", "replace"))
    return (len(words), shown - (len(text) - word_bytes), _among(text, SYMBOLS), dup, repeat_words(words), len(lines),
            _among(text, UPPER), _among(text, DIGITS), _among(text, MARKS), _among(text, STOPS), len(often),
            len(text) - shown, max(often.values(), default=0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        rows = [counts_of(t) for t in utf8(b, "text")]
        cols = zip(*rows) if rows else [[]] * len(COUNTS)
        kept = [n for n in b.schema.names if n != "text"]
        yield pa.record_batch([b.column(b.schema.get_field_index(n)) for n in kept]
                              + [pa.array(c, pa.int64()) for c in cols], names=kept + COUNTS)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and ``COUNTS`` of each row; a null text has no words and one empty line."""
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(_counted, "doc_id bigint, text_hash bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)))


#: Shares that do not depend on a text's length: numerator and denominator (1 at least).
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "stop_share": ("n_stops", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}


def with_shares(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(n) for n, (a, b) in SHARES.items()])
