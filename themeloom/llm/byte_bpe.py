"""Byte-level BPE by a table of ranks: texts to ids with offsets, ids to bytes.

A rank file lists byte strings; the merges that make each of them are found
again from the ranks alone, so that the tokenizers library can run them on
texts whose bytes are written as printable characters (``byte_letters``). Ids
are those of the tiktoken library for the same ranks and split pattern.

A match of the pattern never holds a space behind a visible character, so a
text is cut there; a worker keeps the ids of the parts it has met (most are a
space and a word) and sends only unseen ones, as one batch, to the library.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from themeloom.llm.common import small_batches, text_or_empty, utf8
from themeloom.llm.tokens import byte_letters

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that no split pattern takes for white space, and a space after one.
VISIBLE = "!-~¡-ÿĀ-ɏͰ-ϿЀ-ԯぁ-ヿ一-鿿가-힣"
CUT = re.compile(f"(?<=[{VISIBLE}])(?= .)", re.DOTALL)
UNSAFE = re.compile(f"[^{VISIBLE}] ")
CLOSED = re.compile(f"[{VISIBLE}]\\Z")


def space_parts(text: str) -> list[str]:
    """Cut a text before every space that follows a visible character and is
    not the text's last one."""
    if UNSAFE.search(text) or text[:1] == " " or text[-1:] == " ":
        return CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> id, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: merging the lowest rank below
    its own until two are left. None where more are left: no merge makes it."""
    limit, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def byte_tokenizer(path: str, pattern: str) -> Tokenizer:
    """The library's tokenizer for a rank file and a split pattern."""
    ranks, letters = read_ranks(path), byte_letters()
    shown = {token: "".join(map(letters.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pair = halves(token, ranks) if len(token) > 1 else None
        if pair:
            merges.append((shown[pair[0]], shown[pair[1]]))
    # a whole match that is in the table is one token, whatever its merges
    made = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class ByteEncoder:
    """``ids(texts)``: each text's ids as little-endian uint32 bytes.

    At most ``max_parts`` parts of texts are kept (about 250 bytes each), parts
    of over 64 characters never; others are encoded whenever they come."""

    def __init__(self, tokenizer: Tokenizer, size: np.ndarray, max_parts: int = 300_000):
        self.tokenizer, self.size, self.max_parts = tokenizer, size, max_parts
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in made]

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Parts that may stand behind each other go to the library as one
        text; the byte lengths of its tokens tell where each part ends."""
        chain = [p for p in parts if p[0] == " " and len(p) <= 64 and CLOSED.search(p)]
        rest = set(parts).difference(chain)
        out = dict(zip(rest, (x.tobytes() for x in self._library(list(rest)))))
        for i in range(0, len(chain), 2000):
            run = chain[i:i + 2000]
            ids = self._library(["".join(run)])[0]
            ends = np.cumsum([len(p.encode()) for p in run])
            cut = [0, *(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()]
            data = ids.tobytes()
            out.update((p, data[4 * a:4 * z]) for p, a, z in zip(run, cut, cut[1:]))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [space_parts(t) for t in texts]
        known = self.known
        here = self.learn(list({p for parts in split for p in parts if p and p not in known}))
        here[""] = b""
        room = self.max_parts - len(known)
        if room > 0:
            known.update(islice(((p, x) for p, x in here.items() if len(p) <= 64), room))
        return [b"".join([known[p] if p in known else here[p] for p in parts]) for parts in split]


_MADE: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """One object per worker process."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def byte_table(path: str) -> list[bytes]:
    """Id -> bytes, from the written form back (gaps are empty)."""
    back = {c: b for b, c in byte_letters().items()}
    letters = byte_letters()
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        written = "".join(map(letters.__getitem__, token))
        table[rank] = bytes(back[c] for c in written)
    return table


def char_offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last code point of tokens of these byte lengths. A
    token that holds a part of a character counts the whole of it, so tokens
    of a split character overlap by it."""
    ends = np.cumsum(lengths)
    # number of characters begun in the first i bytes
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    starts = ends - lengths
    return begun[np.minimum(starts + 1, len(text))] - 1, begun[ends]


def split_ends(data: bytes) -> tuple[int, int]:
    """Bytes at the start that continue an earlier character, and bytes at the
    end that begin one without finishing it."""
    lead = next((i for i, b in enumerate(data[:3]) if b & 0xC0 != 0x80), min(3, len(data)))
    for back in range(1, min(3, len(data) - lead) + 1):
        b = data[-back]
        if b & 0xC0 != 0x80:
            width = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return lead, back if width > back else 0
    return lead, 0


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit numbers, whole text, no special tokens).

    With ``offsets`` also char_start and char_end (arrays of code points, end
    exclusive). A null text counts as empty and has no ids; repeated rows and
    null ids each give a row; other columns are not looked at. ``ranks_path``
    must be readable on every executor (it is part of the environment).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.fromiter(map(len, kept(("table", ranks_path), lambda: byte_table(ranks_path))), np.int64)
        enc = kept(("encoder", ranks_path, pattern), lambda: ByteEncoder(byte_tokenizer(ranks_path, pattern), size))
        for b in small_batches(batches):
            texts = utf8(b, "text")
            ids = enc.ids([t.decode("utf-8", "replace") for t in texts])
            cols = [b.column(b.schema.get_field_index("doc_id")), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary())]
            if offsets:
                at = [char_offsets(t, size[np.frombuffer(x, "<u4")]) for t, x in zip(texts, ids)]
                cols += [pa.array([x[i] for x in at], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.record_batch(cols, names=names)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary"
    names = ["doc_id", "n_tokens", "ids"] + (["char_start", "char_end"] if offsets else [])
    return rows.mapInArrow(run, schema + (", char_start array<int>, char_end array<int>" if offsets else ""))


def decode_ids(rows: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with three more columns: ``decoded``, the bytes of its ids;
    ``n_lead`` and ``n_open``, how many bytes at its start continue a character
    begun before it, and how many at its end begin one that it does not finish.

    A row may hold any run of a text's ids: the decoded bytes of its runs, in
    order, are the text's, and what lies between lead and open is whole
    characters. Null ids give empty bytes; an unknown id is an error. Columns
    of the three new names are replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("table", ranks_path), lambda: byte_table(ranks_path))
        for b in small_batches(batches):
            held = b.column(b.schema.get_field_index(ids)).to_pylist()
            out = [b"".join(map(table.__getitem__, array("I", x or b""))) for x in held]
            ends = [split_ends(x) for x in out]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary()), *[pa.array([e[i] for e in ends], pa.int32())
                                                                             for i in (0, 1)]],
                                  names=[*b.schema.names, "decoded", "n_lead", "n_open"])

    rows = rows.drop("decoded", "n_lead", "n_open")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType()),
                           T.StructField("n_lead", T.IntegerType()), T.StructField("n_open", T.IntegerType())])
    return rows.mapInArrow(run, schema)
