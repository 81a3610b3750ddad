"""Exact token ids of whole texts, encoding each distinct word once per worker.

The vocabulary's pre-tokenizer drops white space and no token spans it, so the
ids of a text are the ids of its white-space separated words in order (special
strings hold no white space either). A worker keeps the ids of words it has
seen; only unseen words reach the tokenizer. Tokenizers of another kind get
whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise RuntimeError("ids are kept as little-endian 32-bit numbers")

# The normalizer and the split pattern of the word-level vocabulary.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The same pattern on lower-cased text of printable ASCII and Latin-1 letters,
# where NFC changes nothing and case folds one character to one.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for
    themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class TextEncoder:
    """``ids(texts)``: for each UTF-8 text its ids as little-endian uint32 bytes.

    ``max_words`` bounds the word table and the table of parts of words (about
    200 bytes an entry). The words of full tables stay, being the frequent
    ones; others are then encoded whenever they come, to the same ids.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = ((made.get("normalizer") or {}).get("normalizers") == NORMALIZERS
                        and split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("invert") is True
                        and split[0].get("behavior") == "Removed"
                        and [x.get("type") for x in split] == ["Split", "ByteLevel"]
                        and made.get("post_processor") is None
                        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"]
                                    for t in made["added_tokens"]))
        self.special = [t["content"] for t in made["added_tokens"]]
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)").search
        self.letters = str.maketrans({chr(b): x for b, x in byte_letters().items()})
        self.max_words = max_words
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a lower-case piece that the pre-tokenizer does not split."""
        known = self.pieces.get(piece)
        if known is None:
            shown = piece.decode("latin-1")
            if not piece.isascii():
                shown = shown.translate(self.letters)
            known = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            if len(self.pieces) < self.max_words:
                self.pieces[piece] = known
        return known

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, hard, piece, get = {}, [], self._piece, self.pieces.get
        for w in words:
            if w.isalpha():  # of bytes: A-Z and a-z only
                low = w.lower()
                out[w] = get(low) or piece(low)
            elif w[-1:] in (b",", b".") and w[:-1].isalpha():
                out[w] = piece(w[:-1].lower()) + piece(w[-1:])
            else:
                s = w.decode("utf-8", "replace")
                if PLAIN.match(s) and not self.has_special(s):
                    out[w] = b"".join([get(x) or piece(x) for x in map(str.encode, PIECES.findall(s.lower()))])
                else:
                    hard.append((w, s))
        for i in range(0, len(hard), 1000):
            part = hard[i:i + 1000]
            out.update(zip((w for w, _ in part), self._encode([s for _, s in part])))
        room = self.max_words - len(self.words)
        if room > 0:
            self.words.update(islice(out.items(), room))
        return out

    def _fewer_words(self, texts: pa.Array) -> pa.Array:
        """The texts with fewer distinct words and the same ids: a full stop or comma
        between an ASCII letter or digit and white space stands alone, and ASCII texts
        are in lower case unless that could make a special string."""
        plain = pc.string_is_ascii(texts)
        for t in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, t, ignore_case=True))
        return pc.replace_substring_regex(pc.if_else(plain, pc.ascii_lower(texts), texts),
                                          r"([A-Za-z0-9])([.,])(\s)", r"\1 \2\3")

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._encode([t.decode("utf-8", "replace") for t in texts])
        # Arrow splits and numbers the words (ASCII white space, as ``bytes.split``),
        # so that Python meets each distinct one once
        made = pa.array(texts, pa.binary())
        made = self._fewer_words(pa.Array.from_buffers(pa.string(), len(made), made.buffers()))
        rows = pc.ascii_split_whitespace(made)
        words = rows.values.dictionary_encode()
        _, ends, chars = words.dictionary.buffers()
        at = np.frombuffer(ends, np.int32, len(words.dictionary) + 1, words.dictionary.offset * 4).tolist() if ends else [0]
        chars = chars.to_pybytes() if chars else b""
        distinct = [chars[i:j] for i, j in zip(at, at[1:])]
        known = list(map(self.words.get, distinct))
        new = [i for i, x in enumerate(known) if x is None]
        here = self._learn({distinct[i] for i in new})
        for i in new:
            known[i] = here[distinct[i]]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        index = words.indices.to_numpy(zero_copy_only=False)
        taken = size[index]
        stop = np.concatenate([[0], np.cumsum(taken)])
        # a word's ids stand together: place in ``flat`` less place in the result
        out = flat[np.repeat((np.cumsum(size) - size)[index] - stop[:-1], taken) + np.arange(stop[-1])].tobytes()
        cut = (4 * stop[rows.offsets.to_numpy() - rows.offsets[0].as_py()]).tolist() if len(rows) else [0]
        return [out[i:j] for i, j in zip(cut, cut[1:])]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of this vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
