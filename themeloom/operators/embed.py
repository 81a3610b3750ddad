"""M5: embed text to fixed-width vectors in Arrow batches.

The encoder is injected: any callable ``list[str] -> np.ndarray (n, dim)``
(a sentence encoder loaded once per task, a remote service client, ...).
It runs inside ``mapInPandas`` so the text never leaves the executors, and is
called on chunks of ``batch_size`` texts (the reference used 10 to bound
memory).

The default encoder works offline: words are hashed into ``dim`` buckets with a
sign, both from the MD5 of the word (so that another engine can restate it),
term frequency is sublinear, vectors are L2 normalised. It gives lexical, not
semantic, similarity; thresholds tuned for a neural encoder (e.g. 0.85
zero-shot) must stay parameters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORD = re.compile(r"\w+", re.UNICODE)


class HashingEncoder:
    """Each distinct word of a call is hashed once, one of the ``KEPT`` words
    that a task met first only once; sums run over arrays."""

    KEPT = 1 << 17

    def __init__(self, dim: int = 384):
        self.dim, self.met = dim, {}

    def place(self, word: str) -> tuple[int, float]:
        found = self.met.get(word)
        if found is None:
            h = hashlib.md5(word.encode()).hexdigest()
            found = int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) < 8 else -1.0
            if len(self.met) < self.KEPT:
                self.met[word] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [_WORD.findall((t or "").lower()) for t in texts]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        out = np.zeros((len(texts), self.dim))
        if number:
            place = [self.place(w) for w in number]
            bucket, sign = np.array([p for p, _ in place]), np.array([s for _, s in place])
            row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
            word = np.array([number[w] for ws in words for w in ws])
            pairs, tf = np.unique(row * len(number) + word, return_counts=True)
            row, word = pairs // len(number), pairs % len(number)
            np.add.at(out, (row, bucket[word]), sign[word] * (1.0 + np.log(tf)))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return out / n


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 384,
          batch_size: int = 10, truncate_dim: int | None = None) -> DataFrame:
    """``df`` plus ``out_col ARRAY<FLOAT>``. ``truncate_dim`` keeps the first
    components (the reference truncates one corpus to 384)."""
    enc = encoder or HashingEncoder(dim)
    width = truncate_dim or dim
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                m = np.asarray(enc(texts[i:i + batch_size]), dtype=np.float32)[:, :width]
                vecs.extend(list(m))
            out = pdf.copy()
            out[out_col] = pd.Series(vecs, index=pdf.index, dtype=object)
            yield out

    return df.mapInPandas(run, schema)
