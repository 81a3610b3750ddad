"""Column functions over dense vectors stored as ``array<float|double>`` (M1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two equal-length arrays, in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Unit-length copy of a vector (in double); zero vectors stay zero. The
    norm is bound once: inside the inner function it would be taken per component."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(
        _c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return F.get(scaled, F.lit(0))


def cosine(a, b) -> Column:
    """M1: cosine similarity; null when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def _uniform(row_id, seed: int, part: int) -> Column:
    """A number in (0, 1) from 12 hexadecimal digits of the MD5 of seed and row id."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), _c(row_id).cast("string")))
    return (F.conv(F.substring(h, 1 + 12 * part, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def gaussian_jitter(c, sigma: float, seed: int, row_id) -> Column:
    """``x + sigma * N(0, 1)`` (Box-Muller). The draw belongs to the row
    id, so it does not depend on how rows are partitioned."""
    u, v = _uniform(row_id, seed, 0), _uniform(row_id, seed, 1)
    return _c(c) + F.lit(sigma) * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def uniform_offset(c, width: float, seed: int, row_id) -> Column:
    """``x + U(-width/2, width/2)``, drawn by row id."""
    return _c(c) + (_uniform(row_id, seed, 0) - F.lit(0.5)) * F.lit(width)
