"""Vector functions on ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str, eps: float = 1e-9) -> Column:
    """Divided by the length, or by `eps` where the length is less."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column | str, b: Column | str, eps: float = 1e-9) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def usable(v: Column | str, dim: int | None = None) -> Column:
    """A vector of the right length, without null, NaN or infinite parts, and not all zero; never null itself."""
    bad = F.exists(col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(col(v), lambda x: x != 0)
    fits = F.size(col(v)) > 0 if dim is None else F.size(col(v)) == dim
    return F.coalesce(col(v).isNotNull() & fits & ~bad & some, F.lit(False))


def affine01(c: Column | str) -> Column:
    """A cosine as a score from 0 to 1."""
    return (col(c) + 1.0) / 2.0


def mos01(c: Column | str) -> Column:
    """A raw rating score mapped to 0..1 and clamped; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest((col(c) * 5.0 + 5.0) / 10.0, F.lit(0.0)), F.lit(1.0)))


def pad(v: Column | str, n: int) -> Column:
    """Right-padded with zeros to `n`, or its first `n` parts."""
    d = doubles(v)
    return F.slice(F.concat(d, F.array_repeat(F.lit(0.0), n)), 1, n)


def centre_crop(v: Column | str, n: int) -> Column:
    """The middle `n` parts; shorter ones get zeros on either side."""
    d = doubles(v)
    size = F.size(d)
    left = F.greatest(F.floor((F.lit(n) - size) / 2), F.lit(0)).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), left), d, F.array_repeat(F.lit(0.0), n))
    start = F.greatest(F.floor((size - F.lit(n)) / 2), F.lit(0)).cast("int") + 1
    return F.slice(padded, start, n)
