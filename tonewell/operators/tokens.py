"""Operators on token matrices (ARRAY<ARRAY<DOUBLE>>) for late interaction, as array expressions in the JVM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.vectors import dot, norm, unit


@dataclass(frozen=True)
class Reduction:
    """How tokens are thinned before scoring."""

    pool: int = 1
    stride: int = 1
    keep: float = 1.0


#: Score of a masked document token.
FAR = -1e4
#: Presets from exact to fast.
PRESETS = {"baseline": Reduction(), "moderate": Reduction(2, 2, 0.8), "fast": Reduction(3, 2, 0.7)}


def trim(tokens: Column | str, prefix: int = 0, most: int | None = None) -> Column:
    """Without the first `prefix` tokens, at most `most` of the rest."""
    t = col(tokens)
    return F.slice(t, prefix + 1, F.greatest(F.size(t), F.lit(1)) if most is None else F.lit(most))


def prefix_length(tokens: int | Column, prefix: Column | str, text: Column | str) -> Column:
    """How many of `tokens` a prefix takes, by its share of the characters."""
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    both = F.length(F.concat(col(prefix), col(text)))
    return F.floor(n * F.length(col(prefix)) / F.greatest(both, F.lit(1))).cast("int")


def masked(tokens: Column | str, mask: Column | str | None = None, least: float = 1e-6) -> Column:
    """Tokens whose mask is positive and whose length is above `least`, made unit length."""
    t = col(tokens)
    if mask is not None:
        pairs = F.arrays_zip(t.alias("t"), col(mask).alias("m"))
        t = F.transform(F.filter(pairs, lambda p: p["m"] > 0), lambda p: p["t"])
    return F.transform(F.filter(t, lambda v: norm(v) > least), lambda v: unit(v, least))


def pool(tokens: Column | str, factor: int | Column, how: str = "mean") -> Column:
    """Windows of `factor` tokens as their mean or maximum; the last may be short. The factor may differ by row."""
    t = col(tokens)
    if isinstance(factor, int) and factor <= 1:
        return t
    f = F.lit(factor) if isinstance(factor, int) else factor.cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), lambda i: (i % f == 0) & (i < F.size(t)))

    def window(i: Column) -> Column:
        part = F.slice(t, i + 1, f)
        dims = F.sequence(F.lit(0), F.size(part[0]) - 1)
        if how == "max":
            return F.transform(dims, lambda d: F.array_max(F.transform(part, lambda v: v[d])))
        return F.transform(dims, lambda d: F.aggregate(part, F.lit(0.0), lambda s, v: s + v[d]) / F.size(part))

    made = F.transform(starts, window)
    return made if isinstance(factor, int) else F.when(f <= 1, t).otherwise(made)


def stride(tokens: Column | str, step: int | Column, offset: int = 0) -> Column:
    """Every `step`-th token from `offset` on. The step may differ by row."""
    return F.filter(col(tokens), lambda x, i: (i >= offset) & ((i - offset) % step == 0))


def importance(v: Column, how: str) -> Column:
    if how == "norm":
        return norm(v)
    if how == "random":
        return F.pmod(F.xxhash64(v), F.lit(1 << 20)).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)


def prune(tokens: Column | str, keep: float, how: str = "variance", digits: int = 12) -> Column:
    """The max(1, int(n * keep)) most important tokens in their own order; equal ones, at `digits`, by place.

    `how` is variance, norm, or random, which draws by a hash of the token.
    """
    t = col(tokens)
    count = F.greatest(F.lit(1), F.floor(F.size(t) * keep + 1e-9).cast("int"))
    scored = F.transform(t, lambda v, i: F.struct((-F.round(importance(v, how), digits)).alias("s"), i.alias("i"), v.alias("v")))
    top = F.slice(F.array_sort(scored), 1, count)
    return F.transform(F.array_sort(F.transform(top, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def reduce_tokens(tokens: Column | str, r: Reduction, query: bool) -> Column:
    """Stride (documents only), pool, and pruning (queries only), in that order."""
    t = col(tokens)
    if r.stride > 1 and not query:
        t = stride(t, r.stride)
    t = pool(t, r.pool)
    return prune(t, r.keep) if query and r.keep < 1 else t


def adaptive(tokens: Column | str, target: int, how: str = "pool") -> Column:
    """Thinned towards `target` tokens, never below; those with no more stay as they are.

    `pool` takes windows of, and `stride` every, (n // target)-th token. `hybrid` pools in windows of ceil(n / target) up to
    twice the target, and above takes every second token and pools the rest.
    """
    t = col(tokens)
    n = F.size(t)
    by = F.greatest(F.floor(n / target), F.lit(1)).cast("int")
    if how == "pool":
        made = pool(t, by)
    elif how == "stride":
        made = stride(t, by)
    elif how == "hybrid":
        half = stride(t, 2)
        rest = F.greatest(F.floor(F.size(half) / target), F.lit(1)).cast("int")
        made = F.when(n <= 2 * target, pool(t, F.ceil(n / target).cast("int"))).otherwise(pool(half, rest))
    else:
        raise ValueError(how)
    return F.when(n <= target, t).otherwise(made)


def maxsim(query: Column | str, document: Column | str, reduce: str = "mean") -> Column:
    """For every query token the best document token, then their mean, sum or maximum; -inf if either is empty."""
    q, d = col(query), col(document)
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: dot(a, b))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    value = {"mean": total / F.greatest(F.size(q), F.lit(1)), "sum": total, "max": F.array_max(best)}[reduce]
    return F.when((F.size(q) > 0) & (F.size(d) > 0), value).otherwise(F.lit(float("-inf")))


def maxsim_masked(query: Column | str, document: Column | str, query_mask: Column | str | None = None, document_mask: Column | str | None = None) -> Column:
    """MaxSim of unit tokens with masks, as a batch of training pairs scores it.

    A masked document token scores FAR; masked query tokens do not count in the mean, whose denominator is 1 at least. What
    is not finite gives 0.
    """
    q, d = col(query), col(document)
    dm = None if document_mask is None else col(document_mask)

    def against(a: Column) -> Column:
        return F.array_max(F.transform(d, lambda b, j: dot(a, b) if dm is None else F.when(dm[j] > 0, dot(a, b)).otherwise(F.lit(FAR))))

    best = F.transform(q, against)
    if query_mask is None:
        value = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q)
    else:
        m = F.transform(col(query_mask), lambda x: x.cast("double"))
        value = F.aggregate(F.zip_with(best, m, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite & (F.size(q) > 0) & (F.size(d) > 0), value).otherwise(F.lit(0.0))


def prepared(tokens: Column | str, r: Reduction, query: bool, prefix: int = 0, most: int | None = None, mask: Column | str | None = None, transform=None) -> Column:
    """Tokens as late interaction scores them, in the one order that counts.

    Prefix dropped, trimmed, projected by `transform` (a function of a token column), every so many taken (documents), pooled,
    masked and made unit length, pruned (queries).
    """
    t = trim(tokens, prefix, most)
    if transform is not None:
        t = F.transform(t, transform)
    if r.stride > 1 and not query:
        t = stride(t, r.stride)
    t = masked(pool(t, r.pool), mask)
    return prune(t, r.keep) if query and r.keep < 1 else t


def speedup(query_tokens: int, document_tokens: int, r: Reduction) -> float:
    """Ratio of token pairs before and after a reduction."""
    queries = int(math.ceil(query_tokens / r.pool) * r.keep)
    documents = math.ceil(document_tokens / (r.pool * r.stride))
    return query_tokens * document_tokens / max(1, queries * documents)
