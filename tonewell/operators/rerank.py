"""Second-stage reranking: candidate limits, pointwise and listwise orders, blends, ranks after reranking.

Rerankers by configuration are made in `rerankers`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def limit_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The first k candidates by pos; k of 0 or less keeps all."""
    return candidates if k <= 0 else candidates.where(F.col("pos") <= k)


def minmax(c: Column | str, by: str) -> Column:
    """Scaled to 0..1 within each query; 0 where the range is below 1e-8."""
    w = Window.partitionBy(by)
    low, high = F.min(col(c)).over(w), F.max(col(c)).over(w)
    return F.when(high - low < 1e-8, F.lit(0.0)).otherwise((col(c) - low) / F.greatest(high - low, F.lit(1e-8)))


def blend(initial: Column | str, new: Column | str, weight: float) -> Column:
    """(1 - weight) initial + weight new for weights from 0 to 1, else new alone."""
    if not 0.0 <= weight <= 1.0:
        return col(new)
    return (1.0 - weight) * col(initial) + weight * col(new)


def blend_normalised(initial: Column | str, denoised: Column | str, contrastive: Column | str, weights: tuple[float, float], weight: float, by: str) -> Column:
    """A score without a scale and a cosine, brought to 0..1, weighted, and blended with the initial cosine.

    The first is scaled within its query and left out where its range there is below 1e-8; cosines are mapped
    affinely. Weights are shared out to sum 1. The initial score takes part only for a weight strictly between 0
    and 1.
    """
    total = max(sum(weights), 1e-8)
    window = Window.partitionBy(by)
    flat = F.max(col(denoised)).over(window) - F.min(col(denoised)).over(window) < 1e-8
    cosine = (col(contrastive) + 1.0) / 2.0
    both = F.lit(weights[0] / total) * minmax(denoised, by) + F.lit(weights[1] / total) * cosine
    combined = F.when(flat, cosine).otherwise(both)
    if not 0.0 < weight < 1.0:
        return combined
    return F.lit(1.0 - weight) * (col(initial) + 1.0) / 2.0 + F.lit(weight) * combined


def reordered(candidates: DataFrame, score: str, query: str = "q") -> DataFrame:
    """With new_pos: by `score` descending, equal scores in their original order (pos)."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc("pos"))
    return candidates.withColumn("new_pos", F.row_number().over(order))


def from_listing(candidates: DataFrame, orders: DataFrame, query: str = "q") -> DataFrame:
    """With new_pos from a listwise answer: `orders` has `query` and order, zero-based positions in the candidates.

    What an order lacks follows in the original order; a query without an order keeps its own.
    """
    placed = orders.select(query, F.posexplode("order").alias("_at", "_zero")).select(query, (F.col("_zero") + 1).alias("pos"), "_at")
    order = Window.partitionBy(query).orderBy(F.coalesce("_at", F.lit(1 << 30)), "pos")
    return candidates.join(placed, [query, "pos"], "left").withColumn("new_pos", F.row_number().over(order)).drop("_at")


def rank_after(candidates: DataFrame, targets: DataFrame, query: str = "q") -> DataFrame:
    """`query`, baseline_rank, reranked_rank, skipped: the target's new place in the list.

    `targets` has `query`, d and baseline_rank. A target that is no candidate keeps its baseline rank; a query
    without candidates is skipped.
    """
    placed = candidates.select(query, "d", "new_pos")
    some = candidates.groupBy(query).agg(F.count("*").alias("_n"))
    return (
        targets.join(placed, [query, "d"], "left").join(some, query, "left")
        .select(query, "baseline_rank", F.coalesce(F.col("new_pos").cast("bigint"), F.col("baseline_rank").cast("bigint")).alias("reranked_rank"), F.col("_n").isNull().alias("skipped"))
    )


def summary(runs: DataFrame, mode: str, latency: str, hit: str, *by: str) -> DataFrame:
    """calls, total and mean latency, hits and hit rate (per value of `by`)."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("calls"), F.round(F.sum(latency), 6).alias("total_latency"), F.round(F.avg(latency), 6).alias("avg_latency"),
        F.sum(F.col(hit).cast("bigint")).alias("hits"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("hit_rate"),
    )


def hash_score(*parts: Column) -> Column:
    """A score in [0, 1) that only depends on the texts: the first 8 bytes of md5, little-endian."""
    digest = F.md5(F.concat_ws("||", *parts).cast("binary"))
    # bytes in reverse order make it the big-endian number that conv reads
    flipped = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    high, low = F.conv(F.substring(flipped, 1, 8), 16, 10).cast("double"), F.conv(F.substring(flipped, 9, 8), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0


Reranker = Callable[[DataFrame], DataFrame]


def denoised_scores(candidates: DataFrame, vectors: str, query: str, denoiser: Callable[[], Callable], alphas: list[float], steps: int, seed: int = 0) -> DataFrame:
    """q, d, denoised: scores of a query's candidates drawn out of noise by a denoiser, in steps that skip through the schedule.

    `candidates` has q, d, `query` and `vectors` (vectors of the query and of the candidate; rows without either fall out).
    `denoiser()` is called once a task and gives a function of (query vector, candidate matrix, noisy scores, step) that predicts
    clean scores. `alphas` are the running products of the schedule. The noise of a row comes from its seed, q and d alone, so
    runs agree on any cluster. A query's candidates meet in one group, which is as long as the first stage's limit.
    """
    import numpy as np
    import pandas as pd

    every = max(1, len(alphas) // max(1, steps))
    times = list(range(0, len(alphas), every))[::-1]
    noise = F.sqrt(-2.0 * F.log(F.greatest(hash_score(F.lit(f"{seed}/u"), F.col("q").cast("string"), F.col("d").cast("string")), F.lit(1e-12)))) * F.cos(
        2 * math.pi * hash_score(F.lit(f"{seed}/v"), F.col("q").cast("string"), F.col("d").cast("string"))
    )
    rows = candidates.where(F.col(query).isNotNull() & F.col(vectors).isNotNull()).select("q", "d", F.col(query).alias("_a"), F.col(vectors).alias("_b"), noise.alias("_x"))

    def sample(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("d")
        predict = denoiser()
        a, b, x = np.asarray(group["_a"].iloc[0], np.float64), np.stack(group["_b"].to_list()).astype(np.float64), group["_x"].to_numpy(np.float64)
        for t, after in zip(times, [*times[1:], None]):
            clean = np.asarray(predict(a, b, x, t), np.float64)
            if after is None:
                x = clean
            else:
                rest = (x - math.sqrt(alphas[t]) * clean) / math.sqrt(1 - alphas[t] + 1e-8)
                x = math.sqrt(alphas[after]) * clean + math.sqrt(1 - alphas[after]) * rest
        return pd.DataFrame({"q": group["q"], "d": group["d"], "denoised": x})

    return rows.groupBy("q").applyInPandas(sample, "q long, d long, denoised double")
