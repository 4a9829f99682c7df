"""Retrieval metrics as aggregates of a rank column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

KS = (1, 5, 10)
METRICS = tuple(f"r_at_{k}" for k in KS) + ("mrr", "dcg")


def recall_at(rank: Column | str, k: int) -> Column:
    """Percent of ranks up to k."""
    return F.avg(F.when(col(rank) <= k, F.lit(100.0)).otherwise(F.lit(0.0)))


def mrr(rank: Column | str) -> Column:
    """Mean reciprocal rank, not cut at any k."""
    return F.avg(F.lit(1.0) / col(rank))


def dcg(rank: Column | str) -> Column:
    """Mean of 1 / log2(rank + 1): gain of the one relevant item."""
    return F.avg(F.lit(1.0) / F.log2(col(rank) + F.lit(1.0)))


def all_metrics(ranks: DataFrame, *by: str, ks: Sequence[int] = KS, rank: str = "rank", digits: int = 6, empty: float | str | None = None, sums: Sequence[int] | None = None) -> DataFrame:
    """One row (per value of `by`): n, recalls, mrr, dcg and rsum, rounded.

    Without ranks the values are `empty`: null, 0.0 for callers that report zeros, or `skip` for no row at all. rsum adds
    the recalls of `sums`, by default all; one that is not among `ks` adds 0.
    """
    made = {f"r_at_{k}": recall_at(rank, k) for k in ks} | {"mrr": mrr(rank), "dcg": dcg(rank)}
    out = ranks.groupBy(*by).agg(F.count(rank).alias("n"), *[m.alias(k) for k, m in made.items()])
    added = [k for k in (ks if sums is None else sums) if k in ks]
    zero = F.when(F.col("n") > 0, F.lit(0.0))
    out = out.withColumn("rsum", sum((F.col(f"r_at_{k}") for k in added[1:]), F.col(f"r_at_{added[0]}")) if added else zero)
    if empty == "skip":
        out, empty = out.where("n > 0"), None
    names = [*made, "rsum"]
    fill = (lambda c: F.coalesce(c, F.lit(empty))) if empty is not None else (lambda c: c)
    return out.select(*by, "n", *[F.round(fill(F.col(c)), digits).alias(c) for c in names])


def macro_average(per_group: DataFrame, by: str, label: str = "Average") -> DataFrame:
    """The groups' rows and one row of unweighted means over them; not the pooled metrics."""
    values = [c for c in per_group.columns if c not in (by, "n")]
    mean = per_group.agg(F.sum("n").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in values]).select(F.lit(label).alias(by), "n", *values)
    return per_group.select(by, "n", *values).unionByName(mean)


def rank_gain(ranks: DataFrame, before: str, after: str) -> DataFrame:
    """Mean of `before` - `after` as avg_gain."""
    return ranks.agg(F.round(F.avg(F.col(before) - F.col(after)), 6).alias("avg_gain"))


def tidy(metrics: DataFrame, *by: str) -> DataFrame:
    """`by`, metric, value: one row per metric."""
    names = [c for c in metrics.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def report_line(precision: int = 2) -> Column:
    """The metrics of a row as one line of text."""
    parts = [F.format_string(f"R@{k}=%.{precision}f%%", F.col(f"r_at_{k}")) for k in KS]
    parts += [F.format_string(f"{name}=%.{precision + 2}f", F.col(c)) for name, c in (("MRR", "mrr"), ("DCG", "dcg"))]
    return F.concat_ws(" | ", *parts)


def cross_entropy(queries: DataFrame, gallery: DataFrame, truth: DataFrame, temperature: float = 0.07, masked: DataFrame | None = None) -> DataFrame:
    """loss: mean softmax cross entropy of the true row (pairs a, b) over the whole gallery, without the `masked` pairs (a, b)."""
    from .similarity import best_of_pairs, log_sum_exp

    best = best_of_pairs(truth.select("a", "b"), queries, gallery, "a").withColumnRenamed("a", "id")
    asked = queries.join(best.select("id"), "id", "left_semi")
    return log_sum_exp(asked, gallery, temperature, masked).join(best, "id").agg(F.round(F.avg(F.col("lse") - F.col("best") / temperature), 6).alias("loss"))


def info_nce(a: DataFrame, b: DataFrame, temperature: float = 0.07, symmetric: bool = True, blacklist: DataFrame | None = None) -> DataFrame:
    """loss of a batch whose rows of equal id are positives, from one side or as the mean of both.

    `blacklist` holds unordered pairs a, b of ids that are no negatives of each other; a positive always counts.
    """
    truth = a.select(F.col("id").alias("a"), F.col("id").alias("b"))
    masked = None if blacklist is None else blacklist.select("a", "b").unionAll(blacklist.select("b", "a")).where("a <> b").distinct()
    one = cross_entropy(a, b, truth, temperature, masked)
    if not symmetric:
        return one
    return one.unionAll(cross_entropy(b, a, truth, temperature, masked)).agg(F.round(F.avg("loss"), 6).alias("loss"))


def slap(pairs: DataFrame, weight: float = 0.5) -> DataFrame:
    """inter, intra, total: balanced cosine losses of rows with q_text, q_audio, z_audio and z_text."""
    from ..functions.vectors import cosine

    def away(x: str, y: str) -> Column:
        return F.lit(1.0) - F.avg(cosine(x, y))

    inter = 0.5 * (away("q_audio", "z_text") + away("q_text", "z_audio"))
    intra = 0.5 * (away("q_audio", "z_audio") + away("q_text", "z_text"))
    return pairs.agg(F.round(inter, 6).alias("inter"), F.round(intra, 6).alias("intra"), F.round(weight * inter + (1 - weight) * intra, 6).alias("total"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic_softplus(a: DataFrame, b: DataFrame, temperature: float = 0.07, hardest: float | None = None, least: int = 10) -> DataFrame:
    """loss of a batch whose rows of equal id are positives: softplus of the negated positive plus the mean softplus of negatives.

    With `hardest`, only that share of the negatives counts, the highest ones, and at least `least` of them.
    """
    from .similarity import best_of_pairs, hardest_softplus

    own = best_of_pairs(a.select(F.col("id").alias("a"), F.col("id").alias("b")), a, b, "a").withColumnRenamed("a", "id")
    per = hardest_softplus(a, b, temperature, hardest, least)
    return own.join(per, "id").agg(F.round(F.avg(softplus(-F.col("best") / temperature) + F.col("neg")), 6).alias("loss"))
