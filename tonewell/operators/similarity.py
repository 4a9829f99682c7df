"""Dense similarity of a query set against a gallery, in cells, reduced before anything leaves a cell.

Both sides fall into groups of a bounded number of rows, and every query group meets every gallery group in one cell of
a grid, so a side is copied once for each group of the other and the work spreads over all executors even if one side
is small. In a cell, slices of the queries are multiplied with the gallery; only counts, a top k, a histogram or a
log-sum-exp leave it, never the pairs. Scores are doubles, rounded to `DIGITS`, so equal vectors tie the same way everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

DIGITS = 12
#: Rows of a query group and of a gallery group at most, about, and the queries that are multiplied at once.
QUERY_GROUP = 4_096
GALLERY_GROUP = 8_192
SLICE = 256
#: Queries of a group at least, below which more cells are not worth their copies.
LEAST_GROUP = 64


def _groups(queries: DataFrame, gallery: DataFrame) -> tuple[int, int]:
    """How many groups either side falls into; both are counted in one job."""
    sizes = dict(queries.agg(F.lit("q").alias("s"), F.count("*").alias("n")).unionAll(gallery.agg(F.lit("g").alias("s"), F.count("*").alias("n"))).collect())
    nq, ng = max(1, math.ceil(sizes["q"] / QUERY_GROUP)), max(1, math.ceil(sizes["g"] / GALLERY_GROUP))
    wanted = queries.sparkSession.sparkContext.defaultParallelism
    while nq * ng < wanted and sizes["q"] / nq > 2 * LEAST_GROUP:
        nq *= 2
    return nq, ng


def _cells(
    queries: DataFrame, gallery: DataFrame, fn: Callable[[dict, np.ndarray], pd.DataFrame], schema: str, q_extra: tuple[str, ...] = (), g_extra: tuple[str, ...] = (), q_by: str = "id", g_by: str = "id"
) -> DataFrame:
    """What `fn` makes of every cell: its columns as q_... and g_... and the scores. Rows of one `q_by` (`g_by`) stay together.

    Rows without a vector take no part.
    """
    nq, ng = _groups(queries, gallery)

    def side(df: DataFrame, by: str, extra: tuple[str, ...], own: str, n: int, other: str, m: int) -> DataFrame:
        # new names for all columns, as both sides may come from one table
        kept = df.select(F.col("id").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *[F.col(c).alias(c) for c in extra]).where(F.col("vec").isNotNull())
        # cut by hash, so that no counter runs over all rows
        mine = kept.withColumn(own, F.pmod(F.xxhash64(F.lit(9), by), F.lit(n)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q = side(queries, q_by, q_extra, "_q", nq, "_g", ng)
    g = side(gallery, g_by, g_extra, "_g", ng, "_q", nq)
    step = SLICE if q_by == "id" else QUERY_GROUP
    digits = DIGITS

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        x, y = np.stack(left["vec"].to_list()), np.stack(right["vec"].to_list())
        fixed = {"g_id": right["id"].to_numpy(), **{f"g_{c}": right[c].to_numpy() for c in g_extra}}
        made = []
        for start in range(0, len(left), step):
            part = left.iloc[start : start + step]
            row = fixed | {"q_id": part["id"].to_numpy(), **{f"q_{c}": part[c].to_numpy() for c in q_extra}}
            made.append(fn(row, np.round(x[start : start + step] @ y.T, digits)))
        return pd.concat(made, ignore_index=True)

    return q.groupBy("_q", "_g").cogroup(g.groupBy("_q", "_g")).applyInPandas(meet, schema)


def _floor(values: list) -> np.ndarray:
    """Scores as an array; null and NaN stand below every score."""
    return np.round(np.array([-np.inf if b is None or b != b else b for b in values], np.float64), DIGITS)


def count_above(queries: DataFrame, gallery: DataFrame, argsort: bool = False) -> DataFrame:
    """id, above: how many gallery rows score higher than `best` with each query.

    `queries` has id, vec, best and skip (a gallery id that does not count, or null); `gallery` has id and vec, ids
    BIGINT. A null `best` stands below every score. With `argsort`, rows that score the same and have a smaller id
    than the query's `truth` count too.
    """
    columns = ["id", "vec", F.col("best").cast("double").alias("best"), F.col("skip").cast("bigint").alias("skip")]
    extra = ("best", "skip", "truth") if argsort else ("best", "skip")

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        best = _floor(row["q_best"])[:, None]
        above = s > best
        if argsort:
            above |= (s == best) & (np.asarray(row["g_id"], np.int64)[None, :] < np.asarray(row["q_truth"], np.int64)[:, None])
        n = above.sum(1)
        place = {v: j for j, v in enumerate(row["g_id"])}
        for i, x in enumerate(row["q_skip"]):
            if x is not None and x == x and int(x) in place and above[i, place[int(x)]]:
                n[i] -= 1
        return pd.DataFrame({"id": np.asarray(row["q_id"], np.int64), "n": n.astype(np.int64)})

    asked = queries.select(*columns, *(["truth"] if argsort else []))
    parts = _cells(asked, gallery.select("id", "vec"), fn, "id long, n long", extra)
    return parts.groupBy("id").agg(F.sum("n").alias("above"))


def count_clips_above(queries: DataFrame, captions: DataFrame) -> DataFrame:
    """id, above: how many clips have a caption that scores higher than `best` with each query.

    `queries` has id, vec, best and skip (a caption that does not count, or null); `captions` has id, clip and vec. A
    clip lies in one group whole, so clips are counted where they are scored.
    """

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        ids, clips = np.asarray(row["g_id"], np.int64), np.asarray(row["g_clip"], np.int64)
        place = {v: j for j, v in enumerate(ids.tolist())}
        for i, x in enumerate(row["q_skip"]):
            if x is not None and x == x and int(x) in place:
                s[i, place[int(x)]] = -np.inf
        order = np.argsort(clips, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(clips[order]) != 0])
        top = np.maximum.reduceat(s[:, order], first, axis=1)
        return pd.DataFrame({"id": np.asarray(row["q_id"], np.int64), "n": (top > _floor(row["q_best"])[:, None]).sum(1).astype(np.int64)})

    asked = queries.select("id", "vec", F.col("best").cast("double").alias("best"), F.col("skip").cast("bigint").alias("skip"))
    parts = _cells(asked, captions.select("id", "clip", "vec"), fn, "id long, n long", ("best", "skip"), ("clip",), g_by="clip")
    return parts.groupBy("id").agg(F.sum("n").alias("above"))


def count_above_pooled(captions: DataFrame, items: DataFrame) -> DataFrame:
    """clip, above: how many items score higher than `best` with a clip, whose score is that of its best caption.

    `captions` has id, clip, vec and best (the same for all captions of a clip); `items` has id and vec.
    """

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        clips = np.asarray(row["q_clip"], np.int64)
        order = np.argsort(clips, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(clips[order]) != 0])
        top = np.maximum.reduceat(s[order], first, axis=0)
        best = _floor(row["q_best"])[order][first]
        return pd.DataFrame({"clip": clips[order][first], "n": (top > best[:, None]).sum(1).astype(np.int64)})

    parts = _cells(captions.select("id", "clip", "vec", "best"), items.select("id", "vec"), fn, "clip long, n long", ("clip", "best"), q_by="clip")
    return parts.groupBy("clip").agg(F.sum("n").alias("above"))


def log_sum_exp(queries: DataFrame, gallery: DataFrame, temperature: float, masked: DataFrame | None = None) -> DataFrame:
    """id, lse: log of the summed exponentials of score / temperature over the gallery, merged from cells by their maxima.

    `masked` names pairs a (query), b (gallery row) that do not count.
    """
    some = masked is not None

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        z = s / temperature
        if some:
            place = {v: j for j, v in enumerate(row["g_id"])}
            for i, names in enumerate(row["q_mask"]):
                z[i, [place[v] for v in names if v in place] if names is not None else []] = -np.inf
        m = z.max(1)
        low = np.where(np.isfinite(m), m, 0.0)
        return pd.DataFrame({"id": np.asarray(row["q_id"], np.int64), "m": m, "e": np.exp(z - low[:, None]).sum(1)})

    asked, extra = queries.select("id", "vec"), ()
    if some:
        asked, extra = asked.join(masked.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("mask")), "id", "left"), ("mask",)
    parts = _cells(asked, gallery.select("id", "vec"), fn, "id long, m double, e double", extra).where(F.col("m") > float("-inf"))
    items = parts.groupBy("id").agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "e")).alias("p"))  # one entry per gallery group
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["e"] * F.exp(x["m"] - F.col("top")))
    return items.select("id", (F.col("top") + F.log(total)).alias("lse"))


#: Bins of the scores from -1 to 1 that find where the hardest negatives end.
BINS = 2_048


def hardest_softplus(queries: DataFrame, gallery: DataFrame, temperature: float, share: float | None, least: int) -> DataFrame:
    """id, neg: mean softplus of score / temperature over the hardest negatives of each query, rows of other ids than its own.

    The highest `share` of them count, and at least `least`; all do without a share. Cells give histograms with the
    softplus sum of each bin; only scores of the one bin in which the hardest end are looked at singly.
    """
    bins = BINS

    def binned(s: np.ndarray) -> np.ndarray:
        return np.clip(((s + 1.0) * (bins / 2)).astype(np.int64), 0, bins - 1)

    def negatives(row: dict) -> np.ndarray:
        return np.asarray(row["q_id"], np.int64)[:, None] != np.asarray(row["g_id"], np.int64)[None, :]

    def histogram(row: dict, s: np.ndarray) -> pd.DataFrame:
        ok = negatives(row)
        r, _ = np.nonzero(ok)
        z, at = s[ok] / temperature, r * bins + binned(s[ok])
        n = np.bincount(at, minlength=len(s) * bins)
        total = np.bincount(at, np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))), minlength=len(s) * bins)
        there = np.flatnonzero(n)
        return pd.DataFrame({"id": np.asarray(row["q_id"], np.int64)[there // bins], "bin": (there % bins).astype(np.int32), "n": n[there], "total": total[there]})

    q, g = queries.select("id", "vec"), gallery.select("id", "vec")
    counted = _cells(q, g, histogram, "id long, bin int, n long, total double").groupBy("id", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    down = Window.partitionBy("id").orderBy(F.desc("bin"))
    size = F.sum("n").over(Window.partitionBy("id"))
    wanted = size if share is None else F.least(size, F.greatest(F.floor(size * share), F.lit(least)))
    above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("id", "bin", "n", "total", wanted.cast("long").alias("k"), above.alias("above"))
    needed = written(placed.where(F.col("above") < F.col("k")))
    whole = needed.groupBy("id", "k").agg(F.coalesce(F.sum(F.when(F.col("above") + F.col("n") <= F.col("k"), F.col("total"))), F.lit(0.0)).alias("whole"))
    border = needed.where(F.col("above") + F.col("n") > F.col("k")).select("id", "bin", (F.col("k") - F.col("above")).alias("rest"))

    def inside(row: dict, s: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(negatives(row) & (binned(s) == np.asarray(row["q_bin"])[:, None]))
        return pd.DataFrame({"id": np.asarray(row["q_id"], np.int64)[r], "z": s[r, c] / temperature})

    values = _cells(q.join(border.select("id", "bin"), "id"), g, inside, "id long, z double", ("bin",))
    hardest = Window.partitionBy("id").orderBy(F.desc("z"))
    ranked = values.withColumn("r", F.row_number().over(hardest)).join(border.select("id", "rest"), "id").where("r <= rest")
    softplus = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
    part = ranked.groupBy("id").agg(F.sum(softplus).alias("part"))
    return whole.join(part, "id", "left").select("id", ((F.col("whole") + F.coalesce("part", F.lit(0.0))) / F.col("k")).alias("neg"))


def top_clips(queries: DataFrame, captions: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """id, clip, score, pos: the k clips that a ranking of all captions meets first; equal scores by smaller caption id.

    `exclude_self` leaves out the caption with the query's own id.

    Each cell gives its k best clips a query, whatever the sizes of clips are, and a clip may lie in several cells: where its
    best caption lies, at most k - 1 clips stand before one of the k best.
    """

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        q, g, clips = np.asarray(row["q_id"], np.int64), np.asarray(row["g_id"], np.int64), np.asarray(row["g_clip"], np.int64)
        if exclude_self:
            s = np.where(q[:, None] == g[None, :], -np.inf, s)
        by = np.lexsort((g, clips))
        first = np.flatnonzero(np.r_[True, np.diff(clips[by]) != 0])
        best = np.maximum.reduceat(s[:, by], first, axis=1)
        # the smallest id among the best captions of each clip
        hit = s[:, by] == np.repeat(best, np.diff(np.r_[first, len(by)]), axis=1)
        ids = np.minimum.reduceat(np.where(hit, g[by][None, :], np.iinfo(np.int64).max), first, axis=1)
        m = min(k, len(first))
        order = np.lexsort((ids, -best), axis=1)[:, :m]
        named = np.take_along_axis(ids, order, 1).ravel()
        made = pd.DataFrame({"id": np.repeat(q, m), "clip": clips[by][first][order].ravel(), "score": np.take_along_axis(best, order, 1).ravel(), "caption": named})
        return made[made["score"] > -np.inf]

    found = _cells(queries.select("id", "vec"), captions.select("id", "clip", "vec"), fn, "id long, clip long, score double, caption long", (), ("clip",))
    best = F.max(F.struct("score", (-F.col("caption")).alias("_c")))
    parts = found.groupBy("id", "clip").agg(best.alias("b")).select("id", "clip", "b.score", (-F.col("b._c")).alias("caption"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("caption"))
    return parts.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("id", "clip", "score", "pos")


def top_k(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """id, other, score, pos (from 1): the k best gallery rows of each query, equal scores by smaller gallery id.

    k of 0 or less gives all, for small sets. `exclude_self` leaves out the gallery row with the query's own id.
    """

    def fn(row: dict, s: np.ndarray) -> pd.DataFrame:
        q, g = np.asarray(row["q_id"], np.int64), np.asarray(row["g_id"], np.int64)
        by_id = np.argsort(g, kind="stable")
        g, s = g[by_id], s[:, by_id]
        if exclude_self:
            s = np.where(q[:, None] == g[None, :], -np.inf, s)
        m = len(g) if k <= 0 else min(k, len(g))
        order = np.argsort(-s, axis=1, kind="stable")[:, :m]
        value = np.take_along_axis(s, order, 1)
        made = pd.DataFrame({"id": np.repeat(q, m), "other": g[order].ravel(), "score": value.ravel()})
        return made[made["score"] > -np.inf]

    parts = _cells(queries.select("id", "vec"), gallery.select("id", "vec"), fn, "id long, other long, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other"))
    ranked = parts.withColumn("pos", F.row_number().over(order))
    return ranked if k <= 0 else ranked.where(F.col("pos") <= k)


def best_of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """`by`, best: the highest score of the named pairs (a, b) for each value of `by`."""
    from ..functions.vectors import dot

    x = left.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    y = right.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(x, "a").join(y, "b").groupBy(by).agg(F.max(F.round(dot("va", "vb"), DIGITS)).alias("best"))
