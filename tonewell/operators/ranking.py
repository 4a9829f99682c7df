"""Rank of the ground truth in retrieval tasks.

A rank is 1 + the number of candidates that score higher: ties are optimistic. With several positives the best
rank counts, and that is the rank of the positive with the highest score, so one threshold per query is enough.
Vector tables have id (BIGINT), clip and vec; vectors are unit length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import DIGITS, best_of_pairs, count_above, count_above_pooled, count_clips_above


def ranks(queries: DataFrame, gallery: DataFrame, truth: DataFrame, skip: Column | None = None) -> DataFrame:
    """id, rank of each query that has a positive; `truth` holds pairs a (query) and b (gallery row).

    `skip`, on `queries`, names a gallery row that is no candidate unless it is a positive. Queries whose truth is
    not in the gallery are left out.
    """
    best = best_of_pairs(truth.select("a", "b"), queries, gallery, "a").withColumnRenamed("a", "id")
    asked = queries.select("id", "vec", (skip if skip is not None else F.lit(None).cast("bigint")).alias("skip")).join(best, "id")
    return count_above(asked, gallery.select("id", "vec")).select("id", (F.col("above") + 1).alias("rank"))


def own_clip(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """a, b: query and gallery rows of one clip."""
    return queries.select(F.col("id").alias("a"), "clip").join(gallery.select(F.col("id").alias("b"), "clip"), "clip").select("a", "b")


def text_to_item(captions: DataFrame, items: DataFrame) -> DataFrame:
    """Rank of each caption's own item among all items."""
    return ranks(captions, items, own_clip(captions, items))


def item_to_text(items: DataFrame, captions: DataFrame) -> DataFrame:
    """Best rank of an item's own captions among all captions."""
    return ranks(items, captions, own_clip(items, captions))


def text_to_text(captions: DataFrame) -> DataFrame:
    """Best rank of a caption's sisters among all other captions; captions without sisters are left out."""
    return ranks(captions, captions, own_clip(captions, captions).where("a <> b"), skip=F.col("id"))


def centroids(captions: DataFrame) -> DataFrame:
    """id (the clip), clip, vec: the mean of a clip's vectors, not made unit length again."""
    parts = captions.select("clip", F.posexplode(F.col("vec").cast("array<double>")).alias("at", "x")).groupBy("clip", "at").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return parts.groupBy("clip").agg(vec.alias("vec")).select(F.col("clip").alias("id"), "clip", "vec")


def pooled_average(queries: DataFrame, captions: DataFrame) -> DataFrame:
    """Rank of the query's clip when a clip is the mean of its captions."""
    bank = centroids(captions)
    return ranks(queries, bank, own_clip(queries, bank))


def pooled_best(queries: DataFrame, captions: DataFrame, leave_out_self: bool = False) -> DataFrame:
    """Rank of the query's clip when a clip scores as its best caption.

    With `leave_out_self` a query that is a caption is no candidate of its own clip; a clip without any other caption
    then ranks behind all.
    """
    own = own_clip(queries, captions)
    if leave_out_self:
        own = own.where("a <> b")
    best = best_of_pairs(own, queries, captions, "a").withColumnRenamed("a", "id")
    skip = F.col("id") if leave_out_self else F.lit(None).cast("bigint")
    asked = queries.select("id", "vec", skip.alias("skip")).join(best, "id", "left")
    return count_clips_above(asked, captions).select("id", (F.col("above") + 1).alias("rank"))


def pooled_item_rank(captions: DataFrame, items: DataFrame) -> DataFrame:
    """clip, rank of a clip's own item among all items, when the clip scores as its best caption."""
    own = own_clip(captions, items).join(captions.select(F.col("id").alias("a"), "clip"), "a")
    best = best_of_pairs(own, captions, items, "clip")
    return count_above_pooled(captions.join(best, "clip").select("id", "clip", "vec", "best"), items).select("clip", (F.col("above") + 1).alias("rank"))


def rank_in_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """q, rank in a table of scores (q, d, s) of the row that `truth` (q, d) names; NaN scores count as lower than any.

    A query whose truth has no score ranks behind all its candidates.
    """
    rounded = scores.select("q", "d", F.when(F.isnan("s"), None).otherwise(F.round("s", DIGITS)).alias("s"))
    wanted = truth.join(rounded, ["q", "d"], "left").groupBy("q").agg(F.max("s").alias("best"))
    above = rounded.join(wanted, "q").where(F.col("best").isNull() & F.col("s").isNotNull() | (F.col("s") > F.col("best"))).groupBy("q").agg(F.count("*").alias("n"))
    return wanted.join(above, "q", "left").select("q", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def distinct_clips(ranked: DataFrame, k: int, target: DataFrame | None = None) -> DataFrame:
    """id, clip, score, pos: the first k clips that a ranking of captions (id, clip, score, pos) meets.

    The target clip (id, clip) is appended behind if it is not among them.
    """
    first = ranked.groupBy("id", "clip").agg(F.min_by("score", "pos").alias("score"), F.min("pos").alias("at"))
    order = Window.partitionBy("id").orderBy("at")
    top = first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("id", "clip", "score", "pos")
    return top if target is None else with_target(top, target)


def with_target(top: DataFrame, target: DataFrame) -> DataFrame:
    """A ranking of clips (id, clip, score, pos) with the target clip (id, clip) behind it where it is not among them."""
    length = top.groupBy("id").agg(F.max("pos").alias("n"))
    lacking = target.select("id", "clip").join(top.select("id", "clip"), ["id", "clip"], "left_anti").join(length, "id", "left")
    return top.unionByName(lacking.select("id", "clip", F.lit(None).cast("double").alias("score"), (F.coalesce("n", F.lit(0)) + 1).alias("pos")))


def argsort_rank(queries: DataFrame, gallery: DataFrame, truth: DataFrame) -> DataFrame:
    """id, position of the one true row (pairs a, b) in a full sort by score, ties by smaller id: the trainer's rank."""
    best = best_of_pairs(truth.select("a", "b"), queries, gallery, "a").join(truth.select("a", F.col("b").alias("truth")), "a").withColumnRenamed("a", "id")
    asked = queries.select("id", "vec", F.lit(None).cast("bigint").alias("skip")).join(best, "id")
    return count_above(asked, gallery, argsort=True).select("id", (F.col("above") + 1).alias("position"))
