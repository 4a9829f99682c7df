"""Hard-negative mining: acoustic neighbours, semantic filtering, blacklists and expansion to captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .similarity import DIGITS, top_k


def neighbours(items: DataFrame, k: int, keep: int | None = None) -> DataFrame:
    """id, other, score, pos: the k most similar other items, or the first `keep` of the k + 1 most similar."""
    found = top_k(items, items, k if keep is None else k + 1, exclude_self=True)
    return found if keep is None else found.where(F.col("pos") <= keep)


def group_similarity(pairs: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs (id, other, ...) with similarity: the highest score of any captions of the two clips.

    `captions` has clip and vec. Pairs without captions on either side are left out.
    """
    left = captions.select(F.col("clip").alias("id"), F.col("vec").alias("_va"))
    right = captions.select(F.col("clip").alias("other"), F.col("vec").alias("_vb"))
    scored = pairs.select("id", "other").distinct().join(left, "id").join(right, "other").groupBy("id", "other").agg(F.max(F.round(dot("_va", "_vb"), DIGITS)).alias("similarity"))
    return pairs.join(scored, ["id", "other"])


def filter_then_limit(pairs: DataFrame, threshold: float, most: int) -> DataFrame:
    """The first `most` partners by pos whose similarity is below `threshold`, with kept (from 1).

    Anchors without any are left out.
    """
    order = Window.partitionBy("id").orderBy("pos")
    return pairs.where(F.col("similarity") < threshold).withColumn("kept", F.row_number().over(order)).where(F.col("kept") <= most)


def mining_summary(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """anchors, total, kept and kept_percent of a mining run."""
    a = pairs.agg(F.countDistinct("id").alias("anchors"), F.count("*").alias("total"))
    b = kept.agg(F.count("*").alias("kept"))
    both = a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j")
    return both.select("anchors", "total", "kept", F.round(F.col("kept") * 100.0 / F.greatest("total", F.lit(1)), 6).alias("kept_percent"))


def without_pairs(pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pairs (id, other) that are not blocked (a, b in any order); an item with itself always stays."""
    b = blocked.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
    on = (F.least("id", "other") == F.col("_x")) & (F.greatest("id", "other") == F.col("_y")) & (F.col("id") != F.col("other"))
    return pairs.join(b, on, "left_anti")


def expand_to_captions(negatives: DataFrame, captions: DataFrame, most: int) -> DataFrame:
    """anchor_caption, negative_caption, n: each caption of an anchor with the first `most` captions of its negatives.

    `negatives` has id, other and pos; `captions` has id and clip. Negatives go by pos, their captions by id.
    """
    theirs = negatives.join(captions.select(F.col("clip").alias("other"), F.col("id").alias("negative_caption")), "other")
    order = Window.partitionBy("id").orderBy("pos", "negative_caption")
    first = theirs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    anchors = captions.select(F.col("clip").alias("id"), F.col("id").alias("anchor_caption"))
    return first.join(anchors, "id").select("anchor_caption", "negative_caption", "n")


def as_records(pairs: DataFrame) -> DataFrame:
    """One row per anchor: id, hard_negatives (ordered structs) and num_filtered, given pairs with `n` partners in all."""
    one = F.struct("pos", F.col("other"), "score", "similarity")
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("hard_negatives"), (F.first("n") - F.count("*")).alias("num_filtered"))
