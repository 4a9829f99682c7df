"""Word sets of texts, classes of equal sets, and the exact test for near texts.

Two texts are near if each has at least `min_words` distinct words and shares at least `threshold` of the
words of either. A class holds all rows with one word set; only one row of it, the one with the smallest
key, takes part in searches, so copies cost nothing however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_set

MIN_WORDS = 12
THRESHOLD = 0.75


def with_words(df: DataFrame, key: Column, text: Column, *more: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """id, words, h1, h2 and `more`, for rows whose text has enough distinct words. h1 and h2 name the class."""
    rows = df.select(key.alias("id"), word_set(text).alias("words"), *more).where(F.size("words") >= min_words)
    return rows.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit(1), F.col("words")))


def classes(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """id (the smallest key of the class), words, h1, h2 and aggregates; combined before the shuffle."""
    return rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("words").alias("words"), *aggregates)


def near(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two word sets agree enough; exact, in whole numbers."""
    shared = F.size(F.array_intersect(a, b))
    num, den = _fraction(threshold)
    return shared * den >= (F.size(a) + F.size(b) - shared) * num


def _fraction(threshold: float) -> tuple[int, int]:
    from fractions import Fraction

    f = Fraction(threshold).limit_denominator(10_000)
    return f.numerator, f.denominator


def least_shared(n: int, threshold: float) -> int:
    """Words that a set of n must share with any set near it."""
    num, den = _fraction(threshold)
    return math.ceil(n * num / den)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, contained: bool = False) -> DataFrame:
    """a, b of the candidate pairs whose sets are near. `sets` has id and words."""
    left = sets.select(F.col("id").alias("a"), F.col("words").alias("_wa"))
    right = sets.select(F.col("id").alias("b"), F.col("words").alias("_wb"))
    small = F.least(F.size("_wa"), F.size("_wb"))
    large = F.greatest(F.size("_wa"), F.size("_wb"))
    num, den = _fraction(threshold)
    both = pairs.join(left, "a").join(right, "b").where(small * den >= large * num)
    shares = F.size(F.array_intersect("_wa", "_wb")) / F.size("_wa")
    return both.where(near(F.col("_wa"), F.col("_wb"), threshold)).select("a", "b", *([shares.alias("containment")] if contained else []))


#: Members of a class that one slice holds, about; a task makes at most SLICE * SLICE pairs of a class at a time.
SLICE = 4_096


def member_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, *more: str, size: int | None = None) -> DataFrame:
    """a, b, x, y and `more`: the members x of class a with the members y of class b, for each of the pairs (a, b, `more`).

    `left` and `right` hold class and id. A pair of classes is a grid of cells, one for each slice of either, so no
    task has more of a class than some slices.
    """
    size = size or SLICE

    def sliced(side: DataFrame, key: str, part: str, member: str) -> tuple[DataFrame, DataFrame]:
        sizes = side.groupBy(F.col("class").alias(key)).agg(F.ceil(F.count("*") / size).cast("int").alias(f"n{part}"))
        named = side.select(F.col("class").alias(key), F.col("id").alias(member)).join(sizes, key)
        return named.select(key, F.pmod(F.xxhash64(F.lit(5), member), F.col(f"n{part}")).cast("int").alias(part), member), sizes

    (xs, nx), (ys, ny) = sliced(left, "a", "sx", "x"), sliced(right, "b", "sy", "y")
    wide = pairs.select("a", "b", *more).join(nx, "a").join(ny, "b")
    cells = wide.withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("nsx") - 1))).withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("nsy") - 1))).drop("nsx", "nsy")
    cell = ["a", "b", "sx", "sy"]
    with_x = cells.join(xs, ["a", "sx"]).select(*cell, *more, "x")
    with_y = cells.select(*cell).join(ys, ["b", "sy"]).select(*cell, "y")
    return with_x.join(with_y, cell).select("a", "b", "x", "y", *more)
