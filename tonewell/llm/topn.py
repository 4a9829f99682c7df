"""Top N items within every group, by per-group histograms of the score.

A first pass counts, for each group, rows by score bin; bins are the leading bits of the score in an order
that keeps the order of doubles, so one pass serves any range of scores. Large groups get a lower threshold:
the highest bin down to which at least `SPARE * n` rows lie. The second pass drops rows below it before
anything is shuffled, keeps the best score of each item (combined before the shuffle too), and ranks what
is left with the tie key. Rows may name an item again, so a threshold could leave too few items; such groups
are found by counting and taken again from all their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SPARE = 8
#: At most this many groups get a threshold, the bound of what is broadcast: groups with more rows than a
#: `LARGE_GROUPS`-th of the table, of which there cannot be more, and with at least MIN_ROWS rows.
LARGE_GROUPS = 20_000
MIN_ROWS = 1_000


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises: sign, exponent and five bits of the fraction.

    -0.0 and 0.0 share a bin. Made from arithmetic, as there is no cast of a double to its bits.
    """
    size = F.abs(score)
    log = F.when(size > 0, F.log2(size)).otherwise(F.lit(-1075.0))
    step = F.floor(F.least(F.greatest(log, F.lit(-60.0)), F.lit(1100.0)) * 32).cast("long") + 60 * 32 + 1
    return F.when(score == 0, F.lit(0).cast("long")).when(score > 0, step).otherwise(-step)


def top_items(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """`group`, `item`, `score`, rnk: the n best items of each group, by score descending, then item ascending.

    Rows with a null group or item, a null or NaN score, or the group itself as item do not count; an item
    with several rows counts once, with its best score. A group with fewer items gives all it has. Infinite
    scores rank as numbers. Other columns are not looked at.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.col("g") != F.col("i")))
    binned = rows.withColumn("b", score_bin(F.col("s")))

    counts = written(binned.groupBy("g", "b").agg(F.count("*").alias("c")))  # combined before the shuffle
    down = Window.partitionBy("g").orderBy(F.desc("b"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    least = max(MIN_ROWS, total // LARGE_GROUPS)
    large = counts.groupBy("g").agg(F.sum("c").alias("size")).where(F.col("size") > least).select("g")
    sizes = counts.join(large, "g").withColumn("above", F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    # the lowest bin still needed: all bins before which fewer than SPARE * n rows lie
    thresholds = written(sizes.where(F.coalesce("above", F.lit(0)) < SPARE * n).groupBy("g").agg(F.min("b").alias("least")))  # LARGE_GROUPS rows at most
    kept = binned.join(F.broadcast(thresholds), "g", "left").where(F.col("least").isNull() | (F.col("b") >= F.col("least")))
    best = kept.groupBy("g", "i").agg(F.max("s").alias("s"), F.max(F.col("least").isNotNull()).alias("cut"))
    order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    ranked = written(best.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n))

    # groups that were cut and are left with fewer than n items, of which there are few: again, from all rows
    short = written(ranked.where("cut").groupBy("g").agg(F.max("rnk").alias("m")).where(F.col("m") < n).select("g"))
    whole = ranked.select("g", "i", "s", "rnk")
    if not short.isEmpty():
        again = rows.join(F.broadcast(short), "g", "left_semi").groupBy("g", "i").agg(F.max("s").alias("s"))
        again = again.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n)
        whole = whole.join(F.broadcast(short), "g", "left_anti").unionByName(again)
    return whole.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rnk").cast("int").alias("rnk"))
