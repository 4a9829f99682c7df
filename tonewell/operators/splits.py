"""Deterministic splits, samples, counters and deduplication of manifests."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 8 bytes of md5 of `{key}_{seed}`, big-endian."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"_{seed}")).cast("binary"))
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0


def hash_split(df: DataFrame, key: str, source: str, ratio: float, seed: int = 1337) -> DataFrame:
    """With part: `val` where the hash is below `ratio`, else `train`.

    A source without any validation row gives up its last training row, by `key`. The last row is found by a
    maximum that combines before the shuffle, so a source of any size is no burden. `key` names a row.
    """
    drawn = df.withColumn("part", F.when(hash_unit(F.col(key), seed) < ratio, "val").otherwise("train"))
    per = drawn.groupBy(source).agg(F.max(F.when(F.col("part") == "val", 1).otherwise(0)).alias("_has"), F.max(key).alias("_last"))
    moved = per.where("_has = 0").select(F.col(source).alias("_s"), "_last")
    both = drawn.join(moved, (F.col(source).eqNullSafe(F.col("_s"))) & (F.col(key) == F.col("_last")), "left")
    return both.withColumn("part", F.when(F.col("_last").isNotNull(), "val").otherwise(F.col("part"))).drop("_s", "_last")


def slice_between(df: DataFrame, index: str, start: int | None, end: int | None) -> DataFrame:
    """Rows whose index lies in [start, end); open ends are null, negative starts count as 0."""
    low = max(0, start or 0)
    kept = df.where(F.col(index) >= low)
    return kept if end is None else kept.where(F.col(index) < max(low, end))


def seeded_sample(n: int, size: int, seed: int) -> list[int]:
    """Sorted positions of a seeded sample of clips, from Python's generator; `size` positions at most."""
    return list(range(n)) if size >= n else sorted(random.Random(seed).sample(range(n), size))


def seeded_choice(captions: DataFrame, clip: str, key: str, seed: int) -> DataFrame:
    """One caption per clip, the one with the least hash of seed and key: the same on every run and cluster."""
    return chosen_captions(captions, clip, key, seed, 1)


def chosen_captions(captions: DataFrame, clip: str, key: str, seed: int, per_clip: int | None) -> DataFrame:
    """`clip`, `key`: `per_clip` captions of each clip, those of the least hash of key and seed; all for null or 0.

    Text to item alone asks with one caption a clip, together with item to text with all; text to text with one by
    default. Draws of different tasks take different seeds.
    """
    if not per_clip:
        return captions.select(clip, key)
    drawn = captions.select(clip, key, hash_unit(F.col(key), seed).alias("_u"))
    if per_clip == 1:
        return drawn.groupBy(clip).agg(F.min_by(F.col(key), F.struct("_u", F.col(key))).alias(key))
    order = Window.partitionBy(clip).orderBy("_u", key)
    return drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_clip).select(clip, key)


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """`df` with `name`, its place from 0 in the whole order.

    Ranges of the order are sorted apart and counted, and each starts where those before it end: no task sees all rows.
    The rows are written once, as their places must not change.
    """
    from ..session import written

    low = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(low))))
    sizes = sorted(placed.groupBy("_p").count().collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(total)]
        total += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    return placed.withColumn(name, (F.create_map(*starts)[F.col("_p")] + F.col("_i")).cast("long")).drop("_p", "_i")


def occurrence_keys(df: DataFrame, clip: str, order: str) -> DataFrame:
    """With caption_key `{clip}_caption_{nn}`, counted from 0 within each clip by `order`, before any filter."""
    w = Window.partitionBy(clip).orderBy(order)
    return df.withColumn("caption_key", F.format_string("%s_caption_%02d", F.col(clip).cast("string"), (F.row_number().over(w) - 1).cast("int")))


def duration_between(df: DataFrame, duration: str, low: float = 0.0, high: float | None = None) -> DataFrame:
    """Rows with a duration from `low` to `high`; a bound of 0 or null is none."""
    kept = df
    if low:
        kept = kept.where(F.col(duration) >= low)
    return kept if high is None else kept.where(F.col(duration) <= high)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def append_missing(first: DataFrame, second: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `first`, then rows of `second` whose keys are not there, as one order per key."""
    both = first.select(*keys, F.struct(F.lit(0).alias("part"), F.col(order).alias("at")).alias("_o")).unionByName(second.select(*keys, F.struct(F.lit(1).alias("part"), F.col(order).alias("at")).alias("_o")))
    return both.groupBy(*keys).agg(F.min("_o").alias("_o")).select(*keys, F.col("_o.part").alias("part"), F.col("_o.at").alias("at"))
