"""A mix of sources with target shares of all tokens, by weighted fair queueing.

Each source's documents stand in a shuffled line, one pass after the other up to its cap. A document's virtual
finish time is the tokens of its line up to and with it, divided by the weight of its source; reading all lines
in the order of finish times serves each source by its weight at any moment. The mix is what that order gives
until the budget is spent.

Running sums never gather a source in one task: documents fall into slices of the shuffle hash, sums
of slices give each slice its start, and only a slice is summed in order. The global cut works likewise over
slices of virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Documents of a slice, about, and the bounds of the number of slices.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 100_000, 64, 1 << 16
#: The shuffle hash is cut to this range, which holds any number of slices that is a power of two.
RANGE = 1 << 40
#: Part of the target weight that may lie with sources which run dry before the mix ends, if no budget is named.
SLACK = 0.05


def targets(rows: DataFrame) -> DataFrame:
    """source, weight, max_repeats: usable targets, one per source (the largest weight if it is named again).

    Targets with a null source, a null, NaN or non-positive weight or less than one repeat do not count.
    """
    ok = rows.where(F.col("source").isNotNull() & (F.col("target_weight") > 0) & ~F.isnan("target_weight") & (F.col("max_repeats") >= 1))
    return ok.groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t")).select("source", F.col("t.target_weight").alias("weight"), F.col("t.max_repeats").alias("max_repeats"))


def _horizon(lines: list[tuple[int, float]], tokens: int) -> float:
    """The virtual time at which lines of (tokens in all, weight) have given `tokens`, or at which all are dry."""
    left, time = float(tokens), 0.0
    for n, w in sorted(lines, key=lambda x: x[0] / x[1]):
        rate = sum(v for m, v in lines if m / v > time)
        step = n / w - time
        if rate * step >= left:
            return time + left / rate
        left -= rate * step
        time = n / w
    return time


def _end(lines: list[tuple[int, float]], slack: float) -> float:
    """The virtual time up to which sources with all but `slack` of the weight go on; lines are (tokens in all, weight)."""
    spare = slack * sum(w for _, w in lines)
    for n, w in sorted(lines, key=lambda x: (x[0] / x[1], x[1])):
        if w > spare:
            return n / w
        spare -= w
    return max(n / w for n, w in lines)


def place(seed: int, key: str) -> Column:
    """Where a document stands in the shuffled line of its source: 40 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 10), 16, 10).cast("long")


def mixture(documents: DataFrame, rows: DataFrame, budget: int | None = None, seed: int = 0, slack: float = SLACK) -> DataFrame:
    """doc_id, source, repeat, tokens, finish: the mix, in no stored order (sort by finish, doc_id to read it).

    `documents` has doc_id, source and tokens; `rows` has source, target_weight and max_repeats. Only sources that
    have both a target and tokens take part; their weights are shared out anew. Without a `budget` the mix is the
    largest in which the sources that reach their share have all but `slack` of the target weight: one tiny source does not
    end it, and no share is off by more. With a budget, the mix has at most that many tokens. Sources that run dry before
    the end leave the rest to the others. `repeat` counts from 1. Documents without
    tokens are never used; repeated doc_ids count each on their own.
    """
    named = written(targets(rows))
    queued = documents.where(F.col("tokens") > 0).join(named, "source")  # written, so its size is known to the planner
    slices_wanted = min(MOST_SLICES, max(LEAST_SLICES, 1 << (documents.count() // SLICE_ROWS).bit_length()))
    lines = queued.withColumn("place", place(seed, "doc_id")).withColumn("slice", F.floor(F.col("place") / F.lit(RANGE // slices_wanted)).cast("int"))

    slices = lines.groupBy("source", "slice").agg(F.sum("tokens").alias("n"), F.first("weight").alias("w"), F.first("max_repeats").alias("r"), F.max("tokens").alias("most"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        slices.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("source")))
    )  # at most MOST_SLICES rows a source
    supply = sorted(tuple(x) for x in starts.groupBy("source").agg(F.first("all"), F.first("w"), F.first("r"), F.max("most")).collect())  # one row per target source
    if not supply:
        return lines.select("doc_id", "source", F.lit(1).alias("repeat"), "tokens", F.lit(0.0).alias("finish")).limit(0)
    if budget is None:
        end = _end([(n * r, w) for _, n, w, r, _ in supply], slack)
        most = int(sum(min(n * r, end * w) for _, n, w, r, _ in supply))
    else:
        end, most = _horizon([(n * r, w) for _, n, w, r, _ in supply], budget + sum(m for *_, m in supply)), budget

    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = lines.withColumn("upto", F.sum("tokens").over(inside)).join(starts.select("source", "slice", "start", "all"), ["source", "slice"])
    needed = F.ceil(F.lit(end) * F.col("weight") / F.col("all")) + 1  # passes that the mix can reach at all
    passes = summed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.least(F.col("max_repeats"), needed).cast("int"))))
    finish = ((F.col("repeat") - 1) * F.col("all") + F.col("start") + F.col("upto")) / F.col("weight")
    served = passes.withColumn("finish", finish.cast("double")).where(F.col("finish") <= end)

    width = max(end, 1e-9) / slices_wanted
    timed = served.withColumn("time", F.least(F.floor(F.col("finish") / F.lit(width)), F.lit(slices_wanted)).cast("int")).select("doc_id", "source", "repeat", "tokens", "finish", "time")
    sums = timed.groupBy("time").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_SLICES + 1 rows
    offsets = sums.withColumn("spent", F.coalesce(F.sum("n").over(before), F.lit(0))).select("time", "spent")
    order = Window.partitionBy("time").orderBy("finish", "source", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = timed.join(F.broadcast(offsets), "time").withColumn("running", F.col("spent") + F.sum("tokens").over(order)).where(F.col("running") <= most)
    return cut.select("doc_id", "source", "repeat", "tokens", "finish").repartitionByRange("finish").sortWithinPartitions("finish", "doc_id")


def shares(mix: DataFrame, rows: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_repeats: every usable target, reached or not.

    target_share is against all usable targets; sources without documents reach 0.
    """
    named = targets(rows)
    got = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeat").alias("most_repeats"))
    joined = named.join(got, "source", "left")
    everywhere = Window.partitionBy()  # one row per target source
    return joined.select(
        "source", (F.col("weight") / F.sum("weight").over(everywhere)).alias("target_share"), (F.coalesce("tokens", F.lit(0)) / F.greatest(F.sum("tokens").over(everywhere), F.lit(1))).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
