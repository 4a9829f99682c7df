"""Online metrics of a stream of ranks: an extension, with late data held to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import KS


def windowed_metrics(ranks: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, task, n, recalls, mrr and dcg over tumbling windows of `ts`; works on tables and on streams.

    `ranks` has ts, task and rank. On a stream, rows later than `late` are dropped and a window is final once it
    is that old; on a table the watermark does nothing.
    """
    rows = ranks.withWatermark("ts", late) if ranks.isStreaming else ranks
    made = [F.round(F.avg(F.when(F.col("rank") <= k, 100.0).otherwise(0.0)), 6).alias(f"r_at_{k}") for k in KS]
    made += [F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.round(F.avg(1.0 / F.log2(F.col("rank") + 1.0)), 6).alias("dcg")]
    out = rows.groupBy(F.window("ts", every).alias("w"), "task").agg(F.count("*").alias("n"), *made)
    return out.select(F.col("w.start").alias("window_start"), "task", "n", *[f"r_at_{k}" for k in KS], "mrr", "dcg")


def start(ranks: DataFrame, path: str, checkpoint: str, every: str = "1 hour", late: str = "2 hours"):
    """A query that appends finished windows to parquet files, each exactly once."""
    out = windowed_metrics(ranks, every, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
