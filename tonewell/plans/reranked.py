"""Evaluation with a second stage: text to item, text to text and item to text, with hits, details and diagnostics.

Captions have id, clip and unit vec; items have their clip as id. For text to text a candidate is a clip, which scores as
its best caption without the asking one, and a query ranks against all clips.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, ranking
from ..operators.rerankers import Configured
from ..operators.similarity import top_clips, top_k
from ..session import written

TASKS = ("t2a", "t2t", "a2t")
Enrich = Callable[[str, DataFrame], DataFrame]


def candidates(task: str, captions: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """q, d, score, pos: the first k of the first stage. d is an item, a clip (t2t) or a caption (a2t)."""
    if task == "t2t":
        return top_clips(captions, captions, k, exclude_self=True).select(F.col("id").alias("q"), F.col("clip").alias("d"), "score", "pos")
    left, right = (captions, items) if task == "t2a" else (items, captions)
    return top_k(left, right, k).select(F.col("id").alias("q"), F.col("other").alias("d"), "score", "pos")


def targets(task: str, captions: DataFrame, items: DataFrame) -> DataFrame:
    """q, d: what counts as found; an item has all its captions."""
    if task == "t2t":
        return captions.select(F.col("id").alias("q"), F.col("clip").alias("d"))
    left, right = (captions, items) if task == "t2a" else (items, captions)
    return ranking.own_clip(left, right).select(F.col("a").alias("q"), F.col("b").alias("d"))


def baseline(task: str, captions: DataFrame, items: DataFrame) -> DataFrame:
    """q, baseline_rank against the whole gallery."""
    made = {"t2a": ranking.text_to_item, "a2t": lambda c, i: ranking.item_to_text(i, c), "t2t": lambda c, i: ranking.pooled_best(c, c, leave_out_self=True)}[task](captions, items)
    return made.select(F.col("id").alias("q"), F.col("rank").cast("bigint").alias("baseline_rank"))


def details(task: str, captions: DataFrame, items: DataFrame, reranker: Configured, enrich: Enrich | None = None) -> DataFrame:
    """One row a query: task, q, baseline_rank, reranked_rank, skipped, target_missing, hit, reranker_mode, original_order,
    reranked_order, initial_scores, new_scores.

    The best target counts. A query whose targets are not among the reranked candidates keeps its baseline rank; one without
    candidates is skipped. A hit is a target at any place for text to item, and within top_k for the others. Targets that the
    first stage did not put among its top_k are not appended, as the limit would cut them off at once.
    """
    most = reranker.top_k if reranker.top_k > 0 else (1 << 31) - 1
    first = candidates(task, captions, items, reranker.top_k if task != "t2t" else most)
    # written once: the orders, the ranks and the details read it
    out = written(reranker(enrich(task, first) if enrich else first).select("q", "d", "score", "pos", F.col("new_score").cast("double").alias("new_score"), "new_pos"))
    found = out.join(targets(task, captions, items), ["q", "d"]).groupBy("q").agg(F.min("new_pos").cast("bigint").alias("_at"))
    row = F.struct("pos", "d", "score", "new_pos", "new_score")
    lists = out.groupBy("q").agg(F.array_sort(F.collect_list(row)).alias("_l"))  # top_k entries a query
    by_new = F.array_sort(F.transform("_l", lambda x: F.struct(x["new_pos"].alias("n"), x["d"].alias("d"))))
    joined = baseline(task, captions, items).join(found, "q", "left").join(lists, "q", "left")
    near = F.col("_at").isNotNull() & (F.lit(task == "t2a") | (F.col("_at") <= most))
    return joined.select(
        F.lit(task).alias("task"), "q", "baseline_rank", F.coalesce("_at", "baseline_rank").alias("reranked_rank"), F.col("_l").isNull().alias("skipped"),
        (F.col("_at").isNull() & F.col("_l").isNotNull()).alias("target_missing"), near.alias("hit"), F.lit(reranker.mode).alias("reranker_mode"),
        F.transform("_l", lambda x: x["d"]).alias("original_order"), F.transform(by_new, lambda x: x["d"]).alias("reranked_order"),
        F.map_from_entries(F.transform("_l", lambda x: F.struct(x["d"], x["score"]))).alias("initial_scores"),
        F.map_from_entries(F.transform("_l", lambda x: F.struct(x["d"], x["new_score"]))).alias("new_scores"),
    )


def all_details(captions: DataFrame, items: DataFrame, reranker: Configured, tasks: Sequence[str] = TASKS, enrich: Enrich | None = None) -> DataFrame:
    parts = [details(t, captions, items, reranker, enrich) for t in tasks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_metrics(rows: DataFrame, ks: Sequence[int] = metrics.KS) -> DataFrame:
    """task, stage (baseline, reranked) and metrics of details."""
    pair = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_rank").alias("rank")) for s in ("baseline", "reranked")])
    return metrics.all_metrics(rows.select("task", F.explode(pair).alias("x")).select("task", "x.stage", "x.rank"), "task", "stage", ks=ks)


def summary(rows: DataFrame, name: str, top_k: int, latency: str | None = None, cost: str | None = None) -> DataFrame:
    """One row a task: name, top_k, num_calls, total and average latency and cost, hits_within_top_k, hit_rate_within_top_k and mode_histogram.

    `latency` and `cost` name columns of `rows` where runs were timed; otherwise they are 0.
    """
    seconds, gpu = (F.col(c) if c else F.lit(0.0) for c in (latency, cost))
    per = rows.groupBy("task", "reranker_mode").agg(
        F.count("*").alias("n"), F.sum(seconds).alias("s"), F.sum(gpu).alias("g"), F.sum(F.col("hit").cast("bigint")).alias("h"),
    )
    n = F.sum("n")
    return per.groupBy("task").agg(
        F.lit(name).alias("name"), F.lit(top_k).alias("top_k"), n.alias("num_calls"), F.round(F.sum("s"), 6).alias("total_latency"), F.round(F.sum("s") / n, 6).alias("avg_latency"),
        F.round(F.sum("g"), 6).alias("total_gpu_cost"), F.round(F.sum("g") / n, 6).alias("avg_gpu_cost"), F.sum("h").alias("hits_within_top_k"),
        F.round(F.sum("h") / n, 6).alias("hit_rate_within_top_k"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reranker_mode", "n")))).alias("mode_histogram"),
    )


# The columns of a diagnostics file, in its order.
DIAGNOSTICS = (
    "dataset model reranker_slug experiment_id sample_start sample_end sample_seed tasks tasks_slug top_k query_index query_text target_clip_id target_candidate_idx "
    "baseline_rank reranked_rank target_missing skipped original_order reranked_order initial_scores candidate_clip_ids reranker_mode diagnostic_type diagnostic_scores "
    "late_interaction_scores latency_seconds gpu_cost_seconds used_fallback fallback_reason partial_order raw_response prompt completed_with pointwise_scores"
).split()


def diagnostics(rows: DataFrame, **about: str | int | None) -> DataFrame:
    """The rows of a diagnostics file: every column of DIAGNOSTICS, from details, from `about`, or empty.

    `rows` are details, with more columns of DIAGNOSTICS where a client or a join gave them.
    """
    made = {
        "query_index": F.col("q"), "tasks": F.col("task"), "tasks_slug": F.col("task"), "candidate_clip_ids": F.transform("original_order", lambda d: d.cast("string")), "diagnostic_scores": F.col("new_scores"),
        "latency_seconds": F.lit(0.0), "gpu_cost_seconds": F.lit(0.0), "used_fallback": F.lit(False),
    }
    late = F.when(F.col("reranker_mode") == "late_interaction", F.col("new_scores"))
    columns = []
    for c in DIAGNOSTICS:
        if c in rows.columns:
            columns.append(F.col(c))
        elif c in about:
            columns.append(F.lit(about[c]).alias(c))
        elif c == "late_interaction_scores":
            columns.append(late.alias(c))
        else:
            columns.append(made.get(c, F.lit("")).alias(c))
    return rows.select(*columns)
