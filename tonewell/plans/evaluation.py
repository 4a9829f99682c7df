"""Plans: whole evaluations and mining runs, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import metrics, mining, ranking, rerankers
from . import reranked


@dataclass(frozen=True)
class EvaluationConfig:
    """What to evaluate: tasks, cut-offs, how captions stand for clips, and an optional reranker.

    With a mode other than `captionwise` all tasks run over pooled clips and no reranker takes part.
    """

    tasks: Sequence[str] = ("t2a", "a2t", "t2t")
    ks: Sequence[int] = metrics.KS
    mode: str = "captionwise"
    reranker: str | None = None
    client: str = "mock"
    top_k: int = 50


def task_ranks(captions: DataFrame, items: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """task, id, rank for every task; captions and items have id, clip and unit vec, and items have their clip as id."""
    if config.mode == "captionwise":
        made = {"t2a": lambda: ranking.text_to_item(captions, items), "a2t": lambda: ranking.item_to_text(items, captions), "t2t": lambda: ranking.text_to_text(captions)}
    elif config.mode == "caption_avg":
        bank = ranking.centroids(captions)
        made = {
            "t2a": lambda: ranking.ranks(bank, items, ranking.own_clip(bank, items)),
            "a2t": lambda: ranking.ranks(items, bank, ranking.own_clip(items, bank)),
            "t2t": lambda: ranking.pooled_average(captions, captions),
        }
    elif config.mode == "caption_pool":
        made = {
            "t2a": lambda: ranking.pooled_item_rank(captions, items).withColumnRenamed("clip", "id"),
            "a2t": lambda: ranking.pooled_best(items, captions),
            "t2t": lambda: ranking.pooled_best(captions, captions),
        }
    else:
        raise ValueError(f"unknown mode {config.mode!r}")
    parts = [made[t]().select(F.lit(t).alias("task"), "id", "rank") for t in config.tasks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(captions: DataFrame, items: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row of metrics per task."""
    return metrics.all_metrics(task_ranks(captions, items, config), "task", ks=config.ks)


def evaluate_reranked(captions: DataFrame, items: DataFrame, config: EvaluationConfig, enrich=None) -> DataFrame:
    """task, stage (baseline, reranked) and metrics, with the reranker that `config` names over its first top_k.

    `enrich(task, candidates)` may add to the candidates (q, d, score, pos) what the reranker reads. A reranker takes part
    only while captions stand for themselves.
    """
    if config.mode != "captionwise":
        raise ValueError("a reranker needs captions that stand for themselves")
    run = rerankers.build({"enabled": True, "mode": config.reranker, "top_k": config.top_k, "client": {"name": config.client}})
    return reranked.stage_metrics(reranked.all_details(captions, items, run, config.tasks, enrich), config.ks)


def hard_negatives(items: DataFrame, captions: DataFrame, k: int = 50, threshold: float = 0.7, most: int = 50, keep: int | None = None) -> DataFrame:
    """id, other, score, pos, similarity, kept: acoustic neighbours whose captions differ enough, in order."""
    pairs = mining.neighbours(items, k, keep)
    return mining.filter_then_limit(mining.group_similarity(pairs, captions), threshold, most)


def mine_stage(items: DataFrame, out: str, k: int = 50, keep: int | None = None) -> None:
    """First stage alone: one JSON record an anchor, audio_id and its neighbors in order, at `out`."""
    item = F.struct("pos", F.col("other").alias("audio_id"), "score")
    rows = mining.neighbours(items, k, keep).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("n"))  # k entries an anchor
    named = F.transform("n", lambda x: F.struct(x["audio_id"].alias("audio_id"), x["score"].alias("score")))
    sources.records_jsonl(rows.select(F.col("id").alias("audio_id"), named.alias("neighbors")), out, overwrite=True)


def filter_stage(mined: str, captions: DataFrame, out: str, threshold: float = 0.7, most: int = 50) -> None:
    """Second stage alone, from the records of the first: anchors with their hard negatives, and how many were filtered out, at `out`."""
    pairs = sources.neighbour_records(captions.sparkSession, mined).select(F.col("id").cast("bigint").alias("id"), F.col("other").cast("bigint").alias("other"), "score", "pos")
    sizes = pairs.groupBy("id").agg(F.count("*").alias("n"))
    kept = mining.filter_then_limit(mining.group_similarity(pairs, captions), threshold, most)
    sources.records_jsonl(mining.as_records(kept.join(sizes, "id")), out, overwrite=True)
