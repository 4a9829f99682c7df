"""Command line: list and run queries, evaluate and rerank vectors, precompute them, mine hard negatives, make template queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.prompts import TYPES


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonewell")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run one query by name; without a name, list them")
    q.add_argument("name", nargs="?")
    q.add_argument("--tables", default=".")
    q.add_argument("--out")
    e = sub.add_parser("evaluate", help="metrics of captions against items (parquet with id, clip, vec)")
    e.add_argument("captions")
    e.add_argument("items")
    e.add_argument("--mode", default="captionwise", choices=["captionwise", "caption_avg", "caption_pool"])
    e.add_argument("--tasks", nargs="+", default=["t2a", "a2t", "t2t"])
    e.add_argument("--out")
    r = sub.add_parser("rerank", help="metrics before and after a reranker; candidates show their ids, texts come from --texts")
    r.add_argument("captions")
    r.add_argument("items")
    r.add_argument("--texts", help="parquet with id, query_text; d, audio and caption where a mode needs them")
    r.add_argument("--mode", default="audio_native_pointwise")
    r.add_argument("--client", default="mock")
    r.add_argument("--topk", type=int, default=50)
    r.add_argument("--tasks", nargs="+", default=["t2a", "a2t", "t2t"])
    r.add_argument("--out")
    c = sub.add_parser("precompute", help="vectors of a data set's audio, captions and queries, by a registered encoder")
    c.add_argument("captions")
    c.add_argument("audio")
    c.add_argument("--queries")
    c.add_argument("--encoder", default="hashed")
    c.add_argument("--out", required=True)
    m = sub.add_parser("mine", help="hard negatives of items, filtered by captions")
    m.add_argument("items")
    m.add_argument("captions")
    m.add_argument("--topk", type=int, default=50)
    m.add_argument("--keep", type=int)
    m.add_argument("--threshold", type=float, default=0.7)
    m.add_argument("--most", type=int, default=50)
    m.add_argument("--out", required=True)
    g = sub.add_parser("generate", help="template queries of a caption file")
    g.add_argument("captions")
    g.add_argument("--types", nargs="+", default=[t for t in TYPES if t != "negative"])
    g.add_argument("--out", required=True)
    return p


def _shown(spark: SparkSession, texts: str | None):
    """What a reranker reads: texts by query, and ids where no names are given."""

    def enrich(task: str, c):
        out = c
        if texts:
            out = out.join(spark.read.parquet(texts).select(F.col("id").alias("q"), "query_text"), "q", "left")
        else:
            out = out.withColumn("query_text", F.col("q").cast("string"))
        return out.withColumn("audio", F.col("d").cast("string")).withColumn("caption", F.col("d").cast("string"))

    return enrich


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from . import sources
    from .functions import prompts
    from .functions.vectors import unit
    from .plans import catalog, precompute
    from .plans.evaluation import EvaluationConfig, evaluate, evaluate_reranked, hard_negatives

    a = _parser().parse_args(args)
    if a.command == "query" and not a.name:
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or SparkSession.builder.appName("tonewell").getOrCreate()
    if a.command == "query":
        out = catalog.queries()[a.name](spark, a.tables)
    elif a.command == "evaluate":
        read = lambda path: spark.read.parquet(path).withColumn("vec", unit("vec"))
        out = evaluate(read(a.captions), read(a.items), EvaluationConfig(tasks=tuple(a.tasks), mode=a.mode))
    elif a.command == "rerank":
        read = lambda path: spark.read.parquet(path).withColumn("vec", unit("vec"))
        out = evaluate_reranked(read(a.captions), read(a.items), EvaluationConfig(tasks=tuple(a.tasks), reranker=a.mode, client=a.client, top_k=a.topk), _shown(spark, a.texts))
    elif a.command == "precompute":
        queries = sources.intent_queries_grouped(spark, a.queries) if a.queries else None
        precompute.dataset(precompute.caption_entries(spark, a.captions, a.audio), queries, a.encoder, a.out).show(50, False)
        return 0
    elif a.command == "mine":
        read = lambda path: spark.read.parquet(path).withColumn("vec", unit("vec"))
        out = hard_negatives(read(a.items), read(a.captions), a.topk, a.threshold, a.most, a.keep)
    else:
        rows = sources.caption_csv(spark, a.captions).select("clip_id", F.explode("captions").alias("original_caption"))
        kinds = rows.withColumn("query_type", F.explode(F.array(*map(F.lit, a.types))))
        out = kinds.withColumn("query", prompts.template_query("query_type", "original_caption"))
    if a.out:
        sources.records_jsonl(out, a.out, overwrite=True)
    else:
        out.show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
