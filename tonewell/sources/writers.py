"""Writers: records, reports, diagnostics and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["diagnostics_csv", "manifest_csv", "nested_report", "npz_to_parquet", "records_json", "records_jsonl", "refreshed", "report_json", "run_metadata", "vectors_npz"]


def records_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON record a line."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def records_json(df: DataFrame, path: str) -> None:
    """JSON arrays of records, one array a file."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            for start in range(0, len(batch), 1000):
                rows = ",\n".join(batch["value"].iloc[start : start + 1000])
                yield pd.DataFrame({"value": [("[\n" if first else ",\n") + rows]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "\n]"]})

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(make, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def report_json(metrics: DataFrame, path: str, **about: str) -> None:
    """Metrics with what they were measured on, as JSON."""
    metrics.select(*[F.lit(v).alias(k) for k, v in about.items()], "*").coalesce(1).write.mode("overwrite").json(path)


def nested_report(metrics: DataFrame, by: str, path: str, config: dict | None = None, setup: dict | None = None) -> None:
    """One JSON record: metrics by the values of `by` (tasks, stages: few), and config and setup as they are given."""
    values = F.struct(*[c for c in metrics.columns if c != by])
    whole = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string"), values)))).alias("metrics"))  # one entry a task
    parts = [F.to_json("metrics")] + [F.lit(json.dumps(x or {}, sort_keys=True, default=str)) for x in (config, setup)]
    line = F.concat(F.lit('{"metrics":'), parts[0], F.lit(',"config":'), parts[1], F.lit(',"setup":'), parts[2], F.lit("}"))
    whole.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def refreshed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the values that `new` has for the same keys; values that are null in `new` stay, and rows it alone has come in.

    For metrics that are computed again for checkpoints that stand already.
    """
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *[(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c) for c in rest])


def diagnostics_csv(df: DataFrame, path: str) -> None:
    """A CSV of any table: arrays joined by blanks (texts by ` | `), maps and structs as JSON."""
    made = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            made.append(F.array_join(f.name, " | ").alias(f.name))
        elif kind.startswith("array<") and "<" not in kind[6:]:
            made.append(F.array_join(F.col(f.name).cast("array<string>"), " ").alias(f.name))
        elif kind.startswith(("map<", "struct<", "array<")):
            made.append(F.to_json(f.name).alias(f.name))
        else:
            made.append(F.col(f.name))
    df.select(*made).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def manifest_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """clip_id, audio_relpath, caption, source, duration (six decimals), caption_index; an existing one stays unless overwritten."""
    duration = F.format_string("%.6f", F.col("duration").cast("double"))
    rows = df.select("clip_id", "audio_relpath", "caption", "source", duration.alias("duration"), F.lit(0).alias("caption_index"))
    rows.write.mode("overwrite" if overwrite else "ignore").option("header", True).option("escape", '"').csv(path)


def run_metadata(queries: DataFrame, path: str, **about: str) -> None:
    """Counts by query type with what the run was."""
    from ..functions.prompts import counts

    counts(queries).select(*[F.lit(v).alias(k) for k, v in about.items()], "*").coalesce(1).write.mode("overwrite").json(path)


def vectors_npz(df: DataFrame, folder: str, vec: str = "embedding") -> DataFrame:
    """path, rows of the archives written: one for each partition, with embeddings and the other columns as aligned lists.

    `folder` is shared by the executors. Every task writes its own archive, under a name of its own that it takes up only
    when it is whole, so a task that is run again leaves no half.
    """
    rest = [c for c in df.columns if c != vec]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        whole = pd.concat(parts, ignore_index=True)
        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        path, half = f"{folder}/part-{context.partitionId():05d}.npz", f"{folder}/.part-{context.taskAttemptId()}.npz"
        np.savez_compressed(half, embeddings=np.stack([np.asarray(v, np.float32) for v in whole[vec]]), **{c: whole[c].astype(str).to_numpy(str) for c in rest})
        os.replace(half, path)
        yield pd.DataFrame({"path": [path], "rows": [len(whole)]})

    return df.where(F.col(vec).isNotNull()).mapInPandas(make, "path string, rows long")


def npz_to_parquet(spark: SparkSession, source: str | list[str], path: str, batch: int = 2_000) -> None:
    """NumPy archives with embeddings and aligned lists as parquet: idx, embedding and one column per list.

    Executors read the archives, one task each, from the folder they share; only the names of the lists of the first one are
    read here. idx counts within an archive; `source` may name several, whose rows are told apart by archive.
    """
    paths = [str(source)] if isinstance(source, (str, Path)) else [str(x) for x in source]
    with np.load(paths[0], allow_pickle=False) as data:
        n = len(data["embeddings"])
        lists = [k for k in data.files if k != "embeddings" and data[k].ndim == 1 and len(data[k]) == n]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for p in names["archive"]:
                with np.load(p, allow_pickle=False) as data:
                    vectors, texts = data["embeddings"], {k: data[k] for k in lists}
                for start in range(0, len(vectors), batch):
                    part = vectors[start : start + batch].astype(np.float32)
                    yield pd.DataFrame({"archive": p, "idx": np.arange(start, start + len(part)), "embedding": list(part)} | {k: v[start : start + batch].astype(str) for k, v in texts.items()})

    schema = "archive string, idx bigint, embedding array<float>" + "".join(f", `{k}` string" for k in lists)
    rows = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(len(paths))
    rows.mapInPandas(make, schema).write.mode("overwrite").parquet(path)
