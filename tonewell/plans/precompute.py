"""Vectors made ahead: of a data set's audio, captions and queries, and of queries by type.

Encoders are registered by name. What they are is not known here: a maker gives, once a task, a function from a list of
values to an array of vectors, None for a value it cannot encode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..sources import readers, writers


@dataclass(frozen=True)
class Encoder:
    """What an encoder takes and does: makers for texts and audio, the vectors' width, and how audio must be brought to it.

    `unreadable` says what becomes of audio that cannot be decoded: raise, silence (of `seconds`), drop or null.
    """

    texts: Callable[[], Callable] | None
    audio: Callable[[], Callable] | None
    dim: int
    sampling_rate: int = 16_000
    seconds: float | None = 10.0
    unreadable: str = "raise"
    silence: object = None


_ENCODERS: dict[str, Encoder] = {}


def register(name: str, encoder: Encoder) -> None:
    _ENCODERS[name] = encoder


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; known: {sorted(_ENCODERS)}")
    return _ENCODERS[name]


def encoded(df: DataFrame, value: str, name: str, kind: str) -> DataFrame:
    """`df` with embedding of the texts or audio in `value`, by a registered encoder and its way with what it cannot read."""
    e = encoder(name)
    make = e.texts if kind == "text" else e.audio
    if make is None:
        raise ValueError(f"encoder {name!r} knows no {kind}")
    return readers.encode_rows(df, value, make, e.dim, e.unreadable if kind == "audio" else "null", e.silence)


def dataset(entries: DataFrame, queries: DataFrame | None, name: str, out: str, buckets: Sequence[str] = tuple(prompts.BUCKETS.values())) -> DataFrame:
    """what, rows of the tables written under `out`: audio, captions, and queries of each bucket, as parquet.

    `entries` has clip_id, captions and audio; `queries` has bucket, clip_id and query, of which those of entries with audio
    count, in the order of clip ids. A bucket without any leaves no table. Rows that an encoder drops fall out of all that
    stands beside them.
    """
    there = entries.where(F.col("audio").isNotNull())
    made = {
        "audio": encoded(there.select("clip_id", "audio"), "audio", name, "audio").drop("audio"),
        "captions": encoded(entries.select("clip_id", F.posexplode("captions").alias("caption_index", "caption")), "caption", name, "text"),
    }
    for b in buckets if queries is not None else ():
        rows = queries.where(F.col("bucket") == b).join(there.select("clip_id").distinct(), "clip_id", "left_semi").select("clip_id", "query")
        made[f"queries_{b.lower().replace('/', '_').replace('-', '_')}"] = encoded(rows, "query", name, "text")
    spark, counts = entries.sparkSession, []
    for what, df in made.items():
        path = f"{out}/{what}"
        df.repartitionByRange("clip_id").sortWithinPartitions("clip_id").write.mode("overwrite").parquet(path)
        n = spark.read.parquet(path).count()
        counts.append((what, n))
    return spark.createDataFrame(counts, "what string, rows long")


def queries_by_type(queries: DataFrame, name: str, out: str, about: str = "unknown") -> DataFrame:
    """query_type, num_queries, output_file: flat queries (clip_id, query, query_type) encoded, one folder a type, with metadata."""
    if queries.isEmpty():
        raise ValueError("no queries")
    rows = encoded(queries.where(text.filled("query")), "query", name, "text")
    safe = F.regexp_replace("query_type", "[/ ]", "_")
    rows.withColumn("type", safe).write.mode("overwrite").partitionBy("type").parquet(f"{out}/queries")
    summary = queries.where(text.filled("query")).groupBy("query_type").agg(F.count("*").alias("num_queries")).withColumn("output_file", F.concat(F.lit(f"{out}/queries/type="), safe))
    writers.report_json(summary, f"{out}/metadata", dataset=about, model=name)
    return summary


def hashed_texts(dim: int = 16) -> Encoder:
    """An encoder for tests and dry runs: vectors made of the words alone, nothing for blank values."""

    def make() -> Callable:
        import zlib

        import numpy as np

        def one(value):
            if value is None or not str(value).strip():
                return None
            v = np.zeros(dim)
            for w in str(value).lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1.0
            return v / np.linalg.norm(v)

        return lambda values: [one(v) for v in values]

    return Encoder(make, make, dim, unreadable="drop")


register("hashed", hashed_texts())


def caption_entries(spark: SparkSession, captions: str, audio: str) -> DataFrame:
    """clip_id, captions, audio (the path, null without a file) of a caption file and a folder of audio."""
    clips = readers.caption_csv(spark, captions)
    files = readers.audio_files(spark, audio, "*").select("clip_id", "path").groupBy("clip_id").agg(F.min("path").alias("audio"))
    return clips.select("clip_id", "captions").join(files, "clip_id", "left")
