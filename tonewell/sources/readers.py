"""Readers: each gives one tidy table, whatever the file looks like.

Schemas are stated, not inferred, wherever the format fixes them. Order of rows in a file matters for some
formats ("last one wins"); it is carried as `pos`, made from the file and the place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip_of_key, squash, stem
from ..operators.splits import numbered

__all__ = [
    "alias", "audio_files", "blacklist", "caption_csv", "captions_long", "captions_wide", "encode_rows", "hard_negative_captions", "intent_queries_flat",
    "intent_queries_grouped", "keyed_vectors", "manifest_json", "mecat", "negative_queries", "neighbour_records", "one_caption", "ratings", "resolved_clips", "sample_manifest", "skip_list", "split_entries", "start_name", "token_archives", "token_archives_by_text", "training_entries", "vector_bundle",
]


# The field names that the functions below look for are those of the files in use.


def alias(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and not blank."""
    there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _placed(df: DataFrame) -> DataFrame:
    """A scan with pos, which follows the names of the files and the order of rows in them.

    Spark packs pieces of files into tasks by size, so the counter of a task alone would not tell the order: the file and
    the place of the piece in it come first.
    """
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", pos.alias("pos"))


def caption_csv(spark: SparkSession, path: str, text_field: str | None = None, query_field: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """A caption file of either layout, told by its header; neither is an error, and so is a file without any clip.

    `text_field` (wide layout) names the one column that is a clip's only caption; `query_field` the one that is its query
    besides the captions (query_text); both at once, or one that is not there, are errors. Rows whose text or query is blank
    are dropped. With `files` (path), clips without an audio file are dropped as well.
    """
    if text_field and query_field:
        raise ValueError("text_field and query_field exclude each other")
    df = _csv(spark, path)
    for name in (text_field, query_field):
        if name and name not in df.columns:
            raise ValueError(f"no column {name!r} in {df.columns}")
    if "file_name" in df.columns or "file" in df.columns:
        out = captions_wide(spark, path)
        if text_field or query_field:
            name = alias(df, "file_name", "file")
            asked = df.select(name.alias("file"), F.trim(F.col(text_field or query_field)).alias("_t")).where(F.coalesce("_t", F.lit("")) != "").dropDuplicates(["file"])
            out = out.join(asked, "file")
            out = out.withColumn("captions", F.array("_t")).drop("_t") if text_field else out.withColumnRenamed("_t", "query_text")
    elif "audiocap_id" in df.columns:
        out = captions_long(spark, path)
    else:
        raise ValueError(f"no known caption layout in {df.columns}")
    if files is not None:
        name = F.col("clip_id") if "file" not in out.columns else stem("file")
        there = files.select(stem("path").alias("_stem")).distinct()
        out = out.join(there, name == F.col("_stem"), "left_semi")
    if out.isEmpty():
        raise ValueError("no clips: check the file and the folder of audio")
    return out


def captions_wide(spark: SparkSession, path: str, number: int = 5) -> DataFrame:
    """clip_id, file, captions: one row per file, its captions trimmed, blank ones dropped, order kept."""
    df = _csv(spark, path)
    name = alias(df, "file_name", "file")
    texts = F.array(*[F.trim(F.col(f"caption_{i}")) for i in range(1, number + 1) if f"caption_{i}" in df.columns])
    return df.select(stem(name).alias("clip_id"), name.alias("file"), F.filter(texts, lambda c: c.isNotNull() & (c != "")).alias("captions")).where(F.col("file").isNotNull())


def captions_long(spark: SparkSession, path: str) -> DataFrame:
    """clip_id (`{youtube_id}_{start}`), audiocap_id, captions: rows of a clip together, in file order."""
    df = _placed(_csv(spark, path))
    rows = df.where(F.coalesce(F.trim("caption"), F.lit("")) != "").withColumn("start", F.col("start_time").try_cast("double").cast("bigint"))
    item = F.struct("pos", F.trim("caption").alias("c"))
    made = rows.groupBy("youtube_id", "start").agg(F.min_by(F.nullif("audiocap_id", F.lit("")), "pos").alias("audiocap_id"), F.array_sort(F.collect_list(item)).alias("items"))
    return made.select(F.concat_ws("_", "youtube_id", F.col("start").cast("string")).alias("clip_id"), "audiocap_id", F.transform("items", lambda i: i["c"]).alias("captions"))


def split_entries(captions: DataFrame, dataset: str, split: str, order: str) -> DataFrame:
    """captions with entry_id `{dataset}_{split}_{index:04d}`, the index by `order` from 0."""
    rows = numbered(captions, order, name="_n")
    return rows.withColumn("entry_id", F.format_string(f"{dataset}_{split}_%04d", F.col("_n"))).drop("_n")


def resolved_clips(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """clip_id, audiocap_id, captions, audio_path of a long caption file: the first file name in use that is there, else null.

    Tried in this order: the id of the clip, its composite name, and the name with whole seconds; `files` has path.
    """
    clips = captions_long(spark, path)
    names = F.filter(F.array("audiocap_id", "clip_id", F.concat(F.lit("Y"), "clip_id")), lambda n: n.isNotNull())
    there = files.select(stem("path").alias("_v"), "path").groupBy("_v").agg(F.min("path").alias("path"))
    tried = clips.select("clip_id", F.posexplode(names).alias("_p", "_v")).join(there, "_v").groupBy("clip_id").agg(F.min_by("path", "_p").alias("audio_path"))
    return clips.join(tried, "clip_id", "left")


def start_name(start: Column) -> Column:
    """A start time as file names have it: whole seconds, halves to the even one."""
    return F.bround(start.try_cast("double"), 0).cast("bigint").cast("string")


def one_caption(captions: DataFrame, index: int = 1) -> DataFrame:
    """clip_id, caption: the caption with that number (1 to 5) of each clip that has it."""
    if not 1 <= index <= 5:
        raise ValueError(f"caption index {index}")
    return captions.select("clip_id", F.try_element_at("captions", F.lit(index)).alias("caption")).where(F.col("caption").isNotNull())


def training_entries(captions: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """clip_id, caption, caption_key, audio_path: one row per caption of the clips that have an audio file.

    Captions are numbered before clips without a file are dropped.
    """
    rows = captions.select("clip_id", F.posexplode("captions").alias("n", "caption")).withColumn("caption_key", F.format_string("%s_caption_%02d", "clip_id", "n"))
    there = files.select(stem(path).alias("clip_id"), F.col(path).alias("audio_path")).groupBy("clip_id").agg(F.min("audio_path").alias("audio_path"))
    return rows.join(there, "clip_id").select("clip_id", "caption", "caption_key", "audio_path")


def token_archives(df: DataFrame, clip: str = "clip_id", path: str = "path") -> DataFrame:
    """alias, and the columns of each archive under every name it answers to: clip id, path stem, and both joined.

    A name that several archives answer to belongs to the first by path.
    """
    names = F.array_distinct(F.filter(F.array(F.col(clip), stem(path), F.concat_ws("_", clip, stem(path))), lambda n: n.isNotNull()))
    rows = df.select(F.explode(names).alias("alias"), F.struct(*df.columns).alias("_r"))
    first = rows.groupBy("alias").agg(F.min_by("_r", F.col(f"_r.{path}")).alias("_r"))
    return first.select("alias", *[F.col("_r")[c].alias(c) for c in df.columns])


def token_archives_by_text(df: DataFrame, text: str = "caption", path: str = "path") -> DataFrame:
    """text_key, paths and first: the archives of each caption text, in the order of paths; case and runs of spaces do not matter."""
    rows = df.select(squash(text).alias("text_key"), F.col(path).alias("_path")).where("text_key <> ''")
    return rows.groupBy("text_key").agg(F.array_sort(F.collect_set("_path")).alias("paths"), F.min("_path").alias("first"))


def mecat(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, captions of a folder of JSON files; the text `none` is no caption."""
    df = spark.read.schema("short array<string>").option("multiLine", True).json(folder).withColumn("clip_id", stem(F.input_file_name()))
    kept = F.filter(F.transform("short", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "") & (F.lower(c) != "none"))
    return df.select("clip_id", kept.alias("captions"))


def intent_queries_grouped(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, bucket, query of grouped query files; the last record of a clip and bucket wins."""
    df = _placed(spark.read.json(path)).withColumn("u", F.explode("uiq"))
    last = df.select("clip_id", F.col("u.bucket").alias("bucket"), F.col("u.query").alias("query"), "pos").where(F.coalesce(F.trim("query"), F.lit("")) != "")
    return last.groupBy("bucket", "clip_id").agg(F.max_by("query", "pos").alias("query"))


def intent_queries_flat(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, query, query_type of flat query files under any of the field names in use; type `generic` if missing."""
    df = spark.read.json(path)
    kind = F.coalesce(F.lower(alias(df, "query_type", "type")), F.lit("generic"))
    made = df.select(alias(df, "audio_id", "clip_id", "target_audio", "negative_audio").alias("clip_id"), alias(df, "generated_query", "query", "imperative_query", "negative_query").alias("query"), kind.alias("query_type"))
    return made.where(F.col("clip_id").isNotNull() & F.col("query").isNotNull())


def negative_queries(spark: SparkSession, path: str) -> DataFrame:
    """target_audio, negative_audio, query; rows without target or query are dropped."""
    df = spark.read.json(path)
    made = df.select(alias(df, "target_audio", "clip_id").alias("target_audio"), alias(df, "negative_audio").alias("negative_audio"), alias(df, "negative_query", "query").alias("query"))
    return made.where(F.col("target_audio").isNotNull() & F.col("query").isNotNull())


def hard_negative_captions(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, hard_negative_caption: a direct caption, else the first of the neighbours' captions; the last record wins."""
    df = _placed(spark.read.json(path))
    clip = alias(df, "audio_id", "clip_id", "target_audio")
    direct = alias(df, "hard_negative_caption", "negative_caption")
    lists = [c for c in ("hard_negatives", "neighbors", "negatives") if c in df.columns and "struct" in dict(df.dtypes)[c]]
    found = direct
    for c in lists:
        fields = {f.name for f in df.schema[c].dataType.elementType.fields}
        if "captions" in fields:
            texts = F.filter(F.flatten(F.transform(F.coalesce(F.col(c), F.array()), lambda n: F.coalesce(n["captions"], F.array().cast("array<string>")))), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
            found = F.coalesce(found, F.trim(F.try_element_at(texts, F.lit(1))))
    made = df.select(clip.alias("clip_id"), found.alias("caption"), "pos").where(F.col("clip_id").isNotNull() & F.col("caption").isNotNull())
    return made.groupBy("clip_id").agg(F.max_by("caption", "pos").alias("hard_negative_caption"))


def neighbour_records(spark: SparkSession, path: str) -> DataFrame:
    """id, other, score, pos of neighbour files with one record per anchor."""
    df = spark.read.json(path)
    return df.select(F.col("audio_id").alias("id"), F.posexplode("neighbors").alias("p", "n")).select("id", F.col("n.audio_id").alias("other"), F.col("n.score").cast("double").alias("score"), (F.col("p") + 1).alias("pos"))


def vector_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A vector bundle kept as parquet: idx, embedding and what belongs to each row. NPZ files go through npz_to_parquet."""
    return spark.read.parquet(path)


def keyed_vectors(df: DataFrame, key: str = "key") -> DataFrame:
    """With clip_id from archive keys `dataset/id_seg0`."""
    return df.withColumn("clip_id", clip_of_key(key))


def manifest_json(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, caption, duration, source, relative path of metadata files, found in all folders below."""
    schema = "data array<struct<id string, caption string, duration double, source string, relative_audio_path string>>"
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    rows = df.select(F.input_file_name().alias("f"), F.explode("data").alias("d"))
    source = F.coalesce(F.nullif("d.source", F.lit("")), stem("f"))
    return rows.select(F.concat_ws("_", source, stem(F.col("d.id"))).alias("clip_id"), F.trim("d.caption").alias("caption"), F.col("d.duration").alias("duration"), source.alias("source"), F.col("d.relative_audio_path").alias("audio_relpath")).where(F.col("caption") != "")


def skip_list(spark: SparkSession, path: str) -> DataFrame:
    """clip_id of a text file with one id a line; blank lines and # comments do not count."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("clip_id")).where("clip_id <> ''").distinct()


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    """a, b (a <= b) of a file with unordered pairs."""
    df = spark.read.schema("pairs array<struct<audio_a string, audio_b string>>").option("multiLine", True).json(path)
    pairs = df.select(F.explode("pairs").alias("p")).select(stem("p.audio_a").alias("x"), stem("p.audio_b").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """audio, text, score in 0..1 of a rating file on a scale to 10; scores that are no number are dropped."""
    df = _csv(spark, path)
    score = alias(df, "average_score", "score", "rating").try_cast("double")
    made = df.select(alias(df, "wav_file_name", "audio", "audio_path").alias("audio"), alias(df, "text", "caption").alias("text"), F.when(score.isNotNull(), F.least(F.greatest(score / 10.0, F.lit(0.0)), F.lit(1.0))).alias("score"))
    return made.where(F.col("score").isNotNull())


def sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file and its first caption of a JSONL manifest."""
    return spark.read.schema("file string, captions array<string>").json(path).select("file", F.try_element_at("captions", F.lit(1)).alias("caption"))


def audio_files(spark: SparkSession, folder: str, suffix: str = "*.wav") -> DataFrame:
    """path, clip_id, content of audio files; decoding belongs to the encoder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder)
    return df.select("path", stem("path").alias("clip_id"), "content")


def encode_rows(df: DataFrame, value: str, encoder, dim: int, unreadable: str = "null", silence=None) -> DataFrame:
    """`df` with embedding, by an encoder that maps a list of values to an array of `dim` columns.

    The encoder is made once per task by calling `encoder()`; Arrow batches are its batches. For values it cannot encode (it
    returns None for a row) `unreadable` says what happens: the embedding is `null`, the row is dropped (`drop`: what is left
    keeps its columns, so texts beside it stay aligned), the value `silence` is encoded in its place (`silence`), or the
    run fails (`raise`).
    """
    if unreadable not in ("null", "drop", "silence", "raise"):
        raise ValueError(unreadable)
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for batch in batches:
            rows = list(encode(batch[value].tolist()))
            bad = [i for i, r in enumerate(rows) if r is None]
            if bad and unreadable == "raise":
                raise ValueError(f"{len(bad)} values that cannot be encoded, the first is {batch[value].iloc[bad[0]]!r}")
            if bad and unreadable == "silence":
                for i, r in zip(bad, encode([silence] * len(bad))):
                    rows[i] = r
            batch["embedding"] = [None if r is None else np.asarray(r, np.float32)[:dim] for r in rows]
            yield batch[batch["embedding"].notna()] if unreadable == "drop" else batch

    return df.mapInPandas(make, schema)
