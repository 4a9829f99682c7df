"""Readers and writers on small files, and the stream of metrics."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tonewell import sources
from tonewell.plans.evaluation import EvaluationConfig, evaluate, hard_negatives
from tonewell.streaming.monitor import start, windowed_metrics


def write(path, content):
    path.write_text(content if isinstance(content, str) else "\n".join(json.dumps(x) for x in content), encoding="utf-8")
    return str(path)


def test_caption_layouts(spark, tmp_path):
    wide = write(tmp_path / "wide.csv", 'file,caption_1,caption_2\nx/a.b.wav," one ",\nc.wav,"two, ""quoted""",three\n')
    rows = {r.clip_id: r.captions for r in sources.caption_csv(spark, wide).collect()}
    assert rows == {"a.b": ["one"], "c": ['two, "quoted"', "three"]}
    long = write(tmp_path / "long.csv", "audiocap_id,youtube_id,start_time,caption\n1,yy,30,late\n2,yy,30.0,later\n,zz,5,only\n4,zz,5, \n")
    rows = {r.clip_id: (r.audiocap_id, r.captions) for r in sources.caption_csv(spark, long).collect()}
    assert rows == {"yy_30": ("1", ["late", "later"]), "zz_5": (None, ["only"])}
    try:
        sources.caption_csv(spark, write(tmp_path / "bad.csv", "x,y\n1,2\n"))
        raise AssertionError
    except ValueError:
        pass


def test_query_files(spark, tmp_path):
    grouped = write(tmp_path / "g.jsonl", [{"clip_id": "a", "uiq": [{"bucket": "B", "query": "first"}]}, {"clip_id": "a", "uiq": [{"bucket": "B", "query": "last"}, {"bucket": "C", "query": " "}]}])
    assert [(r.bucket, r.query) for r in sources.intent_queries_grouped(spark, grouped).collect()] == [("B", "last")]
    flat = write(tmp_path / "f.jsonl", [{"audio_id": "a", "generated_query": "q", "query_type": " Question "}, {"audio_id": "", "clip_id": "b", "query": "r"}, {"clip_id": "c", "query": ""}])
    assert sorted((r.clip_id, r.query, r.query_type) for r in sources.intent_queries_flat(spark, flat).collect()) == [("a", "q", "question"), ("b", "r", "generic")]
    negative = write(tmp_path / "n.jsonl", [{"target_audio": "a", "negative_audio": "b", "negative_query": "not b"}, {"target_audio": "a", "query": ""}])
    assert sources.negative_queries(spark, negative).count() == 1
    hard = write(tmp_path / "h.jsonl", [{"audio_id": "a", "hard_negatives": [{"captions": ["", "x"]}]}, {"audio_id": "a", "hard_negatives": [{"captions": ["y"]}]}, {"audio_id": "b", "hard_negative_caption": "z"}])
    assert {r.clip_id: r.hard_negative_caption for r in sources.hard_negative_captions(spark, hard).collect()} == {"a": "y", "b": "z"}


def test_manifests_and_lists(spark, tmp_path):
    (tmp_path / "m" / "deep").mkdir(parents=True)
    write(tmp_path / "m" / "deep" / "S.json", json.dumps({"data": [{"id": "7.wav", "caption": " c ", "duration": 2.5}, {"id": "8", "caption": "", "duration": 1.0}]}))
    rows = sources.manifest_json(spark, str(tmp_path / "m")).collect()
    assert [(r.clip_id, r.caption, r.source) for r in rows] == [("S_7", "c", "S")]
    out = str(tmp_path / "out")
    sources.manifest_csv(sources.manifest_json(spark, str(tmp_path / "m")), out)
    sources.manifest_csv(spark.createDataFrame([], "clip_id string, audio_relpath string, caption string, source string, duration double"), out)
    assert spark.read.option("header", True).csv(out).first().duration == "2.500000"
    assert [r.clip_id for r in sources.skip_list(spark, write(tmp_path / "skip.txt", "# no\n a \n\na\n")).collect()] == ["a"]
    black = write(tmp_path / "b.json", json.dumps({"pairs": [{"audio_a": "z.wav", "audio_b": "p/a.wav"}, {"audio_a": "a", "audio_b": "z"}]}))
    assert [(r.a, r.b) for r in sources.blacklist(spark, black).collect()] == [("a", "z")]
    ratings = write(tmp_path / "r.csv", "wav_file_name,text,average_score\na.wav,t,7\nb.wav,u,none\nc.wav,v,12\n")
    assert sorted(r.score for r in sources.ratings(spark, ratings).collect()) == [0.7, 1.0]
    (tmp_path / "mecat").mkdir()
    write(tmp_path / "mecat" / "k.json", json.dumps({"short": ["None", " yes "]}))
    assert [(r.clip_id, r.captions) for r in sources.mecat(spark, str(tmp_path / "mecat")).collect()] == [("k", ["yes"])]


def test_vectors_round_trip(spark, tmp_path):
    np.savez(tmp_path / "v.npz", embeddings=np.eye(3, dtype=np.float32), clip_ids=np.array(["a", "b", "c"]))
    sources.npz_to_parquet(spark, tmp_path / "v.npz", str(tmp_path / "v"), batch=2)
    rows = sources.vector_bundle(spark, str(tmp_path / "v")).orderBy("idx").collect()
    assert [(r.idx, r.clip_ids) for r in rows] == [(0, "a"), (1, "b"), (2, "c")] and rows[1].embedding == [0.0, 1.0, 0.0]
    df = spark.createDataFrame([("aa",), ("b",), (None,)], "t string")
    made = sources.encode_rows(df, "t", lambda: lambda batch: [None if t is None else [len(t), 1] for t in batch], 2)
    assert sorted((r.t or "", r.embedding) for r in made.collect()) == [("", None), ("aa", [2.0, 1.0]), ("b", [1.0, 1.0])]


def test_diagnostics_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2], {"k": 1})], "id int, names array<string>, order array<int>, extra map<string,int>")
    sources.diagnostics_csv(df, str(tmp_path / "d"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "d")).first()
    assert (row.names, row.order, row.extra) == ("a | b", "1 2", '{"k":1}')
    sources.report_json(df.select("id"), str(tmp_path / "j"), model="m")
    assert spark.read.json(str(tmp_path / "j")).first().model == "m"
    sources.records_jsonl(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 1


def test_stream_equals_table(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 40} 00:{i % 60:02d}:00", f"t{i % 2}", i % 7 + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "ts string, task string, rank long").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("2024-03-01 00:00:00", "t0", 1)], "ts string, task string, rank long").withColumn("ts", F.to_timestamp("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in windowed_metrics(df).collect()}
    assert got and got <= want | {tuple(r) for r in windowed_metrics(late).collect()}


def test_whole_plans(spark):
    vectors = "id long, clip long, vec array<double>"
    c = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.8, 0.6]), (2, 1, [0.0, 1.0])], vectors)
    a = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], vectors)
    for mode in ("captionwise", "caption_avg", "caption_pool"):
        got = {r.task: r.r_at_1 for r in evaluate(c, a, EvaluationConfig(mode=mode)).collect()}
        assert got["t2a"] == 100.0 and got["a2t"] == 100.0
    assert hard_negatives(a, c, 5, 0.7, 5).count() == 2
