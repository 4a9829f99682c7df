"""Rerankers, evaluation of all tasks, precomputing, writers by round trip, file order, and the grid of similarity."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell import session, sources
from tonewell.__main__ import main
from tonewell.functions import prompts, text
from tonewell.operators import matching, rerankers, similarity, splits, tokens
from tonewell.operators.project import Layer
from tonewell.plans import precompute, reranked
from tonewell.sources import readers, writers


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_file_slugs_follow_their_rule(spark):
    df = spark.createDataFrame([("_a b?",), ("??",), ("",), (None,), ("  Ünï-code.1_x ",), ("__",)], "t string")
    assert values(df.select(text.file_slug("t").alias("x"))) == ["a_b", "value", "value", "value", "Ünï-code.1_x", "value"]


def test_answers_in_three_ways(spark):
    df = spark.createDataFrame([("two, then ORDER: [3, 9] and one",), ("ORDER: none, but four",), ("SCORE: 0.4, not 7",)], "t string")
    got = {how: [r.x for r in df.select(text.parse_order("t", 4, how).alias("x")).collect()] for how in ("all", "first", "digits")}
    assert got["all"][0] == [2, 1, 0] and got["first"][0] == [2] and got["digits"][0] == [2]
    assert got["all"][1] == [3] and got["first"][1] == [3] and got["digits"][1] == []
    assert [round(df.select(text.parse_score("t", 0.0, how).alias("x")).collect()[2].x, 6) for how in ("marked", "last", "raw")] == [0.4, 1.0, 7.0]


@pytest.mark.parametrize(("n", "target", "how", "want"), [
    (350, 100, "pool", 117), (350, 100, "stride", 117), (350, 100, "hybrid", 175), (2000, 100, "pool", 100), (2000, 100, "hybrid", 100),
    (150, 100, "hybrid", 75), (150, 100, "pool", 150), (100, 100, "pool", 100), (7, 100, "hybrid", 7), (0, 10, "pool", 0),
])
def test_adaptive_lengths(spark, n, target, how, want):
    df = spark.createDataFrame([([[float(i), 1.0] for i in range(n)],)], "t array<array<double>>")
    assert df.select(F.size(tokens.adaptive("t", target, how)).alias("x")).first().x == want


def test_masked_maxsim_and_prepared(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]], [1, 0], [0, 1]), ([[1.0, 0.0]], [], [1], [])], "q array<array<double>>, d array<array<double>>, m array<int>, k array<int>")
    assert values(df.select(tokens.maxsim_masked("q", "d", "m", "k").alias("x"))) == [0.0, 0.0]
    assert values(df.select(tokens.maxsim_masked("q", "d").alias("x"))) == [1.0, 0.0]
    t = spark.createDataFrame([([[float(i), 1.0] for i in range(1, 11)],)], "t array<array<double>>")
    assert t.select(F.size(tokens.prepared("t", tokens.Reduction(2, 2, 0.5), False, prefix=2)).alias("x")).first().x == 2
    assert t.select(F.size(tokens.prepared("t", tokens.Reduction(2, 2, 0.5), True, prefix=2, most=6)).alias("x")).first().x == 1


def test_schedules_and_embeddings(spark):
    assert matching.linear_schedule(3, 0.1, 0.3) == pytest.approx([0.1, 0.2, 0.3]) and matching.linear_schedule(1) == [1e-3]
    got = spark.range(1).select(matching.time_embedding(F.lit(2.0), 5).alias("x")).first().x
    assert got == pytest.approx([np.sin(2), np.sin(2 * 1e-2), np.cos(2), np.cos(2 * 1e-2), 0.0])
    x = np.array([[1.0, -1.0]])
    assert Layer(np.eye(2), activation="gelu")(x)[0] == pytest.approx([0.8413447, -0.1586553]) and Layer(np.eye(2), residual=True)(x)[0] == pytest.approx([2.0, -2.0])
    assert Layer(np.eye(2), norm=True, scale=np.array([2.0, 2.0]), shift=np.array([1.0, 1.0]))(x)[0] == pytest.approx([3.0, -1.0], abs=1e-4)


def candidates(spark):
    rows = [(1, d, 1.0 - 0.1 * p, p, "Rain on a roof", f"clip_{d}.wav", None if d == 3 else f"Caption {d}") for p, d in enumerate((5, 3, 8, 2), 1)]
    return spark.createDataFrame(rows, "q long, d long, score double, pos int, query_text string, audio string, caption string")


def order(df):
    return [r.d for r in df.orderBy("new_pos").collect()]


def test_every_mode_with_every_client(spark):
    c = candidates(spark)
    build = lambda mode, client="mock", top_k=4, weight=1.0, **p: rerankers.build({"enabled": True, "mode": mode, "top_k": top_k, "weight": weight, "client": {"name": client, "params": p}})
    assert sorted(order(build("audio_native_pointwise")(c))) == [2, 3, 5, 8] and len(order(build("audio_native_pointwise", top_k=2)(c))) == 2 and len(order(build("audio_native_pointwise", top_k=0)(c))) == 4
    assert order(build("audio_native_pointwise")(c)) == order(build("audio_native_listwise")(c))
    made = {r.d: r.caption for r in build("caption_proxy_pointwise")(c).collect()}
    assert made[3] == "Mock description of audio clip 'clip 3'" and made[5] == "Caption 5"
    lists = spark.createDataFrame([(1, "ORDER: [4, 2]")], "q long, answer string")
    assert order(build("audio_native_listwise", "answers", lists=lists)(c)) == [2, 3, 5, 8]
    assert order(build("caption_proxy_listwise", "answers", lists=lists.where("false"))(c)) == [5, 3, 8, 2]
    answers = spark.createDataFrame([(1, 8, "Score: 0.9"), (1, 2, "0.95 I think")], "q long, d long, answer string")
    assert order(build("audio_native_pointwise", "answers", answers=answers, default=0.1)(c)) == [2, 8, 5, 3]
    vectors = spark.createDataFrame([("rain  ON a roof", [1.0, 0.0]), ("Caption 8", [1.0, 0.1]), ("caption 2", [-1.0, 0.0])], "text string, vec array<double>")
    assert order(build("caption_proxy_pointwise", "text_embedding_caption", vectors=vectors)(c)) == [8, 5, 3, 2]
    cosines = spark.createDataFrame([(1, 2, 1.0), (1, 3, -1.0)], "q long, d long, cosine double")
    assert order(build("audio_native_pointwise", "alignment", cosines=cosines)(c))[0] == 2
    t = c.withColumn("query_tokens", F.array(F.array(F.lit(1.0), F.lit(0.0)))).withColumn("candidate_tokens", F.when(F.col("d") != 3, F.array(F.array(F.col("d") / 10.0, F.lit(0.0)))))
    assert order(build("late_interaction", "late_interaction")(t)) == [3, 8, 5, 2]
    assert order(build("late_interaction", "late_interaction")(t.withColumn("query_tokens", F.lit(None).cast("array<array<double>>")))) == [5, 3, 8, 2]
    d = c.withColumn("denoised", F.when(F.col("d") != 5, F.col("d").cast("double"))).withColumn("contrastive", F.lit(0.0))
    assert order(build("diffusion", "diffusion")(d)) == [8, 3, 2]
    for bad in ({"enabled": True}, {"enabled": True, "mode": "other"}, {"enabled": True, "mode": "diffusion", "client": {"name": "other"}}):
        with pytest.raises(ValueError):
            rerankers.build(bad)
    assert rerankers.build({"enabled": False, "mode": "diffusion"}) is None and build("diffusion", "diffusion").name == "diffusion_diffusion"
    with pytest.raises(ValueError):
        build("audio_native_pointwise", "text_embedding_caption", vectors=vectors)(c)


def test_hits_and_missing_targets(spark):
    """Two clips of two captions; the first stage keeps one candidate, so targets can be missing."""
    e = [[1.0, 0.0], [0.0, 1.0]]
    captions = spark.createDataFrame([(0, 0, e[0]), (1, 0, e[1]), (10, 1, e[1]), (11, 1, e[1])], "id long, clip long, vec array<double>")
    items = spark.createDataFrame([(0, 0, e[0]), (1, 1, e[1])], "id long, clip long, vec array<double>")
    build = rerankers.build({"enabled": True, "mode": "audio_native_pointwise", "top_k": 1})
    shown = lambda task, c: c.withColumn("query_text", F.lit("q")).withColumn("audio", F.col("d").cast("string")).withColumn("caption", F.lit("c"))
    rows = reranked.all_details(captions, items, build, enrich=shown)
    got = {(r.task, r.q): (r.baseline_rank, r.reranked_rank, r.hit, r.target_missing) for r in rows.collect()}
    assert got["t2a", 0] == (1, 1, True, False) and got["t2a", 1] == (2, 2, False, True) and got["t2a", 10] == (1, 1, True, False)
    assert got["a2t", 0] == (1, 1, True, False) and got["a2t", 1] == (1, 1, False, True)  # caption 1 ties and has the smaller id
    assert got["t2t", 0] == (1, 1, True, False) and got["t2t", 10][0] == 1
    (summary,) = [r for r in reranked.summary(rows, "mock", 1).collect() if r.task == "t2a"]
    assert (summary.num_calls, summary.hits_within_top_k, summary.hit_rate_within_top_k, summary.mode_histogram) == (4, 3, 0.75, {"audio_native_pointwise": 4})
    diagnostics = reranked.diagnostics(rows, dataset="x", top_k=1)
    assert diagnostics.columns == reranked.DIAGNOSTICS and len(diagnostics.columns) == 35


def test_small_gallery_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GALLERY_GROUP", 64)
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 4)))], "id long, vec array<double>")
    g = q.where("id < 5")
    nq, ng = similarity._groups(q, g)
    assert ng == 1 and nq * ng >= spark.sparkContext.defaultParallelism
    clips = q.where("id < 300").withColumn("clip", F.when(F.col("id") < 250, 0).otherwise(F.col("id")))  # one clip has most captions
    x = np.array([r.vec for r in q.orderBy("id").collect()])
    best: dict = {}
    got = {(r.id, r.clip): r.pos for r in similarity.top_clips(q.where("id < 20"), clips, 3, exclude_self=True).collect()}
    for i in range(20):
        best = {}
        for j in range(300):
            if j != i:
                c = 0 if j < 250 else j
                best[c] = max(best.get(c, -9), round(float(x[i] @ x[j]), 12))
        assert [c for c, p in sorted(((c, p) for (k, c), p in got.items() if k == i), key=lambda y: y[1])] == sorted(best, key=lambda c: -best[c])[:3]


def test_numbering_needs_no_single_task(spark):
    df = spark.createDataFrame([(x, x % 3) for x in np.random.default_rng(2).permutation(500).tolist()], "k long, n long")
    rows = splits.numbered(df, "k", name="at").collect()
    assert sorted((r.k, r.at) for r in rows) == [(i, i) for i in range(500)]
    assert splits.numbered(df.where("false"), "k").count() == 0


def test_last_wins_by_file_order(spark, tmp_path):
    """The file with the later name wins, though it is longer and Spark reads it first."""
    line = lambda q, pad="": json.dumps({"clip_id": "c", "uiq": [{"bucket": "Pragmatic", "query": q}], "pad": pad})
    (tmp_path / "a.json").write_text(line("first"))
    (tmp_path / "b.json").write_text(line("middle", "x" * 5000) + "\n" + line("LAST") + "\n" + json.dumps({"clip_id": "d", "uiq": [{"bucket": "Pragmatic", "query": "only"}], "pad": "y" * 5000}))
    got = {r.clip_id: r.query for r in readers.intent_queries_grouped(spark, str(tmp_path)).collect()}
    assert got == {"c": "LAST", "d": "only"}


def test_caption_csv_options(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("file_name,caption_1,caption_2,asked\na.wav,one,two,what\nb.wav,three,,\n")
    files = spark.createDataFrame([("/audio/a.wav",)], "path string")
    one = readers.caption_csv(spark, str(path), text_field="asked").collect()
    assert [(r.clip_id, r.captions) for r in one] == [("a", ["what"])]
    two = readers.caption_csv(spark, str(path), query_field="asked").collect()
    assert [(r.clip_id, r.captions, r.query_text) for r in two] == [("a", ["one", "two"], "what")]
    assert [r.clip_id for r in readers.caption_csv(spark, str(path), files=files).collect()] == ["a"]
    for options in ({"text_field": "asked", "query_field": "asked"}, {"text_field": "none"}, {"files": files.where("false")}):
        with pytest.raises(ValueError):
            readers.caption_csv(spark, str(path), **options)


def test_start_names_and_resolved_clips(spark, tmp_path):
    df = spark.createDataFrame([("30.5",), ("31.5",), ("2",), ("x",)], "t string")
    assert values(df.select(readers.start_name(F.col("t")).alias("x"))) == ["30", "32", "2", None]
    path = tmp_path / "long.csv"
    path.write_text("audiocap_id,youtube_id,start_time,caption\n7,abc,30,one\n8,def,10,two\n9,ghi,1,three\n")
    files = spark.createDataFrame([("/a/abc_30.wav",), ("/a/7.wav",), ("/a/Ydef_10.wav",)], "path string")
    assert {r.clip_id: r.audio_path for r in readers.resolved_clips(spark, str(path), files).collect()} == {"abc_30": "/a/7.wav", "def_10": "/a/Ydef_10.wav", "ghi_1": None}


def test_archives_by_text(spark):
    df = spark.createDataFrame([("A  dog", "b.npz"), ("a dog ", "a.npz"), (None, "c.npz"), (" ", "d.npz")], "caption string, path string")
    assert [(r.text_key, r.paths, r.first) for r in readers.token_archives_by_text(df).collect()] == [("a dog", ["a.npz", "b.npz"], "a.npz")]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", [float(i), 0.5]) for i in range(25)] + [("none", None)], "clip_id string, embedding array<float>").repartition(3)
    done = writers.vectors_npz(df, str(tmp_path / "npz")).collect()
    assert sum(r.rows for r in done) == 25 and all(Path(r.path).exists() for r in done) and not list((tmp_path / "npz").glob(".part*"))
    writers.npz_to_parquet(spark, [r.path for r in done], str(tmp_path / "back"))
    back = {r.clip_id: list(r.embedding) for r in spark.read.parquet(str(tmp_path / "back")).collect()}
    assert back == {f"c{i}": [float(i), 0.5] for i in range(25)}


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("t2a", 4, 50.0), ("a2t", 2, None)], "task string, n long, r_at_1 double")
    writers.nested_report(m, "task", str(tmp_path / "r"), {"ks": [1]}, {"model": "x"})
    (line,) = [x for f in (tmp_path / "r").glob("part*") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"metrics": {"a2t": {"n": 2}, "t2a": {"n": 4, "r_at_1": 50.0}}, "config": {"ks": [1]}, "setup": {"model": "x"}}
    writers.records_json(m.coalesce(1), str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part*")
    assert sorted(json.loads(file.read_text()), key=lambda r: r["task"]) == [{"task": "a2t", "n": 2, "r_at_1": None}, {"task": "t2a", "n": 4, "r_at_1": 50.0}]
    new = spark.createDataFrame([("a2t", 7.5), ("t2t", 1.0)], "task string, r_at_1 double")
    assert {r.task: (r.n, r.r_at_1) for r in writers.refreshed(m, new, ["task"]).collect()} == {"t2a": (4, 50.0), "a2t": (2, 7.5), "t2t": (None, 1.0)}


def test_precompute(spark, tmp_path):
    entries = spark.createDataFrame([("b", ["rain falls", "dog"], "b.wav"), ("a", ["wind"], "a.wav"), ("c", ["sea"], None), ("d", ["x"], " ")], "clip_id string, captions array<string>, audio string")
    queries = spark.createDataFrame([("Pragmatic", "b", "find rain"), ("Pragmatic", "a", "find wind"), ("Pragmatic", "c", "no audio"), ("Other", "a", "x")], "bucket string, clip_id string, query string")
    made = {r.what: r.rows for r in precompute.dataset(entries, queries, "hashed", str(tmp_path / "o")).collect()}
    assert made["audio"] == 2 and made["captions"] == 5 and made["queries_pragmatic"] == 2 and made["queries_cross_domain"] == 0  # audio d cannot be read and is dropped
    assert [r.clip_id for r in spark.read.parquet(str(tmp_path / "o/queries_pragmatic")).collect()] == ["a", "b"]
    flat = spark.createDataFrame([("a", "find wind", "question"), ("b", "x", "a/b c"), ("c", " ", "question")], "clip_id string, query string, query_type string")
    assert {r.query_type: r.num_queries for r in precompute.queries_by_type(flat, "hashed", str(tmp_path / "q")).collect()} == {"question": 1, "a/b c": 1}
    assert spark.read.parquet(str(tmp_path / "q/queries/type=a_b_c")).count() == 1
    with pytest.raises(ValueError):
        precompute.encoder("unheard")


@pytest.mark.parametrize(("way", "want"), [("null", [1.0, None]), ("drop", [1.0]), ("silence", [1.0, 0.0]), ("raise", None)])
def test_unreadable_values(spark, way, want):
    def make():
        return lambda vs: [None if v == "bad" else [1.0 if v == "good" else 0.0] for v in vs]

    df = spark.createDataFrame([("good", 1), ("bad", 2)], "v string, k int").coalesce(1)
    out = readers.encode_rows(df, "v", make, 1, way, "quiet")
    if want is None:
        with pytest.raises(Exception, match="cannot be encoded"):
            out.collect()
    else:
        assert [None if r.embedding is None else r.embedding[0] for r in out.collect()] == want


def test_prompts_and_lists(spark):
    df = spark.createDataFrame([("Task", [("q1", "0.5"), ("q2", None)], "Question?"), ("Task", [], "Question?")], "t string, e array<struct<query string, answer string>>, q string")
    assert values(df.select(prompts.few_shot("t", "e", "q").alias("x"))) == ["Task\n\nExamples:\n- q1 => 0.5\n- q2 => \n\nQuestion?", "Task\n\nQuestion?"]
    rows = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("a", None, 5), ("b", " ", 1)], "k string, v string, o int")
    assert {r.k: r["values"] for r in prompts.first_seen(rows, "k", "v", "o").collect()} == {"a": ["x", "y"]}


def test_written_tables_are_deleted(spark):
    with session.scratch():
        df = session.written(spark.range(5).toDF("x"))
        path = session._WRITTEN[-1][1].removeprefix("file:")
        assert df.count() == 5 and Path(path).exists()
    assert not Path(path).exists()


def test_mining_stages_run_apart(spark, tmp_path):
    from tonewell.plans import evaluation

    rng = np.random.default_rng(3)
    unit = lambda n: [v.tolist() for v in (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 4)))]
    items = spark.createDataFrame([(i, v) for i, v in enumerate(unit(12))], "id long, vec array<double>")
    captions = spark.createDataFrame([(i, i // 2, v) for i, v in enumerate(unit(24))], "id long, clip long, vec array<double>")
    evaluation.mine_stage(items, str(tmp_path / "mined"), k=5)
    evaluation.filter_stage(str(tmp_path / "mined"), captions, str(tmp_path / "kept"), threshold=0.6, most=2)
    whole = {(r.id, r.other, r.pos) for r in evaluation.hard_negatives(items, captions, k=5, threshold=0.6, most=2).collect()}
    got = {(r.id, n.other, n.pos) for r in spark.read.json(str(tmp_path / "kept")).collect() for n in r.hard_negatives}
    assert got == whole and got


def test_command_line(spark, tmp_path, capsys):
    vectors = spark.createDataFrame([(i, i // 2, [float(i), 1.0]) for i in range(6)], "id long, clip long, vec array<double>")
    vectors.write.parquet(str(tmp_path / "c"))
    vectors.where("id % 2 = 0").selectExpr("clip as id", "clip", "vec").write.parquet(str(tmp_path / "i"))
    assert main(["rerank", str(tmp_path / "c"), str(tmp_path / "i"), "--topk", "2", "--tasks", "t2a", "--out", str(tmp_path / "r")], spark) == 0
    assert {r.stage for r in spark.read.json(str(tmp_path / "r")).collect()} == {"baseline", "reranked"}
    (tmp_path / "cap.csv").write_text("file_name,caption_1\na.wav,rain\nb.wav,sea\n")
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio/a.wav").write_bytes(b"RIFF")
    assert main(["precompute", str(tmp_path / "cap.csv"), str(tmp_path / "audio"), "--out", str(tmp_path / "p")], spark) == 0
    assert sources.vector_bundle(spark, str(tmp_path / "p/captions")).count() == 2 and spark.read.parquet(str(tmp_path / "p/audio")).count() == 1
