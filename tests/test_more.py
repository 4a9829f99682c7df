"""Projection heads, training entries, token archives and the command line."""

from __future__ import annotations

import numpy as np
import pytest

from tonewell import sources
from tonewell.__main__ import main
from tonewell.operators.project import Layer, mean_pool, project


def test_projection(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0])], "id int, v array<float>")
    rows = {r.id: r.v for r in project(df, "v", [Layer(np.eye(2), np.array([0.0, 0.0]), activation="relu")]).collect()}
    assert rows[1] == pytest.approx([0.6, 0.8]) and rows[2] is None and rows[3] is None
    x = np.array([[1.0, 2.0, 4.0]])
    assert Layer(np.eye(3), norm=True)(x).mean() == pytest.approx(0.0)
    with pytest.raises(ValueError):
        Layer(np.eye(3), activation="no")(x)


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 1.0]], [0])], "k int, t array<array<double>>, m array<int>")
    rows = {r.k: r.vec for r in mean_pool(df, "k", "t", "m").collect()}
    assert rows[1] == [2.0, 3.0] and rows[2] == [0.0, 0.0]


def test_entries_and_archives(spark):
    c = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "clip_id string, captions array<string>")
    f = spark.createDataFrame([("p/a.wav",), ("q/a.wav",)], "path string")
    assert sorted((r.caption_key, r.audio_path) for r in sources.training_entries(c, f).collect()) == [("a_caption_00", "p/a.wav"), ("a_caption_01", "p/a.wav")]
    assert [r.caption for r in sources.one_caption(c, 2).collect()] == ["y"]
    with pytest.raises(ValueError):
        sources.one_caption(c, 6)
    t = spark.createDataFrame([("a", "d/z.npz"), ("z", "c/y.npz")], "clip_id string, path string")
    assert {r.alias: r.path for r in sources.token_archives(t).collect()} == {"a": "d/z.npz", "z": "c/y.npz", "a_z": "d/z.npz", "y": "c/y.npz", "z_y": "c/y.npz"}


def test_command_line(spark, tmp_path, capsys):
    assert main(["query"]) == 0 and "baseline_t2a_metrics" in capsys.readouterr().out
    (tmp_path / "c.csv").write_text("file,caption_1,caption_2\na.wav,Rain falls.,Wind\n")
    main(["generate", str(tmp_path / "c.csv"), "--types", "question", "--out", str(tmp_path / "q")], spark)
    assert sorted(r["query"] for r in spark.read.json(str(tmp_path / "q")).collect()) == ["Can you find audio of Rain falls?", "Can you find audio of Wind?"]
    vectors = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0])], "id long, clip long, vec array<double>")
    vectors.write.parquet(str(tmp_path / "v"))
    main(["evaluate", str(tmp_path / "v"), str(tmp_path / "v"), "--tasks", "t2a", "--out", str(tmp_path / "m")], spark)
    assert spark.read.json(str(tmp_path / "m")).first().r_at_1 == 100.0
    main(["mine", str(tmp_path / "v"), str(tmp_path / "v"), "--out", str(tmp_path / "n")], spark)
    assert spark.read.json(str(tmp_path / "n")).count() == 2
