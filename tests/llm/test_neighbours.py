from __future__ import annotations

import itertools

import numpy as np
import pytest

from tonewell.llm import neighbours as N

SCHEMA = "vec_id long, bundle string, embedding array<float>, score string, rep long"


def table(spark, rows):
    return spark.createDataFrame([(i, b, None if v is None else [None if x is None else float(x) for x in v], "clash", -1) for i, b, v in rows], SCHEMA)


def brute(rows, k, least, dim):
    ok = [(i, b, np.asarray(v, np.float32).astype(float)) for i, b, v in rows if b is not None and v is not None and len(v) == dim and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, b, x in ok:
        found = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), j) for j, c, y in ok if c == b and j != i)[:k]
        out |= {(i, j, -c, r + 1) for r, (c, j) in enumerate(found) if -c >= least}
    return out


def got(df):
    return {(r.vec_id, r.other, r.cosine, r.rnk) for r in df.collect()}


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = N.hilbert_place(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
        assert set(steps) == {1}


def test_against_brute_force_with_dirty_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, "ab"[i % 2], centres[i % 30] + 0.25 * rng.standard_normal(16)) for i in range(600)]
    rows += [(1000 + i, "a", rows[0][2]) for i in range(9)]  # copies, more than k
    rows += [(1100, "a", rows[2][2] * 3.0), (1101, "b", rows[0][2])]  # scaled, and of the other bundle
    rows += [(1200, "a", None), (1201, "a", []), (1202, "a", [0.0] * 16), (1203, "a", [float("nan")] + [1.0] * 15), (1204, "a", [1.0] * 15), (1205, "a", [None] + [1.0] * 15), (1206, None, [1.0] * 16), (1207, "a", [float("inf")] + [1.0] * 15)]
    want = brute(rows, 5, 0.85, 16)
    have = got(N.similar_vectors(table(spark, rows), k=5, least=0.85, dim=16))
    assert len(want & have) >= 0.98 * len(want)
    near = {w[:3] for w in brute(rows, 1000, 0.85, 16)}
    assert {h[:3] for h in have} <= near


def test_hot_copies_stay_small(spark):
    rows = [(i, "a", [1.0, 2.0, 3.0, 4.0]) for i in range(3000)]
    df = N.similar_vectors(table(spark, rows), k=5, least=0.85, dim=4)
    assert df.count() == 3000 * 5
    first = {r.other for r in df.where("vec_id = 2999").collect()}
    assert first == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("rows", [[], [(1, "a", [1.0, 0.0])], [(1, "a", None)]])
def test_empty_and_lonely(spark, rows):
    assert N.similar_pairs(N.similar_vectors(table(spark, rows), dim=2)).count() == 0


def test_windows_longer_than_a_block(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 8))
    rows = [(2 * i, "a", v) for i, v in enumerate(base)] + [(2 * i + 1, "a", v + 0.001 * rng.standard_normal(8)) for i, v in enumerate(base)]
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs(N.similar_vectors(table(spark, rows), k=1, least=0.99, dim=8)).collect()}
    assert sum((2 * i, 2 * i + 1) in pairs for i in range(1500)) >= 1495


def test_crowds_of_rescaled_and_near_copies(spark):
    rng = np.random.default_rng(8)
    base, other = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, "a", base * s) for i, s in enumerate(rng.uniform(0.5, 3.0, 60))]  # one direction: equal cosines, smaller keys first
    rows += [(100 + i, "a", other + 0.003 * rng.standard_normal(16)) for i in range(60)]  # nearer than bytes can tell
    want = brute(rows, 5, 0.85, 16)
    assert got(N.similar_vectors(table(spark, rows), k=5, least=0.85, dim=16)) == want


def test_a_third_of_all_rows_in_one_crowd(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 512)  # six windows of crowded rows, so that they do not all meet
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 16))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + 0.03 * rng.standard_normal((2000, 16)) / 4  # cosines of 0.999
    rows = [(i, "a", v) for i, v in enumerate(x.astype(np.float32))]
    df = table(spark, rows)
    placed = N._placed(df.select("vec_id", "bundle", "embedding"), 1, 16).where("vec_id < 2000")
    assert placed.select("place", "finer").distinct().count() >= 1900
    have = {h[:2] for h in got(N.similar_vectors(df, k=5, least=0.85, dim=16))}
    u = x[:2000].astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.rint(u @ u.T * 1e6)
    np.fill_diagonal(c, -1)
    want = {(i, int(j)) for i, top in enumerate(np.argsort(-c, axis=1, kind="stable")[:, :5]) for j in top}
    assert len(want & have) >= 0.95 * len(want)


def test_copies_of_one_vector_and_equal_places_are_spread(spark, monkeypatch):
    """Half the rows are one vector, the rest lie in two bundles that are cut into many partitions."""
    monkeypatch.setattr(N, "COPIES", 7)
    monkeypatch.setattr(N, "WINDOW", 8)
    monkeypatch.setattr(N, "PARTITION_ROWS", 40)
    rng = np.random.default_rng(12)
    rows = [(i, "a", np.ones(8)) for i in range(150)] + [(200 + i, "ab"[i % 2], np.ones(8) + 0.3 * rng.standard_normal(8)) for i in range(300)] + [(600, "single", np.ones(8))]
    df = table(spark, rows)
    placed = N._placed(df.select("vec_id", "bundle", "embedding"), 2, 8, 8)
    assert placed.rdd.getNumPartitions() > 8
    assert placed.groupBy("bundle").agg({"vec_id": "count"}).count() == 3 and placed.select("vec_id").distinct().count() == len(rows)
    want, have = brute(rows, 5, 0.85, 8), got(N.similar_vectors(df, k=5, least=0.85, dim=8))
    assert {w for w in want if w[0] < 150} <= have and len(want & have) >= 0.95 * len(want)


def test_keys_of_partitions_sort_as_places_do():
    rng = np.random.default_rng(8)
    place, finer, ids = rng.integers(0, 1 << 56, 3000), rng.integers(0, 1 << 56, 3000), rng.integers(-(1 << 62), 1 << 62, 3000)
    place[1000:] = rng.integers(0, 700, 2000)  # equal places, and some whose lower byte is the only one that differs
    finer[2000:] = 256
    order = np.argsort(N._keys(place, finer, ids), kind="stable")
    assert order.tolist() == np.lexsort((ids, finer, place)).tolist()


def test_more_partitions_find_the_same(spark):
    """Rows of a partition are neighbours on the curve however many partitions there are."""
    rng = np.random.default_rng(11)
    x = (rng.standard_normal((1000, 16)).repeat(3, axis=0) + 0.2 * rng.standard_normal((3000, 16))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(score >= 0.851)) if i != j and (score[i] > score[i, j]).sum() <= 5}
    before, size = spark.conf.get("spark.sql.shuffle.partitions"), N.WINDOW
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    N.WINDOW = 32
    try:
        found = N.similar_vectors(table(spark, [(i, "a", v) for i, v in enumerate(x)]), k=5, least=0.85, dim=16)
        have = {(r.vec_id, r.other) for r in found.collect()}
    finally:
        N.WINDOW = size
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) > 4000 and len(want & have) >= 0.9 * len(want)
