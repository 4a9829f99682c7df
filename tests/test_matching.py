from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd

from tonewell.operators import matching as M


def sets(spark, rows):
    return spark.createDataFrame(rows, "id long, terms array<string>")


def jaccard(x, y):
    x, y = set(x or []), set(y or [])
    return len(x & y) / len(x | y) if x | y else 0.0


def some(n, start=0, words=300, seed=1):
    """Lists of terms, frequent and rare ones, with repeated terms, empty lists and repeated lists."""
    r = random.Random(seed)
    made = [(start + i, [f"w{int(words * r.random() ** 3)}" for _ in range(r.randrange(0, 14))]) for i in range(n)]
    return made + [(start + n + i, made[i * 3][1]) for i in range(n // 5)]


def test_examples_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "POOL_BLOCK", 90)
    monkeypatch.setattr(M, "QUERY_BLOCK", 25)
    monkeypatch.setattr(M, "POOL_SLICE", 16)
    q, p = some(60, seed=2), some(400, 1000, seed=3)
    want = set()
    for i, x in q:
        best = sorted((-jaccard(x, y), j) for j, y in p)[:3]
        want |= {(i, j, -s, at + 1) for at, (s, j) in enumerate(best)}
    assert {tuple(r) for r in M.similar_examples(sets(spark, q), sets(spark, p), 3).collect()} == want
    few = M.similar_examples(sets(spark, q[:5]), sets(spark, p[:2]), 3)
    assert few.count() == 10
    assert M.similar_examples(sets(spark, q), sets(spark, []), 3).count() == 0


def test_examples_of_many_rows_take_little_time(spark):
    q, p = some(2000, seed=4), some(20_000, 10_000, seed=5)
    asked, pool = sets(spark, q), sets(spark, p)
    began = time.process_time(), time.time()
    assert M.similar_examples(asked, pool, 3).count() == 3 * len(q)
    assert time.time() - began[1] < 25


def test_prompts_of_many_queries_take_little_time(spark, tmp_path):
    from tonewell.plans import catalog

    q, p = some(1000, seed=6), some(20_000, 10_000, seed=7)
    spark.createDataFrame([(i * 100, " ".join(x)) for i, x in q], "query_id long, original_caption string").write.parquet(f"{tmp_path}/intent_queries.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in p], "record_id long, caption_1 string").write.parquet(f"{tmp_path}/captions.parquet")
    began = time.time()
    made = {r.a: r.prompt for r in catalog.queries()["few_shot_prompts"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 25
    texts = dict(p)
    for i, x in q[:5]:
        best = [j for s, j in sorted((-jaccard(x, y), j) for j, y in p)[:3] if s < 0]
        shown = [made[i * 100].find(" ".join(texts[j])) for j in best]
        assert min(shown, default=0) >= 0


def test_every_query_has_a_prompt(spark, tmp_path):
    """Also queries whose ids are not divisible by a hundred, equal ones, and those without examples."""
    from tonewell.plans import catalog

    q = [(1, "Rain falls softly"), (2, "a dog barks"), (57, "rain falls softly"), (100, "xylophone"), (101, None), (250, "")]
    p = [(9, "rain falls"), (7, "a dog barks twice"), (8, "Rain falls."), (6, None), (5, "softly")]
    spark.createDataFrame(q, "query_id long, original_caption string").write.parquet(f"{tmp_path}/intent_queries.parquet")
    spark.createDataFrame(p, "record_id long, caption_1 string").write.parquet(f"{tmp_path}/captions.parquet")
    made = {r.a: r.prompt for r in catalog.queries()["few_shot_prompts"](spark, str(tmp_path)).collect()}
    head, rain = "Rate how well the text fits.\n\n", "Examples:\n- Rain falls. => 0.667\n- rain falls => 0.667\n- softly => 0.333\n\n"
    assert made == {
        1: f"{head}{rain}Text: Rain falls softly", 2: f"{head}Examples:\n- a dog barks twice => 0.750\n\nText: a dog barks", 57: f"{head}{rain}Text: rain falls softly",
        100: f"{head}Text: xylophone", 101: f"{head}Text: ", 250: f"{head}Text: ",
    }


def test_rows_that_cannot_be_among_the_best_cost_little():
    """Captions of frequent and rare words: a pair costs far less than counting all its terms, and nothing is lost."""
    r = random.Random(8)

    def made(n):
        return [sorted({*r.sample(range(12), 6), *(12 + int(900 * r.random() ** 2) for _ in range(9))}) for _ in range(n)]

    q, p = made(2000) + [[], [0], [11, 911], list(range(300))], made(60_000) + [[], [3], list(range(10, 400))]
    asked, pool = (pd.Series([np.array(x, np.int64) * 7919 for x in rows]) for rows in (q, p))
    began = time.process_time()
    at, found, score = M._best_shared(asked, pool, 3)
    assert time.process_time() - began < 8
    for i in (0, 1, 1999, 2000, 2001, 2002, 2003):
        best = sorted((-jaccard(q[i], y), j) for j, y in enumerate(p))[:3]
        assert [(-s, j) for s, j in zip(score[at == i], found[at == i])] == best


def test_equal_sets_and_rare_terms_in_one_cell(monkeypatch):
    """Many equal queries and rows, terms of few rows, sets of all sizes, more slices and hits than are taken at once."""
    monkeypatch.setattr(M, "POOL_SLICE", 3000)
    monkeypatch.setattr(M, "FLAGS_AT_ONCE", 50)
    r = random.Random(10)

    def made(n):
        rows = [[*r.sample(range(8), r.randrange(8)), *r.sample(range(8, 60), r.choice((0, 1, 5, 40))), *{100 + int(4000 * r.random()) for _ in range(r.randrange(4))}] for _ in range(n)]
        return [*rows, *(list(reversed(rows[r.randrange(n // 9)])) for _ in range(n)), [], [], [7], list(range(300))]

    q, p = made(120), made(700)
    asked, pool = (pd.Series([np.array(x, np.int64) for x in rows]) for rows in (q, p))
    at, found, score = M._best_shared(asked, pool, 3)
    for i, x in enumerate(q):
        best = sorted((-jaccard(x, y), j) for j, y in enumerate(p))[:3]
        assert [(-s, j) for s, j in zip(score[at == i], found[at == i])] == best


def test_slices_carry_the_best_on(monkeypatch):
    """Many small slices, ties between them, and queries that share nothing with most rows."""
    monkeypatch.setattr(M, "POOL_SLICE", 64)
    r = random.Random(9)
    q = [[t for t in range(40) if r.random() < 0.2] for _ in range(150)] + [[], [99], [5]]
    p = [[t for t in range(40) if r.random() < r.choice((0.02, 0.2, 0.6))] for _ in range(500)]
    asked, pool = (pd.Series([np.array(x, np.int64) for x in rows]) for rows in (q, p))
    for k in (1, 3, 600):
        at, found, score = M._best_shared(asked, pool, k)
        for i, x in enumerate(q):
            best = sorted((-jaccard(x, y), j) for j, y in enumerate(p))[:k]
            assert [(-s, j) for s, j in zip(score[at == i], found[at == i])] == best


def near(n, start=0, seed=1):
    """Families of lists of terms that differ in a few terms, of all sizes, with equal lists and an empty one."""
    r = random.Random(seed)
    frames = [[f"w{r.randrange(60)}" for _ in range(r.choice((1, 2, 3, 4, 7, 12, 20, 45, 120)))] for _ in range(12)]
    made = [(start, [])]
    for i in range(1, n):
        base = list(random.Random(i % 12 + 7).choice(frames))
        for _ in range(r.randrange(3)):
            base[r.randrange(len(base))] = f"w{r.randrange(60 + 900 * (len(base) > 40))}"
        made.append((start + i, base))
    return made


def test_similar_sets_of_all_sizes_against_all_pairs(spark):
    q, p = near(150, seed=2), near(170, 1000, seed=3)
    for threshold in (0.3, 0.6, 0.85, 1.0):
        want = {(i, j, jaccard(x, y)) for i, x in q for j, y in p if x and y and jaccard(x, y) >= threshold}
        assert {tuple(r) for r in M.similar_sets(sets(spark, q), sets(spark, p), threshold).collect()} == want
        best = {}
        for i, j, s in sorted(want, key=lambda w: (w[0], -w[2], w[1])):
            best.setdefault(i, (i, j, s))
        assert {tuple(r) for r in M.best_similar(sets(spark, q), sets(spark, p), threshold).collect()} == set(best.values())


def test_one_rare_term_is_no_candidate(spark, monkeypatch):
    """Sets that have one rare term of the first ones in common and little else do not meet."""
    r = random.Random(5)
    rows = [(i, [f"r{i % 4}", *(f"w{x}" for x in r.sample(range(400), 16))]) for i in range(800)]
    exact = M.Fraction(0.85).limit_denominator(10_000)
    grams = M._grams(sets(spark, rows).select("id", "terms"), "id", "terms", M.np.zeros(M.CELLS, int), exact)
    other = grams.withColumnRenamed("id", "b")
    assert grams.join(other, "gram").where("id < b").select("id", "b").distinct().count() < 2000
