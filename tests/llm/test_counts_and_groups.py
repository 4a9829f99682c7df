"""Top items, term counts, overlaps, near-duplicates, components, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewell.llm import components, neardup, overlap, sets, terms, topn


def test_top_items(spark):
    rnd = random.Random(2)
    rows = [("hot", f"i{rnd.randint(0, 900):04d}", rnd.choice([rnd.random(), 0.5, -1.0, float("nan"), None])) for _ in range(6000)]
    rows += [(f"g{rnd.randint(0, 40)}", f"i{rnd.randint(0, 9)}", round(rnd.random(), 1)) for _ in range(1000)]
    rows += [("dup", "one", 0.9)] * 3000 + [("dup", f"x{i}", 0.1) for i in range(4)] + [(None, "a", 1.0), ("g1", None, 1.0), ("g1", "g1", 5.0), ("inf", "a", float("inf")), ("inf", "b", float("-inf")), ("inf", "c", 1e300), ("zero", "a", 0.0), ("zero", "b", -0.0)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "grp string, item string, sc double, b int, rnk string")
    best: dict = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s and g != i:
            best[g, i] = max(s, best.get((g, i), -float("inf")))
    want = set()
    for g in {k[0] for k in best}:
        for r, (s, i) in enumerate(sorted((-s, i) for (h, i), s in best.items() if h == g)[:5]):
            want.add((g, i, r + 1))
    got = {(r.grp, r.item, r.rnk) for r in topn.top_items(df, "grp", "item", "sc", 5).collect()}
    assert got == want
    assert topn.top_items(df.where("false"), "grp", "item", "sc", 5).count() == 0


def test_score_bins_keep_order(spark):
    values = [-float("inf"), -1e308, -3.0, -2.0, -1.0, -1e-300, -0.0, 0.0, 1e-310, 0.1, 0.11, 0.5, 1.0, 2.0, 1e308, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bins = [r.b for r in df.select("i", topn.score_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize(("longest", "held"), [(1, 200_000), (3, 200_000), (3, 7)])
def test_term_counts(spark, longest, held, monkeypatch):
    monkeypatch.setattr(terms, "HELD", held)
    rnd = random.Random(4)
    lists = [[[rnd.choice("aaab cde".split() + ["the", "the", "é"]) for _ in range(rnd.randint(0, 12))] for _ in range(rnd.randint(0, 4))] for _ in range(300)] + [None, [["x", None, "y"]], [[]], [None, ["the"]]]
    df = spark.createDataFrame([("f", t, 1) for t in lists] + [("other", [["the"]], 1)], "field_name string, lists array<array<string>>, records int")
    occ, rec = Counter(), {}
    for i, record in enumerate(lists):
        for t in record or []:
            t = [w for w in t or [] if w is not None]
            for n in range(1, longest + 1):
                for j in range(len(t) - n + 1):
                    g = " ".join(t[j : j + n])
                    occ[g] += 1
                    rec.setdefault(g, set()).add(i)
    rows = terms.term_counts(df, longest).collect()
    assert {(r.term, r.n, r.occurrences, r.records) for r in rows if r.field_name == "f"} == {(g, len(g.split()), occ[g], len(rec[g])) for g in occ}
    assert [(r.term, r.records) for r in rows if r.field_name == "other"] == [("the", 1)]
    assert terms.term_counts(df.where("false"), longest).count() == 0


def test_a_term_in_every_record_takes_constant_memory():
    """Half a million records with one term: neither the map side nor the stack holds records."""
    import tracemalloc

    def batches():
        for _ in range(50):
            yield pd.DataFrame({"field_name": ["f"] * 10_000, "lists": [[["the", "the"]]] * 10_000})

    tracemalloc.start()
    (made,) = terms._suffixes(1)(batches())
    (counted,) = terms._stack(iter([made]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted.to_dict("records") == [{"field_name": "f", "gram": ["the"], "occurrences": 1_000_000, "records": 500_000}]
    assert peak < 8_000_000


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 6)], "term string, records long")
    assert {r.term: r.mark for r in terms.marked(df, 100).collect()} == {"a": "rare", "b": None, "c": "common"}


def texts(seed: int, n: int = 160) -> list[str]:
    """Texts of common and rare words with copies, edits, reorderings, short, long and empty ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            words = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 5)):
                if words and rnd.random() < 0.5:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
                elif words and rnd.random() < 0.5:
                    words.pop(rnd.randrange(len(words)))
                else:
                    words.append(rnd.choice(vocabulary))
            rnd.shuffle(words)
        else:
            words = ["The", "of", "a"] + [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 12, 20, 60, 90, 300]))]
        out.append(" ".join(words))
    return out + ["", "   ", "!!!", "one two three"]


def word_set(t):
    return set(re.findall(r"[^\W_]+", (t or "").lower()))


def is_near(a, b):
    x, y = word_set(a), word_set(b)
    return len(x) >= 12 and len(y) >= 12 and len(x & y) >= 0.75 * len(x | y)


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 50_000), (1, 3)])
def test_near_across_misses_nothing(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "SLICE", 50_000 if hot > 3 else 2)
    made = texts(seed)
    df = spark.createDataFrame(list(enumerate(made)), "k long, t string")
    c = sets.classes(sets.with_words(df, F.col("k"), F.col("t")))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in overlap.near_across(c, c).collect()}
    kept = [r.id for r in c.collect()]
    want = {(i, j) for i in kept for j in kept if i < j and is_near(made[i], made[j])}
    assert got == want


@pytest.mark.parametrize("slice_rows", [4_096, 2])
def test_overlap_pairs(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(overlap, "SLICE", slice_rows)
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, "captions", " Development ", a, None), (2, "captions", "evaluation", a + " thirteen", "#12"), (3, "captions", None, a, "12"), (4, "captions", "VALIDATION", "short text", " 12.0"),
        (5, "captions", "development", None, "12"), (6, "captions", "development", a, "NA"), (7, "captions", "other", a, "12"), (8, "captions", "development", "", ""),
    ]
    c = spark.createDataFrame([(i, s, t, n) for i, _, s, t, n in rows], "record_id long, split string, caption_1 string, freesound_sound_id string")
    w = spark.createDataFrame([(100, "FreeSound_12", "x", "FreeSound", "val"), (101, "Other_12", a.upper(), "Other", "train"), (102, None, None, None, None)], "record_id long, clip_id string, caption string, source string, split string")
    r = overlap.records(c, w)
    pairs = overlap.overlap_pairs(r)
    got = {(x.e, x.t): (x.near, x.same_sound) for x in pairs.collect()}
    assert got == {(2, 1): (1, 0), (2, 6): (1, 0), (2, 101): (1, 0), (2, 5): (0, 1), (4, 5): (0, 1), (100, 5): (0, 1)}
    assert {x.containment for x in pairs.collect()} == {12 / 13, None}
    report = overlap.overlap_report(r).collect()
    assert sum(x.pairs for x in report) == 6
    assert sum(x.near_pairs for x in report) == 3 and sum(x.same_sound_pairs for x in report) == 3
    assert overlap.overlap_report(r.where("false")).count() == 0
    assert overlap.overlap_pairs(r.where("false")).count() == 0


@pytest.mark.parametrize("slice_rows", [4_096, 3])
def test_one_huge_group_and_two_tables(spark, slice_rows, monkeypatch):
    """Copies in one group are paired slice by slice; equal texts of different tables are no group."""
    monkeypatch.setattr(sets, "SLICE", slice_rows)
    text = " ".join(f"w{i}" for i in range(14))
    df = spark.range(40).selectExpr("id as k", f"if(id < 30, '{text}', concat('{text} x', id)) as t", "1 as id", "'x' as `group`")
    other = spark.createDataFrame([(5, text), (-3, text.upper()), (9, "short")], "k long, t string")
    groups = neardup.near_groups({"one": (df, F.col("k"), F.col("t")), "two": (other, F.col("k"), F.col("t"))})
    assert {(r.table_name, r.id, r.group) for r in groups.collect()} == {("one", i, 0) for i in range(40)} | {("two", 5, -3), ("two", -3, -3)}
    assert {(r.table_name, r.id_a, r.id_b) for r in neardup.group_pairs(groups).collect()} == {("one", i, j) for i in range(40) for j in range(i + 1, 40)} | {("two", -3, 5)}


@pytest.mark.parametrize("slice_rows", [4_096, 7])
def test_one_hot_class_and_one_hot_sound(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(overlap, "SLICE", slice_rows)
    text = " ".join(f"w{i}" for i in range(14))
    rows = spark.range(60).selectExpr("id", "if(id % 3 = 0, 'evaluation', 'train') as split", f"if(id < 45, '{text}', null) as caption_1", "if(id >= 30, '7', null) as freesound_sound_id")
    empty = spark.createDataFrame([], "record_id long, clip_id string, caption string, source string, split string")
    r = overlap.records(rows.withColumnRenamed("id", "record_id"), empty)
    want = {(e, t): (int(e < 45 and t < 45), int(e >= 30 and t >= 30)) for e in range(0, 60, 3) for t in range(60) if t % 3}
    want = {k: v for k, v in want.items() if any(v)}
    assert {(x.e, x.t): (x.near, x.same_sound) for x in overlap.overlap_pairs(r).collect()} == want
    (only,) = overlap.overlap_report(r).collect()
    assert (only.pairs, only.eval_records, only.near_pairs, only.same_sound_pairs) == (len(want), 20, sum(a for a, _ in want.values()), sum(b for _, b in want.values()))


def grouped(made, near):
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if near(made[i], made[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict = {}
    for i in range(len(made)):
        groups.setdefault(find(i), []).append(i)
    return {(g, i) for g, m in groups.items() if len(m) > 1 for i in m}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_near_groups(spark, seed):
    made = texts(seed)
    made += [made[0].upper()] * 3
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(made)] + [(None, made[0], "c", 1)], "k long, t string, id string, rep int")
    groups = neardup.near_groups({"t": (df, F.col("k"), F.col("t"))})
    got = {(r["group"], r.id) for r in groups.collect()}
    want = grouped(made, is_near)
    assert got == want
    assert neardup.group_pairs(groups).count() == sum(1 for g, i in want for h, j in want if g == h and i < j)


@pytest.mark.parametrize("size, common", [(40, 26), (100, 71), (200, 146)])
def test_edits_in_the_rare_words_of_long_texts(spark, size, common):
    usual = [f"usual{i}" for i in range(common)]
    made = []
    for i in range(40):
        rare = [f"rare{i}x{j}" for j in range(size - common)]
        edits = int(size * 0.14) - 1
        made += [" ".join(usual + rare), " ".join(usual + rare[edits:] + [f"new{i}x{j}" for j in range(edits)])]
    df = spark.createDataFrame(list(enumerate(made)), "k long, t string")
    got = {(r["group"], r.id) for r in neardup.near_groups({"t": (df, F.col("k"), F.col("t"))}).collect()}
    assert got == grouped(made, is_near) and len(got) == 80


def test_hot_bucket_and_empty(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{base} extra{i}") for i in range(2000)] + [(5000 + i, base) for i in range(500)], "k long, t string")
    groups = neardup.near_groups({"t": (df, F.col("k"), F.col("t"))})
    assert groups.count() == 2500 and groups.select("group").distinct().count() == 1
    assert neardup.near_groups({"t": (df.where("false"), F.col("k"), F.col("t"))}).count() == 0
    assert neardup.near_groups({"t": (df.where("k < 1"), F.col("k"), F.col("t"))}).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_long_chain(spark):
    got = components.components(spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("component = 0").count() == got.count() == 401
