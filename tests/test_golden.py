"""Small cases worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tonewell.functions import prompts, text
from tonewell.functions import vectors as V
from tonewell.operators import matching, metrics, mining, ranking, rerank, rerankers, splits, tokens
from tonewell.operators.similarity import top_k

SCORES = [[0.9, 0.5, 0.5, 0.1], [0.2, 0.8, 0.8, 0.8], [0.3, 0.3, 0.3, 0.3], [0.7, 0.6, 0.5, 0.4]]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scores(spark):
    return frame(spark, [(q, d, s) for q, row in enumerate(SCORES) for d, s in enumerate(row)], "q long, d long, s double")


def by_id(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_ranks_are_optimistic_on_ties(spark):
    truth = frame(spark, [(i, i) for i in range(4)], "q long, d long")
    ranks = ranking.rank_in_scores(scores(spark), truth)
    assert by_id(ranks, "q", "rank") == {0: 1, 1: 1, 2: 1, 3: 4}
    m = metrics.all_metrics(ranks).first()
    assert (m.r_at_1, m.r_at_5, m.r_at_10, m.mrr, m.rsum) == (75.0, 100.0, 100.0, 0.8125, 275.0)
    assert m.dcg == pytest.approx(0.857669, abs=1e-6)


def test_empty_input_gives_nulls_or_zeros(spark):
    none = frame(spark, [], "q long, rank long")
    assert metrics.all_metrics(none).first().r_at_1 is None
    assert metrics.all_metrics(none, empty=0.0).first().mrr == 0.0


CAPTIONS = [(0, 0, [1.0, 0.0]), (1, 0, [0.8, 0.6]), (2, 1, [0.0, 1.0]), (3, 1, [0.6, 0.8]), (4, 2, [-1.0, 0.0])]
ITEMS = [(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [-1.0, 0.0])]
VECTORS = "id long, clip long, vec array<double>"


def test_captionwise_tasks(spark):
    c, a = frame(spark, CAPTIONS, VECTORS), frame(spark, ITEMS, VECTORS)
    assert by_id(ranking.text_to_text(c), "id", "rank") == {0: 1, 1: 2, 2: 1, 3: 2}
    assert set(by_id(ranking.text_to_item(c, a), "id", "rank").values()) == {1}
    assert by_id(ranking.item_to_text(a, c), "id", "rank") == {0: 1, 1: 1, 2: 1}
    bank = by_id(ranking.centroids(c), "clip", "vec")
    assert bank[0] == pytest.approx([0.9, 0.3]) and bank[1] == pytest.approx([0.3, 0.9]) and bank[2] == [-1.0, 0.0]
    assert by_id(ranking.pooled_best(c, c, leave_out_self=True), "id", "rank") == {0: 1, 1: 2, 2: 1, 3: 2, 4: 3}


def test_skipped_candidate(spark):
    q = frame(spark, [(9, 3, [1.0])], VECTORS)
    g = frame(spark, [(i, i, [s]) for i, s in enumerate(SCORES[3])], VECTORS)
    truth = frame(spark, [(9, 3)], "a long, b long")
    for skip, rank in ((None, 4), (0, 3), (3, 4), (77, 4)):
        assert ranking.ranks(q, g, truth, skip=F.lit(skip).cast("bigint")).first()["rank"] == rank


def test_queries_without_truth_and_empty_gallery(spark):
    q, g = frame(spark, CAPTIONS, VECTORS), frame(spark, [], VECTORS)
    assert ranking.text_to_item(q, g).count() == 0
    assert ranking.text_to_item(g, q).count() == 0
    assert top_k(q, g, 3).count() == 0


def test_topk_ties_by_smaller_id_and_large_k(spark):
    q = frame(spark, [(0, [1.0, 0.0])], "id long, vec array<double>")
    g = frame(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    assert [r.other for r in top_k(q, g, 10).orderBy("pos").collect()] == [1, 3, 2]
    assert top_k(g, g, 1, exclude_self=True).count() == 3


def test_zero_vector_is_no_division_by_zero(spark):
    row = frame(spark, [([0.0, 0.0],)], "v array<double>").select(V.unit("v").alias("u"), V.cosine("v", "v").alias("c"), V.usable("v").alias("ok")).first()
    assert row.u == [0.0, 0.0] and row.c == 0.0 and row.ok is False


def test_filter_then_limit(spark):
    sims = [0.9, 0.69, 0.7, 0.1, 0.2]
    pairs = frame(spark, [(1, i, i + 1, s) for i, s in enumerate(sims)] + [(2, 0, 1, 0.8)], "id long, other long, pos int, similarity double")
    kept = mining.filter_then_limit(pairs, 0.7, 2)
    assert [(r.id, r.pos) for r in kept.orderBy("pos").collect()] == [(1, 2), (1, 4)]
    assert mining.mining_summary(pairs, kept).first().kept == 2


def test_blacklist_spares_the_diagonal(spark):
    pairs = frame(spark, [(1, 2), (2, 1), (1, 1), (1, 3)], "id long, other long")
    blocked = frame(spark, [(2, 1), (1, 1)], "a long, b long")
    assert sorted((r.id, r.other) for r in mining.without_pairs(pairs, blocked).collect()) == [(1, 1), (1, 3)]


def test_tokens(spark):
    t = frame(spark, [([[1.0, 0.0], [3.0, 0.0], [0.0, 2.0], [0.0, 4.0], [5.0, 5.0]],)], "t array<array<double>>")
    row = t.select(tokens.pool("t", 2).alias("mean"), tokens.pool("t", 2, "max").alias("max"), tokens.stride("t", 2).alias("stride"), tokens.prune("t", 0.6).alias("prune"), tokens.pool("t", 1).alias("one"), tokens.trim("t", 1, 2).alias("trim")).first()
    assert row["mean"] == [[2, 0], [0, 3], [5, 5]] and row["max"] == [[3, 0], [0, 4], [5, 5]]
    assert row["stride"] == [[1, 0], [0, 2], [5, 5]] and row["prune"] == [[3, 0], [0, 2], [0, 4]]
    assert len(row["one"]) == 5 and row["trim"] == [[3, 0], [0, 2]]


def test_maxsim(spark):
    df = frame(spark, [([[1.0, 0.0], [0.6, 0.8]], [[0.0, 1.0], [0.8, 0.6]]), ([[1.0, 0.0]], [])], "q array<array<double>>, d array<array<double>>")
    rows = df.select(*[tokens.maxsim("q", "d", r).alias(r) for r in ("mean", "sum", "max")]).collect()
    assert tuple(rows[0]) == pytest.approx((0.88, 1.76, 0.96)) and rows[1]["mean"] == -math.inf


def test_speedup():
    assert tokens.speedup(50, 300, tokens.PRESETS["moderate"]) == pytest.approx(10.0)
    assert tokens.speedup(50, 300, tokens.PRESETS["fast"]) == pytest.approx(27.27, abs=0.01)
    assert tokens.speedup(100, 300, tokens.Reduction(3, 1, 0.7)) == pytest.approx(13.04, abs=0.01)


def test_hash_values(spark):
    df = frame(spark, [("src0_0",), ("src0_1",), ("src0_2",), ("src1_3",)], "k string")
    got = by_id(df.select("k", splits.hash_unit(F.col("k"), 1337).alias("h")), "k", "h")
    assert got["src0_0"] == pytest.approx(0.016901261173) and got["src1_3"] == pytest.approx(0.602609879316)
    split = splits.hash_split(df.withColumn("s", F.substring("k", 1, 4)), "k", "s", 0.05)
    assert by_id(split, "k", "part") == {"src0_0": "val", "src0_1": "train", "src0_2": "train", "src1_3": "val"}
    one = frame(spark, [(1,)], "x int").select(rerank.hash_score(F.lit("audio"), F.lit("rain on roof"), F.lit("clip_1")).alias("a"), rerank.hash_score(F.lit("caption"), F.lit("rain"), F.lit("heavy rain")).alias("b")).first()
    assert one.a == pytest.approx(0.89301616743) and one.b == pytest.approx(0.580180056485)


def test_answers(spark):
    df = frame(spark, [("SCORE: 0.3 and later score: 1.2",), ("about 0.4 of 2",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parse_score("t", 0.5)).collect()] == [1.0, 1.0, 0.5, 0.5]
    df = frame(spark, [("ORDER: [3, 1, 3, 9]",), ("two then one",), ("",), (None,)], "t string")
    order = text.parse_order("t", 4)
    full = F.array(*[F.lit(i) for i in range(4)])
    got = df.select(order.alias("o"), text.complete_order(order, full).alias("c")).collect()
    assert got[0].o == [2, 0] and got[0].c == [2, 0, 1, 3] and got[1].o == [1, 0] and got[2].o == [] and got[3].o == []


def test_jaccard(spark):
    df = frame(spark, [("A dog's bark, loud!", "a loud dog"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard(text.tokens("a"), text.tokens("b"))).collect()] == [0.6, 0.0]


def test_blend_with_diffusion_style_scores(spark):
    df = frame(spark, [(1, d, a, c, i) for d, (a, c, i) in enumerate(zip([0.0, 2.0, 4.0], [0.2, 0.4, 0.0], [0.6, 0.2, -0.2]))], "q long, d long, x double, y double, i double")
    got = df.select("d", rerank.blend_normalised("i", "x", "y", (0.7, 0.3), 0.5, "q").alias("b")).orderBy("d").collect()
    assert [r.b for r in got] == pytest.approx([0.49, 0.58, 0.625])


def test_listwise_and_missing_target(spark):
    c = frame(spark, [(1, d, p) for p, d in enumerate([10, 11, 12], 1)] + [(2, 20, 1)], "q long, d long, pos int")
    orders = frame(spark, [(1, [2, 0])], "q long, order array<int>")
    moved = rerank.from_listing(c, orders)
    assert [r.d for r in moved.where("q = 1").orderBy("new_pos").collect()] == [12, 10, 11]
    targets = frame(spark, [(1, 11, 2), (2, 99, 7), (3, 1, 5)], "q long, d long, baseline_rank long")
    after = {r.q: (r.reranked_rank, r.skipped) for r in rerank.rank_after(moved, targets).collect()}
    assert after == {1: (3, False), 2: (7, False), 3: (5, True)}


def test_registry():
    assert rerankers.build(None) is None
    with pytest.raises(ValueError):
        rerankers.build({"enabled": True, "mode": "audio_native_pointwise", "client": {"name": "unheard"}})


def test_templates(spark):
    df = frame(spark, [(k, "Rain falls.", "Dogs bark.") for k in prompts.TYPES] + [("negative", "Rain falls.", None), ("question", None, None)], "k string, c string, n string")
    got = [r[0] for r in df.select(prompts.template_query("k", "c", "n")).collect()]
    assert got == ["Can you find audio of Rain falls?", "Audio featuring Rain falls", "Find audio of Rain falls", "Find audio of Rain falls, not Dogs bark", "Tagged audio of Rain falls", "", ""]
    assert prompts.backend(" OpenAI ") == "gpt"


def test_generate_keeps_failed_rows(spark):
    def answer(batch):
        if any("bad" in p for p in batch):
            raise RuntimeError("no")
        return [p.upper() + "[/INST] more" for p in batch]

    df = frame(spark, [("good",), ("bad",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.query, r.error) for r in prompts.generate(df, answer).collect()}
    assert got == {"good": ("GOOD", None), "bad": ("", "no")}


def test_similar_sets_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rnd.sample(words[: 5 + i % 25], rnd.randint(1, 5 + i % 25))) for i in range(120)]
    df = frame(spark, rows + [(998, []), (999, None)], "id long, terms array<string>")
    got = {(r.a, r.b) for r in matching.similar_sets(df, df, 0.6).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    assert got == want


def test_alias_and_first_existing(spark):
    keys = frame(spark, [("a_b",), ("x_y_z",), ("p_q",), ("none",)], "k string")
    known = frame(spark, [("a_b",), ("a",), ("y_z",), ("p",)], "n string")
    got = {r.k: (r.match, r.how) for r in matching.alias_join(keys, "k", known, "n").collect()}
    assert got == {"a_b": ("a_b", "exact"), "x_y_z": ("y_z", "suffix"), "p_q": ("p", "prefix"), "none": (None, None)}
    found = matching.first_existing(frame(spark, [(1, ["z", "b", "a"]), (2, ["q"])], "k int, p array<string>"), "k", "p", frame(spark, [("a",), ("b",)], "f string"), "f")
    assert [(r.k, r.found) for r in found.collect()] == [(1, "b")]


def test_order_dependent_operators(spark):
    df = frame(spark, [("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only")], "k string, o int, v string")
    assert by_id(splits.last_wins(df, ["k"], "o"), "k", "v") == {"a": "late", "b": "only"}
    assert sorted(r.caption_key for r in splits.occurrence_keys(df, "k", "o").collect()) == ["a_caption_00", "a_caption_01", "b_caption_00"]
    assert splits.slice_between(df, "o", -3, 2).count() == 2
    assert splits.seeded_sample(5, 9, 1) == [0, 1, 2, 3, 4] and splits.seeded_sample(50, 3, 7) == sorted(splits.seeded_sample(50, 3, 7))
