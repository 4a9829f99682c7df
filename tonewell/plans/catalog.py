"""Queries over the test tables by name.

Vectors of the table `embeddings` play the roles of a retrieval set: five rows of following ids are a clip, the
first of them its item, the others its captions; the first half of a vector is the acoustic space and the second
half the semantic one. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions import vectors as V
from ..operators import matching, metrics, mining, project, ranking, rerank, rerankers, splits, tokens
from ..operators.packed import split_packed
from ..operators.similarity import top_clips, top_k
from ..session import table
from ..sources import readers, writers
from ..streaming.monitor import windowed_metrics
from . import precompute, reranked, sql
from .evaluation import EvaluationConfig, evaluate, evaluate_reranked, task_ranks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _add(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _vectors(s: SparkSession, d: str, vec: Column | None = None) -> DataFrame:
    v = V.unit("embedding") if vec is None else V.unit(vec)
    return table(s, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).cast("bigint").alias("clip"), (F.col("vec_id") % 5).alias("slot"), "label", v.alias("vec"))


def _items(s: SparkSession, d: str, vec: Column | None = None) -> DataFrame:
    return _vectors(s, d, vec).where("slot = 0").select(F.col("clip").alias("id"), "clip", "vec")


def _captions(s: SparkSession, d: str, vec: Column | None = None) -> DataFrame:
    return _vectors(s, d, vec).where("slot <> 0").select(F.col("vec_id").alias("id"), "clip", "slot", "vec")


def _acoustic() -> Column:
    return F.slice("embedding", 1, 32)


def _semantic() -> Column:
    return F.slice("embedding", 33, 32)


# ranks and metrics


@_add
def baseline_t2a_ranks(s, d):
    return ranking.text_to_item(_captions(s, d), _items(s, d))


@_add
def baseline_t2a_metrics(s, d):
    return metrics.all_metrics(baseline_t2a_ranks(s, d))


@_add
def baseline_a2t_metrics(s, d):
    return metrics.all_metrics(ranking.item_to_text(_items(s, d), _captions(s, d)))


@_add
def t2t_captionwise_metrics(s, d):
    return metrics.all_metrics(ranking.text_to_text(_captions(s, d)))


@_add
def query_to_caption_metrics(s, d):
    """The first caption of a clip as free query text, against all other captions."""
    c = _captions(s, d)
    return metrics.all_metrics(ranking.item_to_text(c.where("slot = 1"), c.where("slot <> 1")))


@_add
def t2t_pool_avg(s, d):
    c = _captions(s, d)
    return metrics.all_metrics(ranking.pooled_average(c, c))


@_add
def t2t_pool_max(s, d):
    c = _captions(s, d)
    return metrics.all_metrics(ranking.pooled_best(c, c))


@_add
def caption_avg_metrics(s, d):
    return evaluate(_captions(s, d), _items(s, d), EvaluationConfig(tasks=("t2a", "a2t"), mode="caption_avg"))


@_add
def caption_pool_metrics(s, d):
    return evaluate(_captions(s, d), _items(s, d), EvaluationConfig(tasks=("t2a", "a2t"), mode="caption_pool"))


@_add
def clip_level_t2t_rank(s, d):
    c = _captions(s, d)
    return ranking.pooled_best(c, c, leave_out_self=True)


def _negative_ranks(s, d):
    q, items = _captions(s, d), _items(s, d)
    n = items.count()
    own = ranking.own_clip(q, items)
    standard = ranking.ranks(q, items, own)
    adjusted = ranking.ranks(q, items, own, skip=(F.col("clip") + 1) % n)
    return standard.withColumnRenamed("rank", "standard_rank").join(adjusted.withColumnRenamed("rank", "adjusted_rank"), "id")


@_add
def negative_query_ranks(s, d):
    return _negative_ranks(s, d)


@_add
def negative_query_metrics(s, d):
    r = _negative_ranks(s, d)
    both = r.select(F.explode(F.array(F.struct(F.lit("standard").alias("kind"), F.col("standard_rank").alias("rank")), F.struct(F.lit("adjusted").alias("kind"), F.col("adjusted_rank").alias("rank")))).alias("x"))
    return metrics.all_metrics(both.select("x.kind", "x.rank"), "kind")


@_add
def negative_rank_gain(s, d):
    return metrics.rank_gain(_negative_ranks(s, d), "standard_rank", "adjusted_rank")


def _by_category(s, d):
    kinds = F.array(*[F.lit(prompts.BUCKETS[k]) for k in ("question", "paraphrase", "imperative", "negative")])
    ranks = ranking.text_to_item(_captions(s, d), _items(s, d))
    return ranks.withColumn("category", F.element_at(kinds, (F.col("id") % 5).cast("int")))


@_add
def uiq_category_metrics(s, d):
    return metrics.macro_average(metrics.all_metrics(_by_category(s, d), "category"), "category")


@_add
def metrics_pooled_by_task(s, d):
    return metrics.all_metrics(task_ranks(_captions(s, d), _items(s, d)), "task")


@_add
def metrics_tidy(s, d):
    return metrics.tidy(metrics.all_metrics(_by_category(s, d), "category"), "category")


@_add
def metrics_report_line(s, d):
    return metrics.all_metrics(_by_category(s, d), "category").select("category", metrics.report_line().alias("line"))


@_add
def trainer_recall_fraction(s, d):
    c, i = _captions(s, d), _items(s, d)
    p = ranking.argsort_rank(c, i, ranking.own_clip(c, i))
    return p.agg(*[F.round(F.avg((F.col("position") <= k).cast("double")), 6).alias(f"recall_{k}") for k in metrics.KS])


@_add
def val_cross_entropy(s, d):
    c, i = _captions(s, d), _items(s, d)
    return metrics.cross_entropy(c, i, ranking.own_clip(c, i))


def _batch(s, d):
    """The mean of each clip's captions, made unit length, and its item."""
    bank = ranking.centroids(_captions(s, d)).select("id", V.unit("vec").alias("vec"))
    return bank, _items(s, d).select("id", "vec")


@_add
def infonce_loss(s, d):
    return metrics.info_nce(*_batch(s, d))


@_add
def slap_loss(s, d):
    """The four vectors of a batch row from the five rows of a clip; the last is the mean of two."""
    slots = _vectors(s, d).groupBy("clip").pivot("slot", [0, 1, 2, 3, 4]).agg(F.first("vec")).toDF("clip", "q_text", "q_audio", "z_audio", "x", "y")
    return metrics.slap(slots.select("clip", "q_text", "q_audio", "z_audio", F.zip_with("x", "y", lambda x, y: (x + y) / 2).alias("z_text")))


@_add
def logistic_softplus_loss(s, d):
    return metrics.logistic_softplus(*_batch(s, d), hardest=0.5)


# candidates, mining


@_add
def topk_candidates(s, d):
    return top_k(_captions(s, d), _items(s, d), 10).select("id", "other", F.round("score", 6).alias("score"), "pos")


@_add
def best_item(s, d):
    """The single best item of each caption."""
    return top_k(_captions(s, d), _items(s, d), 1).select("id", "other")


@_add
def distinct_clip_topk(s, d):
    """The first five clips that an item's ranking of captions meets, its own appended."""
    items, c = _items(s, d), _captions(s, d)
    return ranking.with_target(top_clips(items, c, 5), items.select("id", "clip")).select("id", "clip", F.round("score", 6).alias("score"), "pos")


@_add
def a2t_candidates_with_positives(s, d):
    """Ten captions for each item, and those of its own captions that are not among them, appended by id."""
    items, c = _items(s, d), _captions(s, d)
    top = top_k(items, c, 10).select("id", "other", "pos")
    own = ranking.own_clip(items, c).select(F.col("a").alias("id"), F.col("b").alias("other"))
    lacking = own.join(top.select("id", "other"), ["id", "other"], "left_anti")
    order = Window.partitionBy("id").orderBy("other")
    return top.unionByName(lacking.select("id", "other", (F.row_number().over(order) + 10).alias("pos")))


def _neighbours(s, d, k=10, keep=None):
    return mining.neighbours(_items(s, d, _acoustic()), k, keep)


@_add
def acoustic_neighbors(s, d):
    return _neighbours(s, d).select("id", "other", F.round("score", 6).alias("score"), "pos")


@_add
def two_step_neighbors(s, d):
    return _neighbours(s, d, 20, 3).select("id", "other", F.round("score", 6).alias("score"), "pos")


@_add
def caption_group_max_similarity(s, d):
    pairs = mining.group_similarity(_neighbours(s, d), _captions(s, d, _semantic()))
    return pairs.select("id", "other", F.round("similarity", 6).alias("similarity"))


def _filtered(s, d):
    return mining.filter_then_limit(mining.group_similarity(_neighbours(s, d), _captions(s, d, _semantic())), 0.34, 3)


@_add
def semantic_filtered_negatives(s, d):
    return _filtered(s, d).select("id", "other", "pos", F.round("similarity", 6).alias("similarity"), "kept")


@_add
def hard_negative_records(s, d):
    """One record per anchor with its kept negatives in order."""
    records = mining.as_records(_filtered(s, d).withColumn("n", F.lit(10)))
    ids = F.array_join(F.transform("hard_negatives", lambda h: h["other"].cast("string")), " ")
    return records.select("id", ids.alias("negatives"), "num_filtered")


@_add
def negatives_summary(s, d):
    return mining.mining_summary(_neighbours(s, d), _filtered(s, d))


@_add
def blacklist_anti_join(s, d):
    """Neighbours without the pairs of clips with following numbers."""
    clips = _items(s, d).select("id")
    return mining.without_pairs(_neighbours(s, d), clips.select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))).select("id", "other", "pos")


@_add
def hard_negative_expansion(s, d):
    kept = _filtered(s, d)
    return mining.expand_to_captions(kept, _captions(s, d), 5)


@_add
def neighbor_list_lengths(s, d):
    """Rows, distinct candidates and best score of every anchor of the mined neighbours."""
    n = table(s, d, "neighbors").where("anchor_id is not null")
    score = F.when(~F.isnan("score"), F.col("score"))
    per = n.groupBy("anchor_id", "audio_id").agg(F.count("*").alias("c"), F.max(score).alias("m"))
    return per.groupBy("anchor_id").agg(F.sum("c").alias("n_rows"), F.count("audio_id").alias("candidates"), F.max("m").alias("best"))


# reranking


def _shown(task: str, c: DataFrame) -> DataFrame:
    """Candidates with what a reranker reads; every third has no caption."""
    d = F.col("d").cast("string")
    caption = F.when(F.col("d") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Caption "), d))
    return c.select("*", F.concat(F.lit("Query "), F.col("q").cast("string")).alias("query_text"), F.concat(F.lit("clip_"), d, F.lit(".wav")).alias("audio"), caption.alias("caption"))


def _reranker(mode: str, client: str = "mock", top_k: int = 10, weight: float = 1.0, **params) -> rerankers.Configured:
    return rerankers.build({"enabled": True, "mode": mode, "top_k": top_k, "weight": weight, "client": {"name": client, "params": params}})


def _reranked_candidates(s, d):
    return _shown("t2a", reranked.candidates("t2a", _captions(s, d), _items(s, d), 10))


@_add
def rerank_pointwise_order(s, d):
    out = _reranker("audio_native_pointwise")(_reranked_candidates(s, d))
    return out.select("q", "d", "pos", F.round("new_score", 9).alias("new_score"), "new_pos")


@_add
def rerank_caption_order(s, d):
    """Captions judged, missing ones made up first, blended with the first stage."""
    out = _reranker("caption_proxy_pointwise", weight=0.5)(_reranked_candidates(s, d))
    return out.select("q", "d", "caption", F.round("new_score", 9).alias("new_score"), "new_pos")


@_add
def rerank_listwise_order(s, d):
    return _reranker("audio_native_listwise")(_reranked_candidates(s, d)).select("q", "d", "new_pos")


def _lists(s, d):
    """Listwise answers that state a part of an order."""
    c = _captions(s, d)
    n = lambda m: (F.col("id") % m + 1).cast("string")
    return c.select(F.col("id").alias("q"), F.concat(F.lit("I would say ORDER: ["), n(12), F.lit(", "), n(3), F.lit(", "), n(5), F.lit("], not 2")).alias("answer"))


@_add
def rerank_answered_lists(s, d):
    """Orders that a model stated, read in the three ways in use."""
    c, lists = _reranked_candidates(s, d), _lists(s, d)
    out = None
    for client in ("answers", "answers_first", "answers_digits"):
        part = _reranker("caption_proxy_listwise", client, lists=lists)(c).select(F.lit(client).alias("client"), "q", "d", "new_pos")
        out = part if out is None else out.unionByName(part)
    return out


@_add
def rerank_answered_scores(s, d):
    """Scores that a model stated for the odd candidates, 0.5 for those it did not judge."""
    c = _reranked_candidates(s, d)
    answers = c.where("d % 2 = 1").select("q", "d", F.concat(F.lit("I am "), (F.col("q") % 9).cast("string"), F.lit(" sure. Score: 0."), (F.col("d") % 10).cast("string")).alias("answer"))
    return _reranker("audio_native_pointwise", "answers", answers=answers, default=0.5)(c).select("q", "d", "new_score", "new_pos")


@_add
def rerank_alignment_order(s, d):
    c = _reranked_candidates(s, d)
    cosines = c.where("d % 4 <> 0").select("q", "d", (F.pmod(F.col("q") * 7 + F.col("d") * 3, F.lit(20)) / 10.0 - 1.0).alias("cosine"))
    return _reranker("audio_native_pointwise", "alignment", cosines=cosines)(c).select("q", "d", F.round("new_score", 6).alias("new_score"), "new_pos")


@_add
def rerank_text_vector_order(s, d):
    """Captions judged by the vectors of their texts; queries and captions of even numbers have none."""
    e = table(s, d, "embeddings").where("vec_id % 2 = 1")
    named = [e.select(F.concat(F.lit(n), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vec")) for n in ("query ", "CAPTION  ")]
    out = _reranker("caption_proxy_pointwise", "text_embedding_caption", vectors=named[0].unionByName(named[1]))(_reranked_candidates(s, d))
    return out.select("q", "d", F.round("new_score", 6).alias("new_score"), "new_pos")


@_add
def rerank_late_interaction_order(s, d):
    """Token matrices of queries and items; queries of every seventh number and items of every fifth have none."""
    t = _tokens(s, d).select("vec_id", tokens.masked("t").alias("t"))
    q = t.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("q"), F.col("t").alias("query_tokens"))
    i = t.where("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("d"), F.col("t").alias("candidate_tokens")).where("d % 5 <> 0")
    c = _reranked_candidates(s, d).join(q, "q", "left").join(i, "d", "left")
    out = _reranker("late_interaction", "late_interaction", weight=0.5)(c)
    return out.select("q", "d", F.round("new_score", 6).alias("new_score"), "new_pos")


@_add
def rerank_diffusion_order(s, d):
    """A score without a scale beside a cosine; candidates without either fall out."""
    c = _reranked_candidates(s, d).withColumn("denoised", F.when(F.col("d") % 6 != 0, -F.col("pos").cast("double"))).withColumn("contrastive", -F.col("score"))
    out = _reranker("diffusion", "diffusion", weight=0.5)(c)
    return out.select("q", "d", F.round("new_score", 6).alias("new_score"), "new_pos")


def _details(s, d, mode="audio_native_pointwise", tasks=reranked.TASKS):
    return reranked.all_details(_captions(s, d), _items(s, d), _reranker(mode), tasks, _shown)


@_add
def rank_after_rerank(s, d):
    return _details(s, d, tasks=("t2a",)).select("q", "baseline_rank", "reranked_rank", "skipped")


@_add
def rerank_task_ranks(s, d):
    """Ranks of every query in all three tasks before and after, with hits."""
    return _details(s, d).select("task", "q", "baseline_rank", "reranked_rank", "skipped", "target_missing", "hit")


@_add
def rerank_stage_metrics(s, d):
    config = EvaluationConfig(reranker="audio_native_pointwise", top_k=10)
    return evaluate_reranked(_captions(s, d), _items(s, d), config, _shown)


@_add
def rerank_caption_stage_metrics(s, d):
    config = EvaluationConfig(tasks=("t2t", "a2t"), reranker="caption_proxy_listwise", top_k=10)
    return evaluate_reranked(_captions(s, d), _items(s, d), config, _shown)


@_add
def rerank_summary(s, d):
    """Calls, hits and modes of real runs in all tasks; timed by a made-up latency."""
    rows = _details(s, d).withColumn("seconds", (F.col("q") % 10) / 8.0)
    out = reranked.summary(rows, "mock", 10, latency="seconds")
    return out.select("*", F.to_json("mode_histogram").alias("modes")).drop("mode_histogram")


@_add
def rerank_diagnostics(s, d):
    """The columns of a diagnostics file that the plan itself fills."""
    rows = reranked.diagnostics(_details(s, d, tasks=("a2t",)), dataset="test", model="vectors", top_k=10)
    return rows.select("dataset", "model", "tasks", "top_k", "query_index", "baseline_rank", "reranked_rank", "target_missing", F.array_join(F.col("original_order").cast("array<string>"), " ").alias("original_order"), F.array_join(F.col("reranked_order").cast("array<string>"), " ").alias("reranked_order"), "reranker_mode")


@_add
def mode_histogram(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n"))


@_add
def mock_scores(s, d):
    c = table(s, d, "captions").where("caption_1 is not null")
    return c.select("record_id", F.round(rerank.hash_score(F.lit("caption"), F.lower("caption_1"), text.stem("file")), 9).alias("score"))


@_add
def score_minmax_blend(s, d):
    c = _reranked_candidates(s, d)
    return c.select("q", "d", F.round(rerank.blend(rerank.minmax("score", "q"), V.affine01("score"), 0.3), 6).alias("blended"))


@_add
def two_score_blend(s, d):
    """A score without a scale and a cosine, blended with the initial cosine."""
    c = _reranked_candidates(s, d).withColumn("free_score", -F.col("pos").cast("double"))
    return c.select("q", "d", F.round(rerank.blend_normalised("score", "free_score", "score", (0.7, 0.3), 0.5, "q"), 6).alias("blended"))


@_add
def cosine_affine_blend(s, d):
    c = _reranked_candidates(s, d)
    return c.select("q", "d", F.round(V.affine01("score"), 6).alias("unit_score"), F.round(V.mos01("score"), 6).alias("mos"), F.round(rerank.blend("score", V.mos01("score"), 0.25), 6).alias("blended"))


# lookups


@_add
def text_embed_caption_lookup(s, d):
    """Vectors of a caption text, averaged over its rows and made unit length, for the captions that have any."""
    known = table(s, d, "clip_vectors").where(F.col("caption_text").isNotNull() & V.usable("embedding", 96))
    asked = table(s, d, "captions").select("record_id", text.squash("caption_1").alias("t")).where("t <> ''")
    found = matching.lookup_mean(asked, "t", known.withColumn("t", text.squash("caption_text")), "t", "embedding")
    return found.where("vec is not null").select("record_id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(V.norm("vec"), 6).alias("length"))


@_add
def clip_id_alias_resolution(s, d):
    known = table(s, d, "captions").select(F.trim("freesound_sound_id").alias("name")).where("name <> ''")
    asked = table(s, d, "wavcaps_manifest").select("clip_id").distinct()
    return matching.alias_join(asked, "clip_id", known, "name")


@_add
def first_existing_path(s, d):
    asked = table(s, d, "intent_queries").where("clip_id is not null").select("query_id", F.transform(F.array(F.lit(".flac"), F.lit(".mp3"), F.lit(".wav")), lambda x: F.concat("clip_id", x)).alias("paths"))
    return matching.first_existing(asked, "query_id", "paths", table(s, d, "captions"), "file")


@_add
def inner_join_on_clip(s, d):
    """Queries with the caption row that was delivered last for their clip; queries of unknown clips fall away."""
    clips = splits.last_wins(table(s, d, "captions").select(text.stem("file").alias("clip_id"), "record_id").where("clip_id is not null"), ["clip_id"], "record_id")
    return table(s, d, "intent_queries").select("query_id", "clip_id").join(clips, "clip_id")


def _examples(s: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    q = asked.select(F.col("query_id").alias("id"), text.tokens("original_caption").alias("terms"))
    pool = table(s, d, "captions").select(F.col("record_id").alias("id"), text.tokens("caption_1").alias("terms"))
    return matching.similar_examples(q, pool, 3).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "pos")


@_add
def jaccard_topk_examples(s, d):
    return _examples(s, d, table(s, d, "intent_queries").where("query_id % 100 = 0"))


def _space_terms(c: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda t: t != "")


@_add
def fuzzy_caption_match(s, d):
    q = table(s, d, "intent_queries").select(F.col("query_id").alias("id"), _space_terms("original_caption").alias("terms"))
    pool = table(s, d, "captions").select(F.col("record_id").alias("id"), _space_terms("caption_1").alias("terms"))
    best = matching.best_similar(q, pool, 0.85)
    return best.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# text


@_add
def normalise_captions(s, d):
    c = table(s, d, "captions").where("caption_1 is not null")
    return c.select("record_id", text.squash("caption_1").alias("squashed"), text.slug("caption_1").alias("slug"), F.array_join(text.tokens("caption_1"), " ").alias("tokens"))


@_add
def path_parts(s, d):
    n = table(s, d, "neighbors").where("path is not null").select("path").distinct()
    return n.select("path", text.stem("path").alias("stem"), text.clip_of_key(F.concat("path", F.lit("_seg0"))).alias("clip"), text.file_slug("path").alias("file_slug"))


@_add
def bucket_slugs(s, d):
    q = table(s, d, "intent_queries").select(prompts.query_type("query_type").alias("query_type")).where("query_type is not null")
    return q.groupBy("query_type").agg(F.count("*").alias("n")).select("query_type", prompts.bucket("query_type").alias("bucket"), text.bucket_slug(prompts.bucket("query_type")).alias("slug"), "n")


def _answers(s, d):
    e = table(s, d, "events")
    k = lambda m: (F.col("event_id") % m).cast("string")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("score: 0."), k(7), F.lit(" then SCORE: "), k(2), F.lit("."), k(9))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("about "), k(4), F.lit("."), k(5), F.lit(" of 2"))).otherwise(F.lit("none")).alias("answer"))


@_add
def parse_scores(s, d):
    """Scores read in the three ways in use."""
    ways = [F.round(text.parse_score("answer", 0.5, how), 6).alias(f"score_{how}") for how in ("marked", "last", "raw")]
    return _answers(s, d).select("event_id", *ways)


def _orders(s, d):
    e = table(s, d, "events")
    k = lambda m: (F.col("event_id") % m).cast("string")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("I say 2. ORDER: ["), k(5), F.lit(", "), k(7), F.lit(", "), k(5), F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("first two then "), k(6))).otherwise(F.lit("no idea"))
    return e.select("event_id", answer.alias("answer"))


@_add
def parse_listwise_order(s, d):
    ways = [F.concat_ws(" ", text.parse_order("answer", 4, how).cast("array<string>")).alias(f"positions_{how}") for how in ("all", "first", "digits")]
    return _orders(s, d).select("event_id", *ways)


@_add
def complete_partial_order(s, d):
    full = F.array(*[F.lit(i) for i in range(4)])
    return _orders(s, d).select("event_id", F.concat_ws(" ", text.complete_order(text.parse_order("answer", 4), full).cast("array<string>")).alias("positions"))


@_add
def template_queries(s, d):
    q = table(s, d, "intent_queries").withColumn("kind", prompts.query_type("query_type"))
    return q.select("query_id", "kind", prompts.template_query("kind", "original_caption", "hard_negative_caption").alias("made"))


@_add
def prompt_render(s, d):
    q = table(s, d, "intent_queries").withColumn("kind", prompts.query_type("query_type"))
    return q.select("query_id", prompts.render("Write a {kind} query for: {caption}\nAnswer:", kind="kind", caption="original_caption").alias("prompt"))


@_add
def grouped_uiq(s, d):
    q = table(s, d, "intent_queries").where("clip_id is not null").withColumn("query_type", F.coalesce(prompts.query_type("query_type"), F.lit("generic")))
    g = prompts.grouped(q.select("clip_id", "original_caption", "query_type", "query"))
    return g.select("clip_id", F.size("source_captions").alias("captions"), F.size("uiq").alias("queries"), F.array_join(F.transform("uiq", lambda u: F.concat_ws(":", u["query_type"], u["query"])), "|").alias("listed"))


@_add
def captions_by_clip(s, d):
    """The different captions of each clip's queries, in the order of their first delivery."""
    q = table(s, d, "intent_queries").where("clip_id is not null")
    return prompts.first_seen(q, "clip_id", "original_caption", "query_id").select("clip_id", F.array_join("values", " | ").alias("captions"))


@_add
def few_shot_prompts(s, d):
    """A prompt for every query with its three most similar examples, where there are any."""
    queries = table(s, d, "intent_queries")
    near = _examples(s, d, queries).where("jaccard > 0")
    q = queries.select(F.col("query_id").alias("a"), F.coalesce("original_caption", F.lit("")).alias("asked"))
    pool = table(s, d, "captions").select(F.col("record_id").alias("b"), "caption_1")
    shown = near.join(pool, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("caption_1").alias("query"), F.col("jaccard").cast("decimal(9,3)").alias("answer")))).alias("shown"))
    made = q.join(shown, "a", "left").select("a", prompts.few_shot(F.lit("Rate how well the text fits."), "shown", F.concat(F.lit("Text: "), "asked")).alias("prompt"))
    return made


@_add
def refreshed_metrics(s, d):
    """Stored metrics by category, with those that were computed again in their place."""
    old = metrics.all_metrics(_by_category(s, d), "category").withColumn("mrr", F.lit(-1.0))
    new = metrics.all_metrics(_by_category(s, d).where("category <> 'Pragmatic'"), "category").select("category", "mrr")
    return writers.refreshed(old, new, ["category"])


@_add
def precomputed_queries(s, d):
    """Query texts sent through an encoder that knows words alone; blank ones have no vector."""
    q = table(s, d, "intent_queries").select("query_id", "query")
    made = precompute.encoded(q, "query", "hashed", "text")
    return made.select("query_id", F.col("embedding").isNotNull().alias("there"), F.round(V.norm("embedding"), 4).alias("length"))


@_add
def uiq_last_wins(s, d):
    q = table(s, d, "intent_queries").where(F.col("clip_id").isNotNull() & text.filled("query")).withColumn("kind", F.coalesce(prompts.query_type("query_type"), F.lit("generic")))
    return splits.last_wins(q.select("clip_id", "kind", "query_id", "query"), ["clip_id", "kind"], "query_id")


@_add
def query_counts(s, d):
    return prompts.counts(table(s, d, "intent_queries").select(prompts.query_type("query_type").alias("query_type"), "query"))


@_add
def wide_captions(s, d):
    """Non-blank captions of the wide columns, trimmed, in order."""
    c = table(s, d, "captions")
    kept = F.filter(F.array(*[F.trim(f"caption_{i}") for i in range(1, 6)]), lambda x: x.isNotNull() & (x != ""))
    return c.select("record_id", F.size(kept).alias("n"), F.array_join(kept, " | ").alias("captions"))


@_add
def caption_rows(s, d):
    """One row per non-blank wide caption with its place."""
    c = table(s, d, "captions")
    kept = F.filter(F.array(*[F.struct(F.lit(i).alias("place"), F.trim(f"caption_{i}").alias("caption")) for i in range(1, 6)]), lambda x: x["caption"].isNotNull() & (x["caption"] != ""))
    return c.select("record_id", F.explode(kept).alias("k")).select("record_id", "k.place", "k.caption")


@_add
def long_captions(s, d):
    """Manifest captions by clip, in the order of delivery."""
    w = table(s, d, "wavcaps_manifest").where("clip_id is not null and trim(caption) <> ''")
    item = F.struct("record_id", F.trim("caption").alias("c"))
    return w.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["c"]), " | ").alias("captions"), F.count("*").alias("n"))


# manifests


@_add
def hash_split(s, d):
    w = table(s, d, "wavcaps_manifest").select("record_id", "source")
    return splits.hash_split(w, "record_id", "source", 0.05).select("record_id", "part")


@_add
def slice_sample(s, d):
    return splits.slice_between(_captions(s, d), "clip", 10, 60).select("id", "clip")


@_add
def seeded_caption_choice(s, d):
    return splits.seeded_choice(_captions(s, d), "clip", "id", 7)


@_add
def caption_occurrence_key(s, d):
    w = table(s, d, "wavcaps_manifest").where("clip_id is not null").select("record_id", "clip_id", "caption")
    return splits.occurrence_keys(w, "clip_id", "record_id").where("trim(caption) <> ''").select("record_id", "caption_key")


@_add
def duration_filter(s, d):
    return splits.duration_between(table(s, d, "wavcaps_manifest"), "duration", 1.0, 30.0).select("record_id", "duration")


@_add
def manifest_source_counts(s, d):
    w = table(s, d, "wavcaps_manifest").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("clip_id").alias("clips"), F.countDistinct(text.squash("caption")).alias("captions"))
    return w


@_add
def dedup_captions(s, d):
    """Each caption text once, with the first record that has it."""
    c = table(s, d, "captions").select("record_id", text.squash("caption_1").alias("caption")).where("caption <> ''")
    return c.groupBy("caption").agg(F.min("record_id").alias("first_record"), F.count("*").alias("n"))


@_add
def manifest_last_wins(s, d):
    w = table(s, d, "wavcaps_manifest").where("clip_id is not null").select("clip_id", "record_id", "caption", "duration")
    return splits.last_wins(w, ["clip_id"], "record_id")


@_add
def append_missing_clips(s, d):
    """Manifest clips of training, then those of validation that are not among them."""
    w = table(s, d, "wavcaps_manifest").where("clip_id is not null").withColumn("split", F.lower(F.trim("split")))
    return splits.append_missing(w.where("split = 'train'"), w.where("split = 'val'"), ["clip_id"], "record_id").select("clip_id", "part", "at")


@_add
def split_semi_join(s, d):
    """Queries whose clip belongs to the training split."""
    c = table(s, d, "captions").where(F.lower(F.trim("split")) == "development").select(text.stem("file").alias("clip_id"))
    return table(s, d, "intent_queries").join(c, "clip_id", "left_semi").select("query_id")


# token matrices


def _tokens(s, d):
    return table(s, d, "embeddings").withColumn("t", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(V.doubles("embedding"), (i * 8 + 1).cast("int"), 8)))


def _token_rows(s, d, made):
    rows = _tokens(s, d).select("vec_id", F.posexplode(made).alias("tok", "v"))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "tok", F.round(total, 6).alias("total"))


@_add
def token_pool_mean(s, d):
    return _token_rows(s, d, tokens.pool("t", 3))


@_add
def token_pool_max(s, d):
    return _token_rows(s, d, tokens.pool("t", 3, "max"))


@_add
def token_stride(s, d):
    return _token_rows(s, d, tokens.stride("t", 2, 1))


@_add
def token_trim(s, d):
    return _token_rows(s, d, tokens.trim("t", 2, 4))


@_add
def token_prune_variance(s, d):
    return _token_rows(s, d, tokens.prune("t", 0.6))


@_add
def maxsim_scores(s, d):
    """Late interaction of every caption with the item of its clip."""
    t = _tokens(s, d).select("vec_id", F.floor(F.col("vec_id") / 5).cast("bigint").alias("clip"), tokens.masked("t").alias("q"))
    items = t.where("vec_id % 5 = 0").select("clip", F.col("q").alias("d"))
    return t.where("vec_id % 5 <> 0").join(items, "clip").select("vec_id", *[F.round(tokens.maxsim("q", "d", r), 6).alias(f"maxsim_{r}") for r in ("mean", "sum", "max")])


@_add
def masked_mean_pool(s, d):
    """The mean of the tokens with a positive first part."""
    rows = _tokens(s, d).withColumn("m", F.transform("t", lambda v: (v[0] > 0).cast("int")))
    return project.mean_pool(rows, "vec_id", "t", "m").select("vec_id", F.posexplode("vec").alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@_add
def token_adaptive(s, d):
    """Eight tokens thinned towards three (and five) in each way."""
    parts = [_token_rows(s, d, tokens.adaptive("t", n, how)).select(F.lit(f"{how} {n}").alias("how"), "*") for how, n in (("pool", 3), ("stride", 3), ("hybrid", 3), ("hybrid", 5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_add
def token_prune_norm(s, d):
    return _token_rows(s, d, tokens.prune("t", 0.6, "norm"))


@_add
def token_prepared(s, d):
    """Queries in the full order: prefix dropped, trimmed, doubled, pooled, made unit length, pruned."""
    made = tokens.prepared("t", tokens.Reduction(2, 2, 0.6), True, prefix=1, most=6, transform=lambda v: F.transform(v, lambda x: x * 2))
    return _token_rows(s, d, made)


@_add
def maxsim_batch_scores(s, d):
    """Masked MaxSim of every caption with its clip's item; tokens with a negative first part are masked."""
    mask = F.transform("t", lambda v: (v[0] > 0).cast("int"))
    unit = F.transform("t", lambda v: V.unit(v))
    t = _tokens(s, d).select("vec_id", F.floor(F.col("vec_id") / 5).cast("bigint").alias("clip"), unit.alias("t"), mask.alias("m"))
    q, i = t.where("vec_id % 5 <> 0"), t.where("vec_id % 5 = 0").select("clip", F.col("t").alias("d"), F.col("m").alias("dm"))
    return q.join(i, "clip").select("vec_id", F.round(tokens.maxsim_masked("t", "d", "m", "dm"), 6).alias("score"))


@_add
def time_embeddings(s, d):
    steps = table(s, d, "embeddings").select(F.col("vec_id").alias("step"))
    return steps.select("step", F.posexplode(matching.time_embedding(F.col("step") % 100, 6)).alias("dim", "x")).select("step", "dim", F.round("x", 6).alias("x"))


@_add
def infonce_blacklist_loss(s, d):
    """The batch loss without pairs of clips with following numbers."""
    a, b = _batch(s, d)
    return metrics.info_nce(a, b, blacklist=a.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


@_add
def numbered_entries(s, d):
    """Manifest rows with entry ids that count the whole order."""
    w = table(s, d, "wavcaps_manifest").select("record_id")
    return readers.split_entries(w, "wavcaps", "train", "record_id").select("record_id", "entry_id")


@_add
def chosen_captions(s, d):
    """Two captions of each clip by the seeded draw."""
    return splits.chosen_captions(_captions(s, d), "clip", "id", 11, 2)


@_add
def token_archive_texts(s, d):
    """Archives by caption text, the first by path."""
    w = table(s, d, "wavcaps_manifest").select("caption", F.col("audio_relpath").alias("path")).where("path is not null")
    return readers.token_archives_by_text(w).select("text_key", F.size("paths").alias("n"), "first")


@_add
def logmel_stats(s, d):
    return matching.mean_deviation(table(s, d, "events"), "value")


# streaming extension, over the table


@_add
def windowed_rank_metrics(s, d):
    e = table(s, d, "events").select("ts", F.col("event_type").alias("task"), (F.col("user_id") % 20 + 1).alias("rank"))
    return windowed_metrics(e, "1 day")


# packed fields


@_add
def p7_found(s, d):
    return split_packed(table(s, d, "captions"), "record_id", "keywords", "freesound_uploader", "keyword")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.statements()
