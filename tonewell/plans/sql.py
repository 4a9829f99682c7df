"""The SQL that states each core query, for DuckDB over the same tables."""

from __future__ import annotations

_E = """WITH v0 AS (SELECT vec_id, vec_id // 5 AS clip, vec_id % 5 AS slot, label, embedding::DOUBLE[] AS x FROM embeddings),
 v1 AS (SELECT *, greatest(sqrt(list_inner_product(x, x)), 1e-9) AS n FROM v0),
 e AS (SELECT vec_id, clip, slot, label, list_transform(x, lambda y: y / n) AS u FROM v1),
 a AS (SELECT clip AS id, clip, u FROM e WHERE slot = 0), c AS (SELECT vec_id AS id, clip, slot, u FROM e WHERE slot <> 0)"""


def _half(part: str, name: str, slot: str, key: str) -> str:
    """Items or captions in one half of the vectors, made unit length."""
    return f"""{name}0 AS (SELECT {key} AS id, clip, {part} AS x FROM v0 WHERE {slot}),
 {name}1 AS (SELECT *, greatest(sqrt(list_inner_product(x, x)), 1e-9) AS n FROM {name}0),
 {name} AS (SELECT id, clip, list_transform(x, lambda y: y / n) AS u FROM {name}1)"""


_ACOUSTIC = _half("x[1:32]", "ac", "slot = 0", "clip")
_SEMANTIC = _half("x[33:64]", "se", "slot <> 0", "vec_id")


def _pairs(q: str, g: str, ok: str, name: str = "p", where: str = "true") -> str:
    return f"{name} AS (SELECT x.id AS q, y.id AS d, y.clip AS dclip, x.clip AS qclip, ({ok}) AS ok, round(list_inner_product(x.u, y.u), 12) AS s FROM {q} x, {g} y WHERE {where})"


def _rank(q: str, g: str, ok: str, skip: str = "false", name: str = "r", where: str = "true") -> str:
    """CTEs that give {name}(id, rank); `skip` marks candidates that do not count unless they are positives."""
    return f"""{_pairs(q, g, ok, name + "p", where)},
 {name}b AS (SELECT q, max(s) AS best FROM {name}p WHERE ok GROUP BY q),
 {name} AS (SELECT q AS id, CAST(1 + count(*) FILTER (WHERE s > best AND NOT ({skip})) AS BIGINT) AS rank FROM {name}p JOIN {name}b USING (q) GROUP BY q)"""


def _values(rank: str = "rank") -> str:
    at = [f"round(avg(CASE WHEN {rank} <= {k} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS r_at_{k}" for k in (1, 5, 10)]
    total = " + ".join(f"avg(CASE WHEN {rank} <= {k} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in (1, 5, 10))
    return ", ".join([f"count({rank}) AS n", *at, f"round(avg(1.0::DOUBLE / {rank}), 6) AS mrr", f"round(avg(1.0::DOUBLE / log2({rank} + 1.0::DOUBLE)), 6) AS dcg", f"round({total}, 6) AS rsum"])


_T2A = _rank("c", "a", "x.clip = y.clip")
_BANK = """bank AS (SELECT clip AS id, clip, list(m ORDER BY i) AS u FROM (SELECT clip, i, avg(u[i]) AS m FROM c, range(1, 65) t(i) GROUP BY clip, i) GROUP BY clip)"""


def _clip_rank(q: str, leave: bool, name: str = "r") -> str:
    """Rank of the query's clip by its best caption."""
    return f"""{_pairs(q, "c", "x.clip = y.clip", "pp", "x.id <> y.id" if leave else "true")},
 best AS (SELECT q, qclip, dclip, max(s) AS s FROM pp GROUP BY ALL), own AS (SELECT q, s FROM best WHERE qclip = dclip),
 {name} AS (SELECT best.q AS id, CAST(1 + count(*) FILTER (WHERE own.s IS NULL OR best.s > own.s) AS BIGINT) AS rank FROM best LEFT JOIN own USING (q) GROUP BY best.q)"""


def _top(q: str, g: str, k: int, where: str = "true", name: str = "t") -> str:
    return f"""{_pairs(q, g, "false", name + "p", where)},
 {name} AS (SELECT q AS id, d AS other, s AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS INT) AS pos FROM {name}p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= {k})"""


_NEIGHBOURS = f"{_E}, {_ACOUSTIC}, {_top('ac', 'ac', 10, 'x.id <> y.id')}"
_SIMILAR = f"""{_NEIGHBOURS}, {_SEMANTIC},
 sim AS (SELECT t.id, t.other, t.score, t.pos, max(round(list_inner_product(x.u, y.u), 12)) AS similarity FROM t JOIN se x ON x.clip = t.id JOIN se y ON y.clip = t.other GROUP BY ALL),
 kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INT) AS kept FROM sim WHERE similarity < 0.34 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 3)"""
_HASH = "(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE)"
_HASHED = "(CAST('0x' || substr({0}, 15, 2) || substr({0}, 13, 2) || substr({0}, 11, 2) || substr({0}, 9, 2) || substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE)"
_AUDIO_SCORE = _HASHED.format("md5('audio||query ' || q || '||clip_' || d)")
_CAPTION = "CASE WHEN d % 3 = 0 THEN 'Mock description of audio clip ' || chr(39) || 'clip ' || d || chr(39) ELSE 'Caption ' || d END"
_CAPTION_SCORE = _HASHED.format(f"md5('caption||query ' || q || '||' || lower({_CAPTION}))")
_FIRST = f"""{_E}, {_top("c", "a", 10)}, t0 AS (SELECT id AS q, other AS d, score, pos FROM t)"""


def _new(score: str, source: str = "t0", by: str = "q") -> str:
    """CTEs that end in k2, the candidates with new_score and new_pos."""
    return f"k1 AS (SELECT *, {score} AS new_score FROM {source}), k2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY new_score DESC, pos) AS INT) AS new_pos FROM k1)"


_CANDIDATES = f"{_FIRST}, {_new(_AUDIO_SCORE)}"


def _after(score: str) -> str:
    """CTEs that end in after: task, q, baseline_rank, reranked_rank, place; and k2, all candidates of all tasks."""
    return f"""{_E}, {_top("c", "a", 10, name="ta")}, {_top("a", "c", 10, name="tb")},
 tp AS (SELECT x.id AS q, y.clip AS d, y.id AS cap, round(list_inner_product(x.u, y.u), 12) AS s FROM c x, c y WHERE x.id <> y.id),
 tq AS (SELECT q, d, s, cap FROM tp QUALIFY row_number() OVER (PARTITION BY q, d ORDER BY s DESC, cap) = 1),
 tc AS (SELECT q, d, s, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, cap) AS INT) AS pos FROM tq QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, cap) <= 10),
 t0 AS (SELECT 't2a' AS task, id AS q, other AS d, pos FROM ta UNION ALL SELECT 'a2t', id, other, pos FROM tb UNION ALL SELECT 't2t', q, d, pos FROM tc),
 {_new(score, by="task, q")},
 tg AS (SELECT 't2a' AS task, id AS q, clip AS d FROM c UNION ALL SELECT 't2t', id, clip FROM c UNION ALL SELECT 'a2t', clip, id FROM c),
 {_rank("c", "a", "x.clip = y.clip", name="ra")}, {_rank("a", "c", "x.clip = y.clip", name="rb")}, {_clip_rank("c", True, "rc")},
 ba AS (SELECT 't2a' AS task, id AS q, rank FROM ra UNION ALL SELECT 'a2t', id, rank FROM rb UNION ALL SELECT 't2t', id, rank FROM rc),
 hi AS (SELECT task, q, min(new_pos) AS place FROM k2 JOIN tg USING (task, q, d) GROUP BY task, q),
 after AS (SELECT ba.task, ba.q, CAST(ba.rank AS BIGINT) AS baseline_rank, CAST(coalesce(hi.place, ba.rank) AS BIGINT) AS reranked_rank, hi.place FROM ba LEFT JOIN hi ON ba.task = hi.task AND ba.q = hi.q)"""


_AFTER = _after(_AUDIO_SCORE)
_NEGATIVE = f"""{_E}, q1 AS (SELECT * FROM c), {_rank("q1", "a", "x.clip = y.clip", name="st")},
 {_rank("q1", "a", "x.clip = y.clip", "d = (q // 5 + 1) % (SELECT count(*) FROM a)", name="ad")},
 n AS (SELECT st.id, st.rank AS standard_rank, ad.rank AS adjusted_rank FROM st JOIN ad USING (id))"""
_CATEGORY = "CASE id % 5 WHEN 1 THEN 'Pragmatic' WHEN 2 THEN 'Subjective' WHEN 3 THEN 'Contextual' ELSE 'Negative/Contrastive' END"
_PER_CATEGORY = f"{_E}, {_T2A}, m AS (SELECT {_CATEGORY} AS category, {_values()} FROM r GROUP BY 1)"
_NAMES = ("r_at_1", "r_at_5", "r_at_10", "mrr", "dcg", "rsum")
_BATCH = f"{_E}, {_BANK}, b1 AS (SELECT id, clip, list_transform(u, lambda y: y / greatest(sqrt(list_inner_product(u, u)), 1e-9)) AS u FROM bank)"
_KIND = "CASE WHEN lower(trim(query_type)) IN ('question', 'imperative', 'paraphrase', 'negative', 'tagging') THEN lower(trim(query_type)) END"
_BUCKET = "CASE query_type WHEN 'question' THEN 'Pragmatic' WHEN 'paraphrase' THEN 'Subjective' WHEN 'imperative' THEN 'Contextual' WHEN 'negative' THEN 'Negative/Contrastive' WHEN 'tagging' THEN 'Cross-domain' END"
_FILLED = r"regexp_matches(coalesce({0}, ''), '[^\s\x{{A0}}]')"
_STEM = r"regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\.[^.]*$', '\1')"
_SQUASH = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"
_SPACE = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '\s+'), lambda t: t <> '')"
_JACCARD = "len(list_intersect(x.t, y.t))::DOUBLE / greatest(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)), 1)"
_ANSWER = """CASE event_id % 3 WHEN 0 THEN 'score: 0.' || (event_id % 7) || ' then SCORE: ' || (event_id % 2) || '.' || (event_id % 9)
 WHEN 1 THEN 'about ' || (event_id % 4) || '.' || (event_id % 5) || ' of 2' ELSE 'none' END"""
_STATED = "list_transform(list_filter({0}, lambda i: i BETWEEN 1 AND {1}), lambda i: i - 1)"
_ORDERS = f"""WITH n AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN [event_id % 5, event_id % 7, event_id % 5] ELSE [] END AS r,
   CASE event_id % 3 WHEN 0 THEN [2, event_id % 5, event_id % 7, event_id % 5] WHEN 1 THEN [event_id % 6] ELSE [] END AS w, CASE event_id % 3 WHEN 1 THEN [2] ELSE [] END AS s FROM events),
 g AS (SELECT event_id, {_STATED.format("r", 4)} AS r, {_STATED.format("w", 4)} AS w, {_STATED.format("list_concat(w, s)", 4)} AS ws FROM n),
 h AS (SELECT event_id, list_concat(r, ws) AS a, CASE WHEN len(r) > 0 THEN r ELSE ws END AS f, CASE WHEN len(r) > 0 THEN r ELSE w END AS d FROM g),
 o AS (SELECT event_id, list_filter(a, lambda v, i: list_position(a, v) = i) AS a, list_filter(f, lambda v, i: list_position(f, v) = i) AS f, list_filter(d, lambda v, i: list_position(d, v) = i) AS d FROM h)"""
_ANSWERED = f"""{_FIRST}, n0 AS (SELECT q, count(*) AS n FROM t0 GROUP BY q), n1 AS (SELECT q, n, [q % 12 + 1, q % 3 + 1, q % 5 + 1] AS r FROM n0),
 n2 AS (SELECT q, n, {_STATED.format("r", "n")} AS r, {_STATED.format("list_concat(r, [2])", "n")} AS w FROM n1),
 n3 AS (SELECT 'answers' AS client, q, n, list_concat(r, w) AS l FROM n2 UNION ALL SELECT unnest(['answers_first', 'answers_digits']), q, n, CASE WHEN len(r) > 0 THEN r ELSE w END FROM n2),
 n4 AS (SELECT client, q, list_concat(l, list_transform(range(1, n + 1), lambda i: i - 1)) AS l FROM n3)
 SELECT client, q, d, CAST(row_number() OVER (PARTITION BY client, q ORDER BY list_position(l, pos - 1)) AS INT) AS new_pos FROM t0 JOIN n4 USING (q)"""
_WIDE = "[trim(caption_1), trim(caption_2), trim(caption_3), trim(caption_4), trim(caption_5)]"
_TOK = "WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT vec_id, i, x[i * 8 + 1 : i * 8 + 8] AS t FROM w, range(0, 8) r(i))"
_WEIGHTED = "CAST(round(list_sum(list_transform({0}, lambda y, j: y * j)), 6) AS DOUBLE)"


def _stats(rows: str, group: str = "") -> str:
    return f"SELECT {group + ', ' if group else ''}{_values()} FROM {rows}" + (f" GROUP BY {group}" if group else "")


def statements() -> dict[str, str]:
    average = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _NAMES)
    tidy = " UNION ALL ".join(f"SELECT category, '{c}' AS metric, {c}::DOUBLE AS value FROM m" for c in ("n", *_NAMES))
    clip_tasks = f"SELECT 't2a' AS task, {_values()} FROM x1 UNION ALL SELECT 'a2t', {_values()} FROM x2"
    return {
        "baseline_t2a_ranks": f"{_E}, {_T2A} SELECT id, rank FROM r",
        "baseline_t2a_metrics": f"{_E}, {_T2A} {_stats('r')}",
        "baseline_a2t_metrics": f"{_E}, {_rank('a', 'c', 'x.clip = y.clip')} {_stats('r')}",
        "t2t_captionwise_metrics": f"{_E}, {_rank('c', 'c', 'x.clip = y.clip AND x.id <> y.id', 'q = d')} {_stats('r')}",
        "query_to_caption_metrics": f"{_E}, q1 AS (SELECT * FROM c WHERE slot = 1), g1 AS (SELECT * FROM c WHERE slot <> 1), {_rank('q1', 'g1', 'x.clip = y.clip')} {_stats('r')}",
        "t2t_pool_avg": f"{_E}, {_BANK}, {_rank('c', 'bank', 'x.clip = y.clip')} {_stats('r')}",
        "t2t_pool_max": f"{_E}, {_clip_rank('c', False)} {_stats('r')}",
        "caption_avg_metrics": f"{_E}, {_BANK}, {_rank('bank', 'a', 'x.clip = y.clip', name='x1')}, {_rank('a', 'bank', 'x.clip = y.clip', name='x2')} {clip_tasks}",
        "caption_pool_metrics": f"""{_E}, {_pairs("c", "a", "x.clip = y.clip", "z")},
 zz AS (SELECT qclip, d, max(s) AS s FROM z GROUP BY ALL), zo AS (SELECT qclip, s AS own FROM zz WHERE qclip = d),
 x1 AS (SELECT qclip AS id, CAST(1 + count(*) FILTER (WHERE s > own) AS BIGINT) AS rank FROM zz JOIN zo USING (qclip) GROUP BY qclip), {_clip_rank("a", False, "x2")} {clip_tasks}""",
        "clip_level_t2t_rank": f"{_E}, {_clip_rank('c', True)} SELECT id, rank FROM r",
        "negative_query_ranks": f"{_NEGATIVE} SELECT * FROM n",
        "negative_query_metrics": f"{_NEGATIVE} SELECT 'standard' AS kind, {_values('standard_rank')} FROM n UNION ALL SELECT 'adjusted', {_values('adjusted_rank')} FROM n",
        "negative_rank_gain": f"{_NEGATIVE} SELECT round(avg(standard_rank - adjusted_rank), 6) AS avg_gain FROM n",
        "uiq_category_metrics": f"{_PER_CATEGORY} SELECT * FROM m UNION ALL SELECT 'Average', CAST(sum(n) AS BIGINT), {average} FROM m",
        "metrics_pooled_by_task": f"""{_E}, {_T2A}, {_rank("a", "c", "x.clip = y.clip", name="r2")}, {_rank("c", "c", "x.clip = y.clip AND x.id <> y.id", "q = d", name="r3")},
 u AS (SELECT 't2a' AS task, rank FROM r UNION ALL SELECT 'a2t', rank FROM r2 UNION ALL SELECT 't2t', rank FROM r3) {_stats("u", "task")}""",
        "metrics_tidy": f"{_PER_CATEGORY} {tidy}",
        "metrics_report_line": f"{_PER_CATEGORY} SELECT category, printf('R@1=%.2f%% | R@5=%.2f%% | R@10=%.2f%% | MRR=%.4f | DCG=%.4f', r_at_1, r_at_5, r_at_10, mrr, dcg) AS line FROM m",
        "trainer_recall_fraction": f"""{_E}, {_pairs("c", "a", "x.clip = y.clip")}, o AS (SELECT ok, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS position FROM p)
 SELECT {", ".join(f"round(avg((position <= {k})::INT::DOUBLE), 6) AS recall_{k}" for k in (1, 5, 10))} FROM o WHERE ok""",
        "val_cross_entropy": f"""{_E}, {_pairs("c", "a", "x.clip = y.clip")}, z AS (SELECT q, ln(sum(exp(s / 0.07))) AS lse, max(s / 0.07) FILTER (WHERE ok) AS t FROM p GROUP BY q) SELECT round(avg(lse - t), 6) AS loss FROM z""",
        "infonce_loss": f"""{_BATCH}, {_pairs("b1", "a", "x.id = y.id")}, z AS (SELECT q, ln(sum(exp(s / 0.07))) - max(s / 0.07) FILTER (WHERE ok) AS l FROM p GROUP BY q),
 y AS (SELECT d, ln(sum(exp(s / 0.07))) - max(s / 0.07) FILTER (WHERE ok) AS l FROM p GROUP BY d)
 SELECT round((round((SELECT avg(l) FROM z), 6) + round((SELECT avg(l) FROM y), 6)) / 2, 6) AS loss""",
        "infonce_blacklist_loss": f"""{_BATCH}, {_pairs("b1", "a", "x.id = y.id")}, z AS (SELECT q, ln(sum(exp(s / 0.07)) FILTER (WHERE abs(q - d) <> 1)) - max(s / 0.07) FILTER (WHERE ok) AS l FROM p GROUP BY q),
 y AS (SELECT d, ln(sum(exp(s / 0.07)) FILTER (WHERE abs(q - d) <> 1)) - max(s / 0.07) FILTER (WHERE ok) AS l FROM p GROUP BY d)
 SELECT round((round((SELECT avg(l) FROM z), 6) + round((SELECT avg(l) FROM y), 6)) / 2, 6) AS loss""",
        "slap_loss": f"""{_E}, s AS (SELECT clip, max(u) FILTER (WHERE slot = 0) AS qt, max(u) FILTER (WHERE slot = 1) AS qa, max(u) FILTER (WHERE slot = 2) AS za, list_transform(list_zip(max(u) FILTER (WHERE slot = 3), max(u) FILTER (WHERE slot = 4)), lambda p: (p[1] + p[2]) / 2) AS zt FROM e GROUP BY clip),
 k AS (SELECT 0.5 * ((1 - avg(list_cosine_similarity(qa, zt))) + (1 - avg(list_cosine_similarity(qt, za)))) AS i, 0.5 * ((1 - avg(list_cosine_similarity(qa, za))) + (1 - avg(list_cosine_similarity(qt, zt)))) AS j FROM s)
 SELECT round(i, 6) AS inter, round(j, 6) AS intra, round(0.5 * i + 0.5 * j, 6) AS total FROM k""",
        "logistic_softplus_loss": f"""{_BATCH}, {_pairs("b1", "a", "x.id = y.id")}, z AS (SELECT q, d, ok, s / 0.07 AS z FROM p),
 n AS (SELECT q, z, row_number() OVER (PARTITION BY q ORDER BY z DESC, d) AS r, count(*) OVER (PARTITION BY q) AS c FROM z WHERE NOT ok),
 m AS (SELECT q, avg(greatest(z, 0) + ln(1 + exp(-abs(z)))) AS neg FROM n WHERE r <= least(c, greatest(floor(c * 0.5), 10)) GROUP BY q)
 SELECT round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z))) + neg), 6) AS loss FROM z JOIN m USING (q) WHERE ok""",
        "topk_candidates": f"{_E}, {_top('c', 'a', 10)} SELECT id, other, round(score, 6) AS score, pos FROM t",
        "best_item": f"{_E}, {_top('c', 'a', 1)} SELECT id, other FROM t",
        "distinct_clip_topk": f"""{_E}, {_pairs("a", "c", "false")}, b AS (SELECT q, dclip, max(s) AS s, min(d) FILTER (WHERE true) AS x FROM p GROUP BY ALL),
 f AS (SELECT q, dclip, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, fd) AS r FROM (SELECT q, dclip, max(s) AS s, arg_min(d, (-s, d)) AS fd FROM p GROUP BY ALL)),
 t5 AS (SELECT q AS id, dclip AS clip, round(s, 6) AS score, CAST(r AS INT) AS pos FROM f WHERE r <= 5)
 SELECT * FROM t5 UNION ALL SELECT a.id, a.clip, NULL, 6 FROM a WHERE NOT EXISTS (SELECT 1 FROM t5 WHERE t5.id = a.id AND t5.clip = a.clip)""",
        "a2t_candidates_with_positives": f"""{_E}, {_top("a", "c", 10)}, l AS (SELECT c.clip AS id, c.id AS other FROM c JOIN a ON a.clip = c.clip WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = c.clip AND t.other = c.id))
 SELECT id, other, pos FROM t UNION ALL SELECT id, other, CAST(10 + row_number() OVER (PARTITION BY id ORDER BY other) AS INT) FROM l""",
        "acoustic_neighbors": f"{_NEIGHBOURS} SELECT id, other, round(score, 6) AS score, pos FROM t",
        "two_step_neighbors": f"{_NEIGHBOURS} SELECT id, other, round(score, 6) AS score, pos FROM t WHERE pos <= 3",
        "caption_group_max_similarity": f"{_SIMILAR} SELECT id, other, round(similarity, 6) AS similarity FROM sim",
        "semantic_filtered_negatives": f"{_SIMILAR} SELECT id, other, pos, round(similarity, 6) AS similarity, kept FROM kept",
        "hard_negative_records": f"{_SIMILAR} SELECT id, string_agg(other::VARCHAR, ' ' ORDER BY pos) AS negatives, 10 - count(*) AS num_filtered FROM kept GROUP BY id",
        "negatives_summary": f"{_SIMILAR} SELECT (SELECT count(DISTINCT id) FROM t) AS anchors, (SELECT count(*) FROM t) AS total, count(*) AS kept, round(count(*) * 100.0::DOUBLE / greatest((SELECT count(*) FROM t), 1), 6) AS kept_percent FROM kept",
        "blacklist_anti_join": f"{_NEIGHBOURS} SELECT id, other, pos FROM t WHERE abs(id - other) <> 1",
        "hard_negative_expansion": f"""{_SIMILAR}, x AS (SELECT kept.id, c.id AS negative_caption, CAST(row_number() OVER (PARTITION BY kept.id ORDER BY kept.pos, c.id) AS INT) AS n FROM kept JOIN c ON c.clip = kept.other)
 SELECT c.id AS anchor_caption, negative_caption, n FROM x JOIN c ON c.clip = x.id WHERE n <= 5""",
        "neighbor_list_lengths": "SELECT anchor_id, count(*) AS n_rows, count(DISTINCT audio_id) AS candidates, max(CASE WHEN NOT isnan(score) THEN score END) AS best FROM neighbors WHERE anchor_id IS NOT NULL GROUP BY anchor_id",
        "rerank_pointwise_order": f"{_CANDIDATES} SELECT q, d, pos, round(new_score, 9) AS new_score, new_pos FROM k2",
        "rerank_listwise_order": f"{_CANDIDATES} SELECT q, d, new_pos FROM k2",
        "rank_after_rerank": f"{_AFTER} SELECT q, baseline_rank, reranked_rank, false AS skipped FROM after WHERE task = 't2a'",
        "rerank_task_ranks": f"{_AFTER} SELECT task, q, baseline_rank, reranked_rank, false AS skipped, place IS NULL AS target_missing, place IS NOT NULL AS hit FROM after",
        "rerank_caption_order": f"{_FIRST}, {_new(f'0.5::DOUBLE * score + 0.5::DOUBLE * {_CAPTION_SCORE}')} SELECT q, d, {_CAPTION} AS caption, round(new_score, 9) AS new_score, new_pos FROM k2",
        "rerank_answered_lists": _ANSWERED,
        "rerank_answered_scores": f"{_FIRST}, {_new('CASE WHEN d % 2 = 1 THEN (d % 10) / 10.0::DOUBLE ELSE 0.5::DOUBLE END')} SELECT q, d, new_score, new_pos FROM k2",
        "rerank_alignment_order": f"{_FIRST}, {_new('CASE WHEN d % 4 <> 0 THEN least(greatest((((q * 7 + d * 3) % 20) / 10.0::DOUBLE - 1.0::DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE, 0), 1) ELSE 0.0::DOUBLE END')} SELECT q, d, round(new_score, 6) AS new_score, new_pos FROM k2",
        "rerank_text_vector_order": f"{_FIRST}, t1 AS (SELECT t0.*, coalesce(list_inner_product(x.u, y.u), 0.0::DOUBLE) AS cosine FROM t0 LEFT JOIN e x ON x.vec_id = q AND q % 2 = 1 LEFT JOIN e y ON y.vec_id = d AND d % 2 = 1 AND d % 3 <> 0), {_new('cosine', 't1')} SELECT q, d, round(new_score, 6) AS new_score, new_pos FROM k2",
        "rerank_diffusion_order": f"""{_FIRST}, d0 AS (SELECT * FROM t0 WHERE d % 6 <> 0), d1 AS (SELECT *, -pos::DOUBLE AS o, min(-pos) OVER (PARTITION BY q) AS lo, max(-pos) OVER (PARTITION BY q) AS hi FROM d0),
 {_new("0.5::DOUBLE * (score + 1) / 2 + 0.5::DOUBLE * (CASE WHEN hi = lo THEN (1 - score) / 2 ELSE 0.7::DOUBLE * (o - lo) / (hi - lo) + 0.3::DOUBLE * (1 - score) / 2 END)", "d1")} SELECT q, d, round(new_score, 6) AS new_score, new_pos FROM k2""",
        "rerank_diagnostics": f"""{_AFTER}, l AS (SELECT q, string_agg(d, ' ' ORDER BY pos) AS original_order, string_agg(d, ' ' ORDER BY new_pos) AS reranked_order FROM k2 WHERE task = 'a2t' GROUP BY q)
 SELECT 'test' AS dataset, 'vectors' AS model, 'a2t' AS tasks, 10 AS top_k, q AS query_index, baseline_rank, reranked_rank, place IS NULL AS target_missing, original_order, reranked_order, 'audio_native_pointwise' AS reranker_mode FROM after JOIN l USING (q) WHERE task = 'a2t'""",
        "rerank_caption_stage_metrics": f"{_after(_CAPTION_SCORE)} SELECT task, 'baseline' AS stage, {_values('baseline_rank')} FROM after WHERE task <> 't2a' GROUP BY task UNION ALL SELECT task, 'reranked', {_values('reranked_rank')} FROM after WHERE task <> 't2a' GROUP BY task",
        "rerank_stage_metrics": f"{_AFTER} SELECT task, 'baseline' AS stage, {_values('baseline_rank')} FROM after GROUP BY task UNION ALL SELECT task, 'reranked', {_values('reranked_rank')} FROM after GROUP BY task",
        "rerank_summary": f"""{_AFTER} SELECT task, 'mock' AS name, 10 AS top_k, count(*) AS num_calls, round(sum((q % 10) / 8.0::DOUBLE), 6) AS total_latency, round(avg((q % 10) / 8.0::DOUBLE), 6) AS avg_latency, 0.0::DOUBLE AS total_gpu_cost, 0.0::DOUBLE AS avg_gpu_cost,
 count(place) AS hits_within_top_k, round(count(place)::DOUBLE / count(*), 6) AS hit_rate_within_top_k, '{{"audio_native_pointwise":' || count(*) || '}}' AS modes FROM after GROUP BY task""",
        "mode_histogram": "SELECT event_type AS mode, count(*) AS n FROM events GROUP BY 1",
        "mock_scores": f"WITH k AS (SELECT record_id, md5(concat_ws('||', 'caption', lower(caption_1), {_STEM.format('file')})) AS h FROM captions WHERE caption_1 IS NOT NULL) SELECT record_id, round({_HASH}, 9) AS score FROM k",
        "score_minmax_blend": f"""{_E}, {_top("c", "a", 10)}, w AS (SELECT *, min(score) OVER (PARTITION BY id) AS lo, max(score) OVER (PARTITION BY id) AS hi FROM t)
 SELECT id AS q, other AS d, round(0.7::DOUBLE * (CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (score - lo) / greatest(hi - lo, 1e-8) END) + 0.3::DOUBLE * (score + 1) / 2, 6) AS blended FROM w""",
        "two_score_blend": f"""{_E}, {_top("c", "a", 10)}, w AS (SELECT *, -pos::DOUBLE AS o, min(-pos) OVER (PARTITION BY id) AS lo, max(-pos) OVER (PARTITION BY id) AS hi FROM t)
 SELECT id AS q, other AS d, round(0.5::DOUBLE * (score + 1) / 2 + 0.5::DOUBLE * (CASE WHEN hi = lo THEN (score + 1) / 2 ELSE 0.7::DOUBLE * (o - lo) / (hi - lo) + 0.3::DOUBLE * (score + 1) / 2 END), 6) AS blended FROM w""",
        "cosine_affine_blend": f"""{_E}, {_top("c", "a", 10)}, w AS (SELECT *, least(greatest((score * 5 + 5) / 10, 0), 1) AS m FROM t)
 SELECT id AS q, other AS d, round((score + 1) / 2, 6) AS unit_score, round(m, 6) AS mos, round(0.75::DOUBLE * score + 0.25::DOUBLE * m, 6) AS blended FROM w""",
        "text_embed_caption_lookup": f"""WITH k AS (SELECT {_SQUASH.format("caption_text")} AS t, embedding::DOUBLE[] AS x FROM clip_vectors WHERE caption_text IS NOT NULL AND len(embedding) = 96
   AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 m AS (SELECT t, i, avg(x[i]) AS m FROM k, range(1, 97) r(i) GROUP BY ALL), w AS (SELECT t, list(m ORDER BY i) AS v FROM m GROUP BY t), z AS (SELECT t, v, greatest(sqrt(list_inner_product(v, v)), 1e-9) AS n FROM w)
 SELECT record_id, round(v[1] / n, 6) AS first, round(sqrt(list_inner_product(v, v)) / n, 6) AS length FROM captions JOIN z ON {_SQUASH.format("caption_1")} = z.t WHERE z.t <> ''""",
        "clip_id_alias_resolution": """WITH n AS (SELECT DISTINCT trim(freesound_sound_id) AS name FROM captions WHERE trim(freesound_sound_id) <> ''), k AS (SELECT DISTINCT clip_id FROM wavcaps_manifest),
 o AS (SELECT clip_id, 1 AS p, clip_id AS v FROM k UNION ALL SELECT clip_id, 2, split_part(clip_id, '_', 1) FROM k UNION ALL SELECT clip_id, 3, CASE WHEN instr(clip_id, '_') > 0 THEN substr(clip_id, instr(clip_id, '_') + 1) END FROM k),
 b AS (SELECT clip_id, min(p) AS p, arg_min(v, p) AS v FROM o JOIN n ON o.v = n.name GROUP BY clip_id)
 SELECT k.clip_id, b.v AS match, CASE b.p WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' WHEN 3 THEN 'suffix' END AS how FROM k LEFT JOIN b ON k.clip_id = b.clip_id""",
        "first_existing_path": "SELECT DISTINCT query_id, first_value(file) OVER (PARTITION BY query_id ORDER BY p) AS found FROM (SELECT query_id, p, clip_id || ext AS path FROM intent_queries, (VALUES (1, '.flac'), (2, '.mp3'), (3, '.wav')) x(p, ext) WHERE clip_id IS NOT NULL) q JOIN captions ON file = path",
        "inner_join_on_clip": f"WITH c AS (SELECT {_STEM.format('file')} AS clip_id, max(record_id) AS record_id FROM captions WHERE file IS NOT NULL GROUP BY 1) SELECT query_id, q.clip_id, record_id FROM intent_queries q JOIN c ON q.clip_id = c.clip_id",
        "jaccard_topk_examples": f"""WITH q AS (SELECT query_id AS id, list_distinct({_TOKENS.format("original_caption")}) AS t FROM intent_queries WHERE query_id % 100 = 0), p AS (SELECT record_id AS id, list_distinct({_TOKENS.format("caption_1")}) AS t FROM captions),
 s AS (SELECT x.id AS a, y.id AS b, {_JACCARD} AS j FROM q x, p y)
 SELECT a, b, round(j, 6) AS jaccard, CAST(row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS INT) AS pos FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) <= 3""",
        "fuzzy_caption_match": f"""WITH q AS (SELECT query_id AS id, list_distinct({_SPACE.format("original_caption")}) AS t FROM intent_queries), p AS (SELECT record_id AS id, list_distinct({_SPACE.format("caption_1")}) AS t FROM captions),
 s AS (SELECT x.id AS a, y.id AS b, {_JACCARD} AS j FROM q x JOIN p y ON len(x.t) > 0 AND len(y.t) > 0 AND len(x.t) >= 0.85 * len(y.t) - 1e-9 AND len(y.t) >= 0.85 * len(x.t) - 1e-9)
 SELECT a, b, round(j, 6) AS jaccard FROM s WHERE j >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) = 1""",
        "normalise_captions": f"""SELECT record_id, {_SQUASH.format("caption_1")} AS squashed, coalesce(nullif(regexp_replace(regexp_replace(lower(caption_1), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'value') AS slug,
 array_to_string({_TOKENS.format("caption_1")}, ' ') AS tokens FROM captions WHERE caption_1 IS NOT NULL""",
        "path_parts": rf"SELECT DISTINCT path, {_STEM.format('path')} AS stem, regexp_replace(path, '^[^/]*/', '') AS clip, CASE WHEN trim(regexp_replace(trim(path), '[^\p{{L}}\p{{N}}\-._]', '_', 'g'), '_') = '' THEN 'value' ELSE trim(regexp_replace(trim(path), '[^\p{{L}}\p{{N}}\-._]', '_', 'g'), '_') END AS file_slug FROM neighbors WHERE path IS NOT NULL",
        "bucket_slugs": f"WITH q AS (SELECT {_KIND} AS query_type FROM intent_queries) SELECT query_type, {_BUCKET} AS bucket, translate(lower({_BUCKET}), '/-', '__') AS slug, count(*) AS n FROM q WHERE query_type IS NOT NULL GROUP BY ALL",
        "parse_scores": f"""WITH k AS (SELECT event_id, {_ANSWER} AS t FROM events), v AS (SELECT event_id, try_cast(list_extract(regexp_extract_all(t, '(?i)score: (-?\\d+(?:\\.\\d+)?)', 1), -1) AS DOUBLE) AS m, try_cast(list_extract(regexp_extract_all(t, '-?\\d+(?:\\.\\d+)?'), -1) AS DOUBLE) AS n FROM k)
 SELECT event_id, round(least(greatest(coalesce(m, n, 0.5), 0), 1), 6) AS score_marked, round(least(greatest(coalesce(n, 0.5), 0), 1), 6) AS score_last, round(coalesce(n, 0.5), 6) AS score_raw FROM v""",
        "parse_listwise_order": f"{_ORDERS} SELECT event_id, array_to_string(a, ' ') AS positions_all, array_to_string(f, ' ') AS positions_first, array_to_string(d, ' ') AS positions_digits FROM o",
        "complete_partial_order": f"{_ORDERS} SELECT event_id, array_to_string(list_concat(a, list_filter([0, 1, 2, 3], lambda v: NOT list_contains(a, v))), ' ') AS positions FROM o",
        "template_queries": rf"""WITH q AS (SELECT query_id, {_KIND} AS kind, regexp_replace(trim(original_caption), '\.+$', '') AS c, regexp_replace(trim(hard_negative_caption), '\.+$', '') AS n, original_caption FROM intent_queries)
 SELECT query_id, kind, CASE WHEN NOT {_FILLED.format("original_caption")} THEN '' ELSE coalesce(CASE kind WHEN 'question' THEN 'Can you find audio of ' || c || '?' WHEN 'imperative' THEN 'Find audio of ' || c WHEN 'paraphrase' THEN 'Audio featuring ' || c
  WHEN 'tagging' THEN 'Tagged audio of ' || c WHEN 'negative' THEN 'Find audio of ' || c || ', not ' || n END, '') END AS made FROM q""",
        "prompt_render": f"SELECT query_id, 'Write a ' || coalesce({_KIND}, '') || ' query for: ' || coalesce(original_caption, '') || chr(10) || 'Answer:' AS prompt FROM intent_queries",
        "grouped_uiq": f"""WITH q AS (SELECT clip_id, original_caption, coalesce({_KIND}, 'generic') AS k, query FROM intent_queries WHERE clip_id IS NOT NULL AND {_FILLED.format("query")})
 SELECT clip_id, CAST(count(DISTINCT CASE WHEN {_FILLED.format("original_caption")} THEN original_caption END) AS INT) AS captions, CAST(count(*) AS INT) AS queries, string_agg(k || ':' || query, '|' ORDER BY k, query) AS listed FROM q GROUP BY clip_id""",
        "uiq_last_wins": f"WITH q AS (SELECT clip_id, coalesce({_KIND}, 'generic') AS kind, query_id, query FROM intent_queries WHERE clip_id IS NOT NULL AND {_FILLED.format('query')}) SELECT clip_id, kind, max(query_id) AS query_id, arg_max(query, query_id) AS query FROM q GROUP BY ALL",
        "query_counts": f"SELECT {_KIND} AS query_type, count(*) AS total, count(*) FILTER (WHERE {_FILLED.format('query')}) AS filled FROM intent_queries GROUP BY 1",
        "wide_captions": f"WITH k AS (SELECT record_id, list_filter({_WIDE}, lambda x: x IS NOT NULL AND x <> '') AS l FROM captions) SELECT record_id, CAST(len(l) AS INT) AS n, array_to_string(l, ' | ') AS captions FROM k",
        "caption_rows": f"SELECT record_id, CAST(i AS INT) AS place, {_WIDE}[i] AS caption FROM captions, range(1, 6) r(i) WHERE {_WIDE}[i] <> ''",
        "long_captions": "SELECT clip_id, string_agg(trim(caption), ' | ' ORDER BY record_id) AS captions, count(*) AS n FROM wavcaps_manifest WHERE clip_id IS NOT NULL AND trim(caption) <> '' GROUP BY clip_id",
        "hash_split": """WITH k AS (SELECT record_id, source, CAST('0x' || substr(md5(record_id || '_1337'), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE < 0.05 AS v FROM wavcaps_manifest)
 SELECT record_id, CASE WHEN v OR (NOT bool_or(v) OVER (PARTITION BY source) AND record_id = max(record_id) OVER (PARTITION BY source)) THEN 'val' ELSE 'train' END AS part FROM k""",
        "slice_sample": f"{_E} SELECT id, clip FROM c WHERE clip >= 10 AND clip < 60",
        "caption_occurrence_key": "SELECT record_id, caption_key FROM (SELECT record_id, caption, printf('%s_caption_%02d', clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY record_id) - 1) AS caption_key FROM wavcaps_manifest WHERE clip_id IS NOT NULL) WHERE trim(caption) <> ''",
        "duration_filter": "SELECT record_id, duration FROM wavcaps_manifest WHERE duration >= 1 AND duration <= 30",
        "manifest_source_counts": f"SELECT source, count(*) AS n, count(DISTINCT clip_id) AS clips, count(DISTINCT {_SQUASH.format('caption')}) AS captions FROM wavcaps_manifest GROUP BY source",
        "dedup_captions": f"WITH k AS (SELECT record_id, {_SQUASH.format('caption_1')} AS caption FROM captions) SELECT caption, min(record_id) AS first_record, count(*) AS n FROM k WHERE caption <> '' GROUP BY caption",
        "manifest_last_wins": "SELECT clip_id, max(record_id) AS record_id, last(caption ORDER BY record_id) AS caption, last(duration ORDER BY record_id) AS duration FROM wavcaps_manifest WHERE clip_id IS NOT NULL GROUP BY clip_id",
        "append_missing_clips": "WITH w AS (SELECT clip_id, CASE lower(trim(split)) WHEN 'train' THEN 0 ELSE 1 END AS part, record_id AS \"at\" FROM wavcaps_manifest WHERE clip_id IS NOT NULL AND lower(trim(split)) IN ('train', 'val')) SELECT clip_id, CAST(part AS INT) AS part, \"at\" FROM w QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY part, \"at\") = 1",
        "split_semi_join": f"SELECT query_id FROM intent_queries WHERE clip_id IN (SELECT {_STEM.format('file')} FROM captions WHERE lower(trim(split)) = 'development' AND file IS NOT NULL)",
        "token_pool_mean": f"{_TOK}, p AS (SELECT vec_id, i // 3 AS tok, j, avg(t[j]) AS m FROM k, range(1, 9) r(j) GROUP BY ALL) SELECT vec_id, CAST(tok AS INT) AS tok, round(sum(m * j), 6) AS total FROM p GROUP BY ALL",
        "token_pool_max": f"{_TOK}, p AS (SELECT vec_id, i // 3 AS tok, j, max(t[j]) AS m FROM k, range(1, 9) r(j) GROUP BY ALL) SELECT vec_id, CAST(tok AS INT) AS tok, round(sum(m * j), 6) AS total FROM p GROUP BY ALL",
        "token_adaptive": f"""{_TOK}, m AS (SELECT vec_id, i // 2 AS tok, j, avg(t[j]) AS m FROM k, range(1, 9) r(j) GROUP BY ALL), a AS (SELECT vec_id, CAST(tok AS INT) AS tok, round(sum(m * j), 6) AS total FROM m GROUP BY ALL),
 b AS (SELECT vec_id, CAST(i // 2 AS INT) AS tok, {_WEIGHTED.format('t')} AS total FROM k WHERE i % 2 = 0)
 SELECT h AS how, a.* FROM a, unnest(['pool 3', 'hybrid 5']) u(h) UNION ALL SELECT h, b.* FROM b, unnest(['stride 3', 'hybrid 3']) u(h)""",
        "maxsim_batch_scores": f"""{_TOK}, n AS (SELECT vec_id, vec_id // 5 AS clip, i, t[1] > 0 AS m, list_transform(t, lambda y: y / greatest(sqrt(list_inner_product(t, t)), 1e-9)) AS u FROM k),
 b AS (SELECT q.vec_id, q.i, q.m, max(CASE WHEN d.m THEN list_inner_product(q.u, d.u) ELSE -1e4::DOUBLE END) AS s FROM n q JOIN n d ON q.clip = d.clip AND q.vec_id % 5 <> 0 AND d.vec_id % 5 = 0 GROUP BY ALL)
 SELECT vec_id, round(coalesce(sum(s) FILTER (WHERE m), 0) / greatest(count(*) FILTER (WHERE m), 1), 6) AS score FROM b GROUP BY vec_id""",
        "time_embeddings": "SELECT vec_id AS step, CAST(i AS INT) AS dim, round(CASE WHEN i < 3 THEN sin((vec_id % 100) * exp(-ln(10000.0::DOUBLE) * i / 3)) ELSE cos((vec_id % 100) * exp(-ln(10000.0::DOUBLE) * (i - 3) / 3)) END, 6) AS x FROM embeddings, range(0, 6) r(i)",
        "numbered_entries": "SELECT record_id, 'wavcaps_train_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS entry_id FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS n FROM wavcaps_manifest)",
        "chosen_captions": f"{_E}, h AS (SELECT clip, id, substr(md5(id || '_11'), 1, 16) AS h FROM c) SELECT clip, id FROM h QUALIFY row_number() OVER (PARTITION BY clip ORDER BY h, id) <= 2",
        "seeded_caption_choice": f"{_E}, h AS (SELECT clip, id, substr(md5(id || '_7'), 1, 16) AS h FROM c) SELECT clip, id FROM h QUALIFY row_number() OVER (PARTITION BY clip ORDER BY h, id) = 1",
        "token_archive_texts": f"SELECT {_SQUASH.format('caption')} AS text_key, CAST(count(DISTINCT audio_relpath) AS INT) AS n, min(audio_relpath) AS first FROM wavcaps_manifest WHERE audio_relpath IS NOT NULL AND {_SQUASH.format('caption')} <> '' GROUP BY 1",
        "token_prepared": f"""{_TOK}, r AS (SELECT vec_id, i - 1 AS i, list_transform(t, lambda y: y * 2) AS t FROM k WHERE i BETWEEN 1 AND 6),
 p AS (SELECT vec_id, i // 2 AS i, j, avg(t[j]) AS m FROM r, range(1, 9) r(j) GROUP BY ALL), v AS (SELECT vec_id, i, list(m ORDER BY j) AS v FROM p GROUP BY ALL),
 u AS (SELECT vec_id, i, list_transform(v, lambda y: y / greatest(sqrt(list_inner_product(v, v)), 1e-6)) AS t FROM v WHERE sqrt(list_inner_product(v, v)) > 1e-6),
 o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_var_pop(t), 12) DESC, i) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM u)
 SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INT) AS tok, {_WEIGHTED.format("t")} AS total FROM o WHERE r <= greatest(1, floor(n * 0.6 + 1e-9))""",
        "rerank_late_interaction_order": f"""{_FIRST}, w AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT vec_id, i, x[i * 8 + 1 : i * 8 + 8] AS t FROM w, range(0, 8) r(i)),
 n AS (SELECT vec_id, i, list_transform(t, lambda y: y / greatest(sqrt(list_inner_product(t, t)), 1e-6)) AS t FROM k WHERE sqrt(list_inner_product(t, t)) > 1e-6),
 b AS (SELECT t0.q, t0.d, x.i, max(list_inner_product(x.t, y.t)) AS b FROM t0 JOIN n x ON x.vec_id = t0.q JOIN n y ON y.vec_id = t0.d * 5 WHERE t0.q % 7 <> 0 AND t0.d % 5 <> 0 GROUP BY ALL),
 s AS (SELECT q, d, avg(b) AS m FROM b GROUP BY ALL), t1 AS (SELECT t0.*, s.m FROM t0 LEFT JOIN s USING (q, d)),
 {_new("CASE WHEN q % 7 <> 0 THEN 0.5::DOUBLE * score + 0.5::DOUBLE * coalesce(m, score) ELSE -pos::DOUBLE END", "t1")} SELECT q, d, round(new_score, 6) AS new_score, new_pos FROM k2""",
        "captions_by_clip": f"""WITH f AS (SELECT clip_id, original_caption AS v, min(query_id) AS o FROM intent_queries WHERE clip_id IS NOT NULL AND {_FILLED.format("original_caption")} GROUP BY ALL)
 SELECT clip_id, string_agg(v, ' | ' ORDER BY o) AS captions FROM f GROUP BY clip_id""",
        "refreshed_metrics": f"{_PER_CATEGORY} SELECT * REPLACE (CASE WHEN category = 'Pragmatic' THEN -1.0::DOUBLE ELSE mrr END AS mrr) FROM m",
        "precomputed_queries": rf"SELECT query_id, {_FILLED.format('query')} AS there, CASE WHEN {_FILLED.format('query')} THEN 1.0::DOUBLE END AS length FROM intent_queries",
        "token_stride": f"{_TOK} SELECT vec_id, CAST((i - 1) // 2 AS INT) AS tok, {_WEIGHTED.format('t')} AS total FROM k WHERE i >= 1 AND (i - 1) % 2 = 0",
        "token_trim": f"{_TOK} SELECT vec_id, CAST(i - 2 AS INT) AS tok, {_WEIGHTED.format('t')} AS total FROM k WHERE i BETWEEN 2 AND 5",
        "token_prune_variance": f"""{_TOK}, s AS (SELECT *, round(list_var_pop(t), 12) AS v FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM s)
 SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INT) AS tok, {_WEIGHTED.format("t")} AS total FROM o WHERE r <= 4""",
        "token_prune_norm": f"""{_TOK}, s AS (SELECT *, round(sqrt(list_inner_product(t, t)), 12) AS v FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM s)
 SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INT) AS tok, {_WEIGHTED.format("t")} AS total FROM o WHERE r <= 4""",
        "maxsim_scores": f"""{_TOK}, n AS (SELECT vec_id, i, t, sqrt(list_inner_product(t, t)) AS l FROM k), z AS (SELECT vec_id, vec_id // 5 AS clip, vec_id % 5 AS slot, i, list_transform(t, lambda y: y / l) AS t FROM n WHERE l > 1e-6),
 m AS (SELECT x.vec_id, x.i, max(list_inner_product(x.t, y.t)) AS b FROM z x JOIN z y ON x.clip = y.clip WHERE x.slot <> 0 AND y.slot = 0 GROUP BY ALL)
 SELECT vec_id, round(avg(b), 6) AS maxsim_mean, round(sum(b), 6) AS maxsim_sum, round(max(b), 6) AS maxsim_max FROM m GROUP BY vec_id""",
        "masked_mean_pool": f"""{_TOK}, s AS (SELECT vec_id, j, sum(CASE WHEN t[1] > 0 THEN t[j] ELSE 0 END) AS a, count(*) FILTER (WHERE t[1] > 0) AS n FROM k, range(1, 9) r(j) GROUP BY ALL)
 SELECT vec_id, CAST(j - 1 AS INT) AS dim, round(a / greatest(n, 1e-6::DOUBLE), 6) AS x FROM s""",
        "logmel_stats": "SELECT round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-6)), 6) AS deviation FROM events",
        "windowed_rank_metrics": f"""WITH r AS (SELECT date_trunc('day', ts) AS window_start, event_type AS task, user_id % 20 + 1 AS rank FROM events)
 SELECT window_start, task, count(*) AS n, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS r_at_{k}" for k in (1, 5, 10))},
 round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)), 6) AS dcg FROM r GROUP BY ALL""",
    }
