"""Queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.packed import packed_lists
from ..session import table, written
from . import defects, encode, mixing, neardup, neighbours, overlap, stuffed, terms, topn

Query = Callable[[SparkSession, str], DataFrame]


def p1_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of every vector, down to a cosine of 0.85."""
    return neighbours.similar_vectors(table(spark, folder, "clip_vectors"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(p1_similar(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defects(table(spark, folder, "intent_queries"), table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_items(table(spark, folder, "neighbors"), "anchor_id", "audio_id", "score", 5).select("anchor_id", "audio_id", "rnk")


def _caption_terms(captions: DataFrame) -> DataFrame:
    return captions.select(F.lit("caption_1").alias("field_name"), F.array(words("caption_1")).alias("lists"))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words of caption_1 with their counts and marks."""
    captions = table(spark, folder, "captions")
    return terms.marked(terms.term_counts(_caption_terms(captions)), captions.count()).select("term", "occurrences", "records", "mark")


def p4_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of up to three words of caption_1 with their counts."""
    return terms.term_counts(_caption_terms(table(spark, folder, "captions")), longest=3).select("term", "n", "occurrences", "records")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    captions = table(spark, folder, "captions")
    values = packed_lists(captions, "record_id", "keywords", "freesound_uploader")
    # every value is a list of its own
    keywords = values.select(F.lit("keywords").alias("field_name"), F.transform("values", lambda v: F.array(F.lower(v))).alias("lists"))
    counts = terms.term_counts(_caption_terms(captions).unionByName(keywords))
    return terms.marked(counts, captions.count()).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.records(table(spark, folder, "captions"), table(spark, folder, "wavcaps_manifest"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlap_pairs(_records(spark, folder))
    return pairs.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def p5_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Every overlap with the part of the evaluation caption's words that the training caption has."""
    pairs = overlap.overlap_pairs(_records(spark, folder))
    return pairs.select("e", "t", "near", "same_sound", F.round("containment", 6).alias("containment"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """The overlaps by evaluation split and source and training split and source."""
    return overlap.overlap_report(_records(spark, folder))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups({
        "captions": (table(spark, folder, "captions"), F.col("record_id"), neardup.caption_text()),
        "intent_queries": (table(spark, folder, "intent_queries"), F.col("query_id"), F.col("query")),
    })


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each row of a group, with the smallest key of its group."""
    return _groups(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.group_pairs(_groups(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    sized = written(encode.token_counts(table(spark, folder, "documents"), "doc_id", "text", "source"))
    return mixing.mixture(sized, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix in reading order: which document is used, in which pass over its source, and when."""
    return _mix(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(_mix(spark, folder), table(spark, folder, "mix_targets"))


def _mix_by_characters(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    return mixing.mixture(sized, table(spark, folder, "mix_targets"))


def p9_mix_by_characters(spark: SparkSession, folder: str) -> DataFrame:
    """The mix with sizes in characters, which SQL can count as well."""
    return _mix_by_characters(spark, folder).select("doc_id", "source", "repeat", "tokens", F.round("finish", 3).alias("finish"))


def p9_shares_by_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source, with sizes in characters."""
    s = mixing.shares(_mix_by_characters(spark, folder), table(spark, folder, "mix_targets"))
    return s.select("source", F.round("target_share", 9).alias("target_share"), F.round("actual_share", 9).alias("actual_share"), "tokens", "documents", "most_repeats")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    shares = stuffed.stuffed(table(spark, folder, "documents"), "doc_id", "text")
    return shares.where(F.col("share") > stuffed.MOST).select("doc_id")


def queries() -> dict[str, Query]:
    made = [p1_found, p1_similar, p2_found, p3_found, p4_found, p4_terms, p4_ngrams, p5_found, p5_containment, p5_report, p6_found, p6_groups, p8_ids, p9_mix, p9_shares, p9_mix_by_characters, p9_shares_by_characters, p10_found]
    return {f.__name__: f for f in made}


_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_RECORDS = r"""
SELECT record_id AS id, 'captions' AS source, lower(trim(split)) AS split, list_distinct({c}) AS w,
       try_cast(regexp_extract(regexp_replace(trim(freesound_sound_id), '\.0+$', ''), '(\d+)[^\d]*$', 1) AS HUGEINT) AS sound
FROM captions
UNION ALL
SELECT record_id, 'wavcaps/' || coalesce(source, '?'), lower(trim(split)), list_distinct({d}),
       CASE WHEN lower(trim(source)) = 'freesound' THEN try_cast(regexp_extract(trim(clip_id), '(\d+)[^\d]*$', 1) AS HUGEINT) END
FROM wavcaps_manifest
""".replace("{c}", _WORDS.format("caption_1")).replace("{d}", _WORDS.format("caption"))
_NEAR = "len(list_intersect(x.w, y.w)) * 4 >= (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) * 3 AND len(x.w) * 4 >= len(y.w) * 3 AND len(y.w) * 4 >= len(x.w) * 3"
_OVERLAPS = f"""
WITH r AS ({_RECORDS}),
     e AS (SELECT * FROM r WHERE split IN ('validation', 'evaluation', 'val')),
     t AS (SELECT * FROM r WHERE split IN ('development', 'train')),
     near AS (SELECT x.id AS e, y.id AS t, len(list_intersect(x.w, y.w)) / len(x.w) AS c FROM e x JOIN t y ON len(x.w) >= 12 AND len(y.w) >= 12 AND {_NEAR}),
     sound AS (SELECT e.id AS e, t.id AS t FROM e JOIN t USING (sound)),
     p AS (SELECT e, t, max(n) AS near, max(s) AS same_sound, round(max(c), 6) AS containment FROM (SELECT e, t, 1 AS n, 0 AS s, c FROM near UNION ALL SELECT e, t, 0, 1, NULL FROM sound) GROUP BY e, t)
"""
_GROUPS = f"""
WITH RECURSIVE r AS (
  SELECT 'captions' AS table_name, record_id AS id, list_distinct({_WORDS.format("array_to_string(captions, chr(10))")}) AS w FROM captions
  UNION ALL SELECT 'intent_queries', query_id, list_distinct({_WORDS.format("query")}) FROM intent_queries),
 s AS (SELECT * FROM r WHERE len(w) >= 12),
 links AS (SELECT x.table_name, x.id AS a, y.id AS b FROM s x JOIN s y ON x.table_name = y.table_name AND x.id <> y.id AND {_NEAR}),
 reach AS (SELECT DISTINCT table_name, a, a AS b FROM links UNION SELECT reach.table_name, reach.a, links.b FROM reach JOIN links ON reach.table_name = links.table_name AND reach.b = links.a)
"""


_MIX = """
WITH t AS (SELECT source, max({'w': target_weight, 'r': max_repeats}) AS t FROM mix_targets
           WHERE source IS NOT NULL AND target_weight > 0 AND NOT isnan(target_weight) AND max_repeats >= 1 GROUP BY source),
     d AS (SELECT doc_id, source, CAST(length(text) AS BIGINT) AS tokens, t.w AS w, t.r AS r, CAST('0x' || substr(md5('0/' || doc_id), 1, 10) AS BIGINT) AS place
           FROM documents JOIN t USING (source) WHERE length(text) > 0),
     l AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place, doc_id) AS upto, sum(tokens) OVER (PARTITION BY source) AS whole FROM d),
     s AS (SELECT source, any_value(w) AS w, any_value(whole) * any_value(r) AS n FROM l GROUP BY source),
     o AS (SELECT *, n / w AS dry, sum(w) OVER (ORDER BY n / w, w) AS spent, sum(w) OVER () AS all_w FROM s),
     e AS (SELECT coalesce(min(dry) FILTER (spent > 0.05 * all_w), max(dry)) AS stop FROM o),
     b AS (SELECT floor(sum(least(n, stop * w))) AS most FROM s, e),
     p AS (SELECT doc_id, source, CAST(k.repeat AS INT) AS repeat, tokens, ((k.repeat - 1) * whole + upto) / w AS finish FROM l, e, unnest(range(1, r + 1)) AS k(repeat) WHERE ((k.repeat - 1) * whole + upto) / w <= stop),
     c AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source, doc_id) AS running FROM p),
     mix AS (SELECT doc_id, source, repeat, tokens, finish FROM c, b WHERE running <= most)
"""
_SIMILAR = """
WITH v AS (SELECT vec_id, bundle, embedding::DOUBLE[] AS e FROM clip_vectors
           WHERE bundle IS NOT NULL AND len(embedding) = 96 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
     u AS (SELECT vec_id, bundle, e, sqrt(list_inner_product(e, e)) AS n FROM v),
     p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.e, y.e) / (x.n * y.n), 6) AS c FROM u x JOIN u y ON x.bundle = y.bundle AND x.vec_id <> y.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rnk FROM p)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SIMILAR + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rnk <= 5 AND c >= 0.85",
        "p1_similar": _SIMILAR + "SELECT a AS vec_id, b AS other, c AS cosine, CAST(rnk AS INT) AS rnk FROM r WHERE rnk <= 5 AND c >= 0.85",
        "p3_found": """
WITH best AS (SELECT anchor_id, audio_id, max(score) AS s FROM neighbors
              WHERE anchor_id IS NOT NULL AND audio_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND anchor_id <> audio_id GROUP BY ALL)
SELECT anchor_id, audio_id, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, audio_id) AS INT) AS rnk FROM best
QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, audio_id) <= 5""",
        "p4_terms": f"""
WITH w AS (SELECT record_id, unnest({_WORDS.format("caption_1")}) AS term FROM captions),
     c AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM w GROUP BY term)
SELECT term, occurrences, records, CASE WHEN records <= 1 THEN 'rare' WHEN records > (SELECT count(*) FROM captions) * 0.05 THEN 'common' END AS mark FROM c""",
        "p4_ngrams": f"""
WITH w AS (SELECT record_id, {_WORDS.format("caption_1")} AS w FROM captions),
     g AS (SELECT record_id, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM w, unnest([1, 2, 3]) AS k(n), unnest(range(1, len(w) + 1)) AS j(i) WHERE i + n - 1 <= len(w))
SELECT term, CAST(n AS INT) AS n, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM g GROUP BY term, n""",
        "p5_found": _OVERLAPS + "SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM p",
        "p5_containment": _OVERLAPS + "SELECT e, t, near, same_sound, containment FROM p",
        "p5_report": _OVERLAPS + """
SELECT e.split AS eval_split, e.source AS eval_source, t.split AS train_split, t.source AS train_source, count(*) AS pairs, count(DISTINCT e.id) AS eval_records,
       CAST(sum(near) AS BIGINT) AS near_pairs, CAST(sum(same_sound) AS BIGINT) AS same_sound_pairs
FROM p JOIN e ON p.e = e.id JOIN t ON p.t = t.id GROUP BY ALL""",
        "p9_mix_by_characters": _MIX + "SELECT doc_id, source, repeat, tokens, round(finish, 3) AS finish FROM mix",
        "p9_shares_by_characters": _MIX + """
SELECT t.source, round(t.t.w / sum(t.t.w) OVER (), 9) AS target_share, round(coalesce(g.n, 0) / greatest(sum(coalesce(g.n, 0)) OVER (), 1), 9) AS actual_share,
       CAST(coalesce(g.n, 0) AS BIGINT) AS tokens, coalesce(g.c, 0) AS documents, coalesce(g.m, 0) AS most_repeats
FROM t LEFT JOIN (SELECT source, sum(tokens) AS n, count(*) AS c, max(repeat) AS m FROM mix GROUP BY source) g ON t.source = g.source""",
        "p6_groups": _GROUPS + 'SELECT table_name, a AS id, min(b) AS "group" FROM reach GROUP BY ALL',
        "p6_found": _GROUPS + "SELECT table_name, a AS id_a, b AS id_b FROM reach WHERE a < b",
    }
