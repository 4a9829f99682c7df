"""Same or near-same records across splits: hashes of word n-grams of the evaluation side against training.

Near is a statement on word sets, so text order must not matter. The words of every text are put in one
global order, rarest first, and the n-grams are the combinations of n words out of the first words of
that order. If two texts share at least their smallest possible overlap, the first
|x| - overlap + n words of both hold n common ones: no near pair is missed. The evaluation n-grams are
partitioned by hash, training is scanned against them, and the containment of each evaluation record in
each training record decides. Long texts would have many combinations, so n falls from 3 to 1 with the size
of the larger text of a pair (`ZONES`); a text makes the n-grams of every zone that it could meet a partner in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import written
from .sets import MIN_WORDS, THRESHOLD, classes, least_shared, member_pairs, verified, with_words

#: n, and the sizes (distinct words, above and up to) of the larger text of a pair that it is for.
ZONES = ((3, 0, 64), (2, 64, 256), (1, 256, 1 << 31))
#: Cells of the table of word frequencies that orders the words; its size does not depend on the data.
CELLS = 1 << 20
#: Rows of one side that share an n-gram, a class or a sound, above which that key is cut into slices.
HOT = 50_000
#: Rows of a slice; a task then makes at most SLICE * SLICE pairs of one key at a time.
SLICE = 4_096

#: Training and evaluation splits, in lower case.
TRAINING = ("development", "train")
EVALUATION = ("validation", "evaluation", "val")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often the words of each of CELLS cells occur: an upper bound for each of them, in a table of fixed size."""
    cell = F.col("w").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = sets.select(F.explode("words").alias("w")).groupBy(cell.alias("cell")).count().toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    out[counts["cell"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    return out


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each row of word hashes."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def grams(sets: DataFrame, frequency: Broadcast[np.ndarray], threshold: float = THRESHOLD, above: int = 0) -> DataFrame:
    """id, gram: the n-gram hashes of each set, its rarest words first. `sets` has id and words.

    With `above`, only n-grams whose every word may occur more than so many times; no other can be shared by more sets.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = frequency.value
        picks: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            ids, keys = [], []
            for key, words in zip(batch["id"], batch["words"]):
                size = len(words)
                often = of[words & (CELLS - 1)]
                order = words[np.lexsort((words, often))].view(np.uint64)
                rare = int((often <= above).sum()) if above else 0
                spare = size - least_shared(size, threshold)
                for n, low, most in ZONES:
                    if not low * threshold < size <= most:
                        continue
                    k = min(spare + n, size)
                    if k - rare < n:
                        continue
                    if (n, k - rare) not in picks:
                        picks[n, k - rare] = list(np.array(list(combinations(range(k - rare), n))).T)
                    # a combination is a set: in hash order both sides agree
                    chosen = np.sort(np.stack([order[rare:][p] for p in picks[n, k - rare]]), axis=0)
                    h = _combine([np.full(chosen.shape[1], n, np.uint64), *chosen])
                    ids.append(np.full(len(h), key, np.int64))
                    keys.append(h)
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "gram": np.concatenate(keys)})

    return sets.select("id", "words").mapInPandas(make, "id long, gram long")


def meeting(left: DataFrame, right: DataFrame, by: str, hot: DataFrame | None) -> DataFrame:
    """The join of both sides by a key; rows of the keys in `hot` (`by`, nl, nr: its rows on either side) meet in a grid of slices.

    A row of a hot key goes to one row, or one column, of the grid of its key, so no task holds all rows of a key.
    """
    if hot is None:
        return left.hint("merge").join(right, by)
    size = hot.select(by, F.ceil(F.col("nl") / SLICE).cast("int").alias("_rows"), F.ceil(F.col("nr") / SLICE).cast("int").alias("_columns"))

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        named = side.join(size, by, "left")
        mine = F.pmod(F.xxhash64(F.lit(3), "id"), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other)
        return named.select(*side.columns, mine, every)

    a = cut(left.withColumnRenamed("a", "id"), "_rows", "_columns").withColumnRenamed("id", "a")
    b = cut(right.withColumnRenamed("b", "id"), "_columns", "_rows").withColumnRenamed("id", "b")
    return a.hint("merge").join(b, [by, "_rows", "_columns"]).drop("_rows", "_columns")


def _hot(left: DataFrame, right: DataFrame, by: str) -> DataFrame | None:
    """Keys with more than HOT rows on a side that occur on both; None if there are none."""
    sides = left.select(by, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(by, F.lit(0).alias("l"), F.lit(1).alias("r")))
    found = written(sides.groupBy(by).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr")).where((F.greatest("nl", "nr") > HOT) & (F.least("nl", "nr") > 0)))
    return None if found.isEmpty() else found


def near_across(eval_sets: DataFrame, train_sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a (evaluation), b (training), containment: every near pair of different ids of two collections of id and words.

    containment is the part of the words of a that b has.
    """
    sets = eval_sets.select("id", "words").unionByName(train_sets.select("id", "words")).dropDuplicates(["id"])
    often = frequencies(sets)
    shared = sets.sparkSession.sparkContext.broadcast(often)  # CELLS numbers, whatever the data are
    hot = None
    if often.max(initial=0) > HOT:
        heavy = [grams(s, shared, threshold, HOT).withColumnRenamed("id", name) for s, name in ((eval_sets, "a"), (train_sets, "b"))]
        hot = _hot(*heavy, "gram")
    left = grams(eval_sets, shared, threshold).withColumnRenamed("id", "a")
    right = grams(train_sets, shared, threshold).withColumnRenamed("id", "b")
    pairs = written(meeting(left, right, "gram", hot).where("a <> b").select("a", "b").distinct())
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return verified(pairs, sets.join(named, "id", "left_semi"), threshold, contained=True)


def side(split: Column) -> Column:
    """'train', 'eval' or null for a split written in any case and with spaces around it."""
    s = F.lower(strip(split))
    return F.when(s.isin(*TRAINING), "train").when(s.isin(*EVALUATION), "eval")


def sound_number(text: Column) -> Column:
    """The number in a sound id however it is written ('#12', ' 12', '12.0', a page address); null if none."""
    plain = F.regexp_replace(strip(text), r"\.0+$", "")
    return F.regexp_extract(plain, r"(\d+)(?!.*\d)", 1).try_cast("decimal(38,0)")


def records(captions: DataFrame, wavcaps: DataFrame) -> DataFrame:
    """id, source, side, text, sound of the records of both tables that belong to a side.

    source is the table name, or that and the source of a manifest row.
    """
    a = captions.select(
        F.col("record_id").alias("id"), F.lit("captions").alias("source"), F.lower(strip(F.col("split"))).alias("split"), F.col("caption_1").alias("text"),
        sound_number(F.col("freesound_sound_id")).alias("sound"),
    )
    w = wavcaps.select(
        F.col("record_id").alias("id"), F.concat(F.lit("wavcaps/"), F.coalesce(F.col("source"), F.lit("?"))).alias("source"), F.lower(strip(F.col("split"))).alias("split"),
        F.col("caption").alias("text"), F.when(F.lower(strip(F.col("source"))) == "freesound", sound_number(F.col("clip_id"))).alias("sound"),
    )
    both = a.unionByName(w)
    return both.withColumn("side", side(F.col("split"))).where(F.col("side").isNotNull())


def _found(rows: DataFrame, threshold: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, containment, near) and members (id, side, labels, class) of what overlaps.

    A class is a word set or a sound; classes of sounds have negative numbers of their own.
    """
    labels = ["side", "split", "source"]
    # written once: several steps read them, and texts are cut into words a single time
    worded = written(with_words(rows, F.col("id"), F.col("text"), *[F.col(c) for c in labels], min_words=min_words))
    reps = written(classes(worded, F.max(F.col("side") == "eval").alias("has_eval"), F.max(F.col("side") == "train").alias("has_train")))
    across = near_across(reps.where("has_eval"), reps.where("has_train"), threshold)
    same = reps.where("has_eval and has_train").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("containment"))
    by_text = written(across.unionByName(same))
    named = by_text.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names = reps.select("h1", "h2", "id").join(named, "id", "left_semi").select("h1", "h2", F.col("id").cast("string").alias("class"))
    members = worded.select("id", *labels, "h1", "h2").join(names, ["h1", "h2"]).select("id", *labels, "class")
    sound = F.concat(F.lit("sound "), F.col("sound").cast("string"))
    heard = rows.where(F.col("sound").isNotNull()).select("id", *labels, sound.alias("class"))
    both = heard.groupBy("class").agg(F.countDistinct("side").alias("n")).where("n = 2").select("class")
    by_sound = both.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(None).cast("double").alias("containment"), F.lit(0).alias("near"))
    pairs = by_text.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "containment", F.lit(1).alias("near"))
    return written(pairs.unionByName(by_sound)), written(members.unionByName(heard.join(both, "class", "left_semi").select("id", *labels, "class")))


def overlap_pairs(rows: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """e, t, near, same_sound, containment: every evaluation and training record with near captions or one sound.

    containment is the part of the distinct words of the evaluation caption that the training caption has; it is null
    for pairs that are not near. Null and blank captions are near nothing, and missing sounds equal nothing. Captions
    with fewer than `min_words` distinct words are near nothing. Each pair comes once, repeated rows pair each on
    their own. Classes with many members are expanded in slices, so no task makes all pairs of a class.
    """
    pairs, members = _found(rows, threshold, min_words)
    evals, trains = (members.where(F.col("side") == k).select("class", "id") for k in ("eval", "train"))
    every = member_pairs(pairs, evals, trains, "containment", "near", size=SLICE).withColumnsRenamed({"x": "e", "y": "t"})
    return every.groupBy("e", "t").agg(F.max("near").alias("near"), F.max(1 - F.col("near")).alias("same_sound"), F.max("containment").alias("containment"))


def overlap_report(rows: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs and distinct evaluation records for each evaluation split and source against each training split and source.

    Pairs are counted from the sizes of the classes, which takes no list of pairs: near pairs and pairs of one sound,
    less those that are both, which are counted from the classes parted by sound.
    """
    pairs, members = _found(rows, threshold, min_words)
    by = ["eval_split", "eval_source", "train_split", "train_source"]

    def counted(of: DataFrame, side: str, key: str, *more: str) -> DataFrame:
        name = "eval" if side == "eval" else "train"
        return of.where(F.col("side") == side).groupBy(F.col("class").alias(key), *more, F.col("split").alias(f"{name}_split"), F.col("source").alias(f"{name}_source")).agg(F.count("*").alias(f"n_{name}"))

    met = pairs.join(counted(members, "eval", "a"), "a").join(counted(members, "train", "b"), "b")
    product = F.sum(F.col("n_eval") * F.col("n_train"))
    single = met.groupBy(*by).agg(F.sum(F.when(F.col("near") == 1, F.col("n_eval") * F.col("n_train"))).alias("near_pairs"), F.sum(F.when(F.col("near") == 0, F.col("n_eval") * F.col("n_train"))).alias("sound_pairs"))
    sounds = members.where(F.col("class").startswith("sound ")).select("id", F.col("class").alias("sound"))
    parted = members.where(~F.col("class").startswith("sound ")).join(sounds, "id")
    near = pairs.where("near = 1")
    twice = near.join(counted(parted, "eval", "a", "sound"), "a").join(counted(parted, "train", "b", "sound"), ["b", "sound"]).groupBy(*by).agg(product.alias("both_pairs"))
    # an evaluation record counts once for each label that any of its classes meets
    labels = pairs.join(counted(members, "train", "b"), "b").select("a", "train_split", "train_source").distinct()
    reached = members.where("side = 'eval'").select("id", F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), F.col("class").alias("a")).join(labels, "a").select("id", *by).distinct()
    records = reached.groupBy(*by).agg(F.count("*").alias("eval_records"))
    zero = F.lit(0).cast("long")
    near_pairs, sound_pairs, both_pairs = (F.coalesce(c, zero) for c in ("near_pairs", "sound_pairs", "both_pairs"))
    return single.join(twice, by, "left").join(records, by).select(*by, (near_pairs + sound_pairs - both_pairs).alias("pairs"), "eval_records", near_pairs.alias("near_pairs"), sound_pairs.alias("same_sound_pairs"))
