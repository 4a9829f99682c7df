"""Near-duplicate records: one-permutation hashing with optimal densification, banded buckets, star edges.

The words of a text are thrown into `bands * rows` bins by one hash function; each bin keeps its least value
and an empty bin borrows from the bin that a second hash names, again and again until one is filled (optimal
densification). Bands of the bins are bucket keys. In a bucket of n members only stars are candidates: each
member with each of three centres, which hashes choose anew for every band, so a bucket gives at most 3n
pairs however full it is. A bucket that is full within one batch sends its star on from there, with its
centres as its only members, so no hot bucket gathers in a task. Candidates are tested exactly, and linked
rows are joined to groups.

Words of a large part of all texts say little and would fill buckets with strangers; they are left out of the
hashing, though not of the test. A text whose other words could agree too little with those of a near text, all
allowed edits being among them, is hashed whole as well, and with few other words only whole. Equal word sets are one class from the start; only its smallest key takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .sets import MIN_WORDS, THRESHOLD, member_pairs, verified, with_words

BANDS = 30
ROWS = 5
#: Bands and rows for texts that are hashed whole.
WHOLE = (36, 6)
#: Bands of either kind that are sent where the other kind does most: of the whole text if its other words must agree by UNSURE,
#: without the common words if they need not.
FEW = 14
#: Bits of the signature that must agree: each does with (1 + similarity) / 2, so at 0.75 about 2 in 100,000 pairs have fewer.
AGREE = 45
CENTRES = 3
#: Words in more than this share of the texts are left out of the hashing; at most (words a text) / COMMON such.
COMMON = 0.25
#: Other words that a text must have to be hashed without the common ones.
LEAST = 4
#: Similarity of the other words from which the bands alone find nearly every pair (0.996 at that similarity, more above).
SAFE = 0.7
UNSURE = 0.6
#: Members of a bucket in one batch from which the batch makes its star.
FULL = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def densified(flat: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One row per set (0 to n - 1, none empty) and one column per bin: its least hash, borrowed where it is empty.

    `flat` holds the words of all sets and `owner` the set of each.
    """
    hashed = _mix(flat.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    place = owner * bins + (hashed % np.uint64(bins)).astype(np.int64)
    out = np.full(n * bins, EMPTY, np.uint64)
    np.minimum.at(out, place, hashed // np.uint64(bins))
    filled = out != EMPTY
    todo = np.flatnonzero(~filled)
    attempt = 0
    columns = np.arange(bins, dtype=np.uint64)
    while len(todo):
        attempt += 1
        donor = (_mix(columns + np.uint64(attempt * 1_000_003)) % np.uint64(bins)).astype(np.int64)
        rows, cols = np.divmod(todo, bins)
        source = rows * bins + donor[cols]
        good = filled[source]
        out[todo[good]] = out[source[good]]
        todo = todo[~good]
    return out.reshape(n, bins)


def band_keys(flat: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int, seed: int) -> np.ndarray:
    """One row per set and one bucket key per band."""
    bins = densified(flat, owner, n, bands * rows)
    key = np.full((n, bands), seed, np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(31) + bins[:, r * bands : (r + 1) * bands])
    return _mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def _rank(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order in which the members of a bucket become centres: another one in every bucket."""
    return _mix(_mix(ids.view(np.uint64)) ^ keys.view(np.uint64))


def common_words(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of the words in more than COMMON of the texts of their part; at most (words a text) / COMMON a part."""
    sizes = {r["part"]: r["count"] for r in sets.groupBy("part").count().collect()}  # one row a part
    if not sizes:
        return np.array([], np.int64)
    least = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, COMMON * n)])
    found = sets.select("part", F.explode("words").alias("w")).groupBy("part", "w").count().where(F.col("count") > least[F.col("part")]).collect()
    return np.sort(np.array([r["w"] for r in found], np.int64))


def star_candidates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (a < b): each member of a bucket with each of its centres, once. `sets` has id, part and words."""
    stop = sets.sparkSession.sparkContext.broadcast(common_words(sets))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = stop.value
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                ids = part["id"].to_numpy(np.int64)
                size = part["words"].str.len().to_numpy(np.int64)
                flat, owner = np.concatenate(part["words"].to_list()).astype(np.int64), np.repeat(np.arange(len(part)), size)
                other = ~np.isin(flat, common)
                left = np.bincount(owner[other], minlength=len(part))
                keys, owners = [], []
                # a text near one with fewer than LEAST other words has at most so many itself; the other words of a near text
                # agree by 1 - size * (1 - threshold) / left at least, so of two that may agree less, both are hashed whole
                edits = size * (1 - threshold)
                unsafe = left < np.maximum(LEAST + edits, edits / (1 - SAFE))
                far = left < np.maximum(LEAST + edits, edits / (1 - UNSURE))
                for chosen, kept, (bands, rows), seed in ((left >= LEAST, other, (BANDS, ROWS), 1), (unsafe, np.ones(len(flat), bool), WHOLE, 2)):
                    n = int(chosen.sum())
                    if n:
                        number = np.cumsum(chosen) - 1
                        take = kept & chosen[owner]
                        k = band_keys(flat[take], number[owner[take]], n, bands, rows, seed)
                        sent = np.ones(k.shape, bool)
                        few = far if seed == 1 else ~far
                        sent[few[chosen], FEW:] = False
                        keys.append(k[sent].view(np.int64))
                        owners.append(np.repeat(ids[chosen], sent.sum(1)))
                if not keys:
                    continue
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.lexsort((_rank(key, owner), key))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                length = np.diff(np.r_[first, len(key)])
                run = np.repeat(np.arange(len(first)), length)
                inside = np.arange(len(key)) - first[run]
                stays = (length[run] < FULL) | (inside < CENTRES)
                yield pd.DataFrame({"key": key[stays], "id": owner[stays], "mate": pd.array([pd.NA] * int(stays.sum()), "Int64")})
                leave = np.flatnonzero(~stays)
                for c in range(CENTRES):
                    if len(leave):
                        yield pd.DataFrame({"key": key[leave], "id": owner[leave], "mate": pd.array(owner[first[run[leave]] + c], "Int64")})

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by key and rank: the first CENTRES of a key are its centres
        last: int | None = None
        centres: list[int] = []
        for batch in batches:
            if not len(batch):
                continue
            made = batch["mate"].notna().to_numpy()
            if made.any():
                yield pd.DataFrame({"x": batch["id"].to_numpy()[made], "y": batch["mate"].to_numpy()[made].astype(np.int64)})
            key, owner = batch["key"].to_numpy()[~made], batch["id"].to_numpy()[~made]
            if not len(key):
                continue
            if last is not None and key[0] == last:
                key, owner = np.r_[np.full(len(centres), last, np.int64), key], np.r_[np.array(centres, np.int64), owner]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[first, len(key)])
            run = np.repeat(np.arange(len(first)), length)
            inside = np.arange(len(key)) - first[run]
            for c in range(CENTRES):
                at = np.flatnonzero(inside > c)
                if len(at):
                    yield pd.DataFrame({"x": owner[at], "y": owner[first[run[at]] + c]})
            last = int(key[-1])
            centres = owner[first[-1] : first[-1] + CENTRES].tolist()

    rows = sets.select("id", "words").mapInPandas(keyed, "key long, id long, mate long")
    ranked = rows.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "id")).mapInPandas(stars, "x long, y long")
    return ranked.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, n, bits: the size of each set and one bit of each of 64 least hashes."""
    seeds = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        for start in range(0, len(batch), 2048):
            part = batch.iloc[start : start + 2048]
            size = part["words"].str.len().to_numpy(np.int64)
            flat = np.concatenate(part["words"].to_list()).view(np.uint64)
            first = np.r_[0, np.cumsum(size)[:-1]]
            bits = np.zeros(len(part), np.uint64)
            for i, seed in enumerate(seeds):
                least = np.minimum.reduceat((flat ^ seed) * np.uint64(0xBF58476D1CE4E5B9), first)
                bits |= (_mix(least) & np.uint64(1)) << np.uint64(i)
            yield pd.DataFrame({"id": part["id"].to_numpy(np.int64), "n": size.astype(np.int32), "bits": bits.view(np.int64)})


def near_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links between near word sets of different classes.

    Candidates are sifted twice before anything wide is moved: by a signature of 64 bits, then by sixteen bits of each word,
    with room for words that fall together; what is left is tested exactly.
    """
    num = 1 - 1e-9
    signed = written(sets.select("id", "words").mapInPandas(_signatures, "id long, n int, bits long"))
    left = signed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = signed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    close = (F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) <= 64 - AGREE) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold * num)
    first = star_candidates(sets, threshold).join(left, "a").join(right, "b").where(close).select("a", "b")
    short = sets.select("id", F.transform("words", lambda w: (w.bitwiseAND(F.lit(0xFFFF)) - 32768).cast("smallint")).alias("s"))
    both = first.join(short.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(short.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    shared = F.size(F.array_intersect("sa", "sb")) + 3 + small * large / 30_000
    sifted = written(both.where(shared >= (small + large - shared) * threshold).select("a", "b"))
    named = sifted.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return verified(sifted, sets.join(named, "id", "left_semi"), threshold)


def near_groups(tables: dict[str, tuple[DataFrame, Column, Column]], threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """table_name, id, group: the rows that belong to a group of at least two; group is the smallest key in it.

    `tables` holds, by name, a table with its key and its text; rows of different tables are never linked, they only
    go through the same steps. Null, empty and short texts (fewer than `min_words` distinct words) belong to no group. The
    key (BIGINT, times the number of tables still one) names a row; a row that is repeated with its key counts
    once. The table that comes out is written: what is made of it later does not make it again.
    """
    names = list(tables)
    spread = len(names)
    parts = []
    for n, (df, key, text) in enumerate(tables.values()):
        worded = with_words(df.where(key.isNotNull()), key, text, min_words=min_words)
        # words of different tables differ, and so do keys
        own = F.lit(n * 0x1F3D5B79A8642CE1 % (1 << 63))
        own_words = F.transform("words", lambda w: w.bitwiseXOR(own))
        parts.append(worded.select((F.col("id") * spread + n).alias("id"), F.lit(n).alias("part"), own_words.alias("words"), F.xxhash64(F.lit(n), "h1").alias("h1"), "h2"))
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    # written once: every later step reads the columns it needs, and texts are cut into words a single time
    worded = written(together)
    hashed = worded.select("id", "h1", "h2")
    copied = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    # copies alone are named: nearly every text is its class
    members = written(hashed.join(copied.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct())
    sets = worded.join(members.where("id <> rep").select("id"), "id", "left_anti").select("id", "part", "words")
    nodes = written(components(written(near_links(sets, threshold))).select(F.col("id").alias("rep"), F.col("component").alias("group")))
    copies = members.join(nodes, "rep", "left").select("id", "rep", F.coalesce("group", "rep").alias("group"))
    copied_reps = copies.where("id <> rep").select("rep").distinct()
    found = copies.where("id <> rep").select("id", "group").unionByName(nodes.select(F.col("rep").alias("id"), "group"))
    # representatives that only copies are linked with
    alone = copied_reps.join(nodes, "rep", "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("group"))
    named = F.element_at(F.array(*map(F.lit, names)), F.pmod("id", F.lit(spread)).cast("int") + 1)

    def plain(c: str) -> Column:
        return F.expr(f"(`{c}` - pmod(`{c}`, {spread})) div {spread}")

    return written(found.unionByName(alone).select(named.alias("table_name"), plain("id").alias("id"), plain("group").alias("group")))


def group_pairs(groups: DataFrame) -> DataFrame:
    """table_name, id_a, id_b: every pair of rows of a group, the smaller key first; large groups are paired slice by slice."""
    members = groups.select(F.concat_ws("/", "table_name", F.col("group").cast("string")).alias("class"), "id")
    whole = groups.groupBy("table_name", F.concat_ws("/", "table_name", F.col("group").cast("string")).alias("a")).agg(F.count("*").alias("n")).select("table_name", "a", F.col("a").alias("b"))
    return member_pairs(whole, members, members, "table_name").where("x < y").select("table_name", F.col("x").alias("id_a"), F.col("y").alias("id_b"))


def caption_text() -> Column:
    """All texts of the array as one."""
    return F.array_join("captions", "\n")
