"""The most similar vectors of every vector, by shifted Hilbert curves.

Every usable vector is put on `ORDERINGS` orderings; each turns the space anew. An ordering goes through cells of the
space: a vector is in the cell of the direction that it lies furthest along (either way), which parts rows at random far
better than it parts similar ones. Within a cell rows follow a shifted Hilbert curve over `DIMS` directions, each spread
evenly over a grid. Rows of an ordering are range partitioned by their place (bounds come from a sample), and a window of `WINDOW` rows is compared with itself and the next
one in one matrix product. To spare the shuffle, rows travel as one byte per part; the bytes decide only which
pairs are computed exactly. A row keeps all its partners of a window up to `KEEP`; the partners of all orderings
merge, and exact double precision cosines rank them again.

A row with more partners than that is crowded: bytes cannot tell which of them are the best. A pair is in
question only if both its rows are crowded, for the other one keeps it otherwise. Crowded rows are therefore
searched once more among themselves, with whole vectors and double precision, in windows of `CROWD` rows; up to
two windows of crowded rows in a bundle this compares all of them.

Vectors that repeat exactly are one class, searched once, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, usable
from ..session import written

ORDERINGS = 10
DIMS = 8
#: Directions that name cells at most: a cell and the first half of a place share 64 bits.
CELL_DIMS = 1 << 14
#: Bits of a direction in the two halves of a place: crowds far tighter than the whole are still spread out.
HIGH, LOW = 6, 7
WINDOW = 1024
KEEP = 12
#: Rows of a window in the search among crowded rows, and rows of it that are compared at once.
CROWD = 16_384
SLICE = 256
#: A cosine from bytes is off by less than this.
SLACK = 0.006
#: Vectors that bounds of partitions are taken from at most, and rows of a partition from which more partitions are made than the session has.
BOUND_ROWS = 8_192
PARTITION_ROWS = 500_000
#: Copies of one vector that one task gives their partners.
COPIES = 20_000
#: Vectors that a spread is fitted on at most; every row is indexed.
FIT_ROWS = 100_000
SEED = 7
FOUND = "src long, dst long, score double"


def _gray(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells (one row each, `bits` bits a column), turned so that their bits, interleaved, are the place on the Hilbert curve.

    After J. Skilling, Programming the Hilbert curve (2004): undo the excess turns from the highest bit down,
    Gray-encode, and interleave the bits.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(n):
            swap = (x[0] ^ x[i]) & low
            turn = (x[i] & high) != 0
            x[0] ^= np.where(turn, low, swap)
            if i:
                x[i] ^= np.where(turn, np.uint32(0), swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint32(bit)) & np.uint32(1), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    return x


def _interleaved(x: np.ndarray, high: int, low: int) -> np.ndarray:
    """The bits from `high` (not with it) down to `low` of all columns, as whole numbers."""
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(high - 1, low - 1, -1):
        for column in x:
            place = (place << 1) | ((column >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return place


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid cells (one row each, `bits` bits a column) on the Hilbert curve, as whole numbers."""
    return _interleaved(_gray(cells, bits), bits, 0)


def _turns(dim: int, orderings: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions (dim x orderings * dim) and shifts of the curves (orderings x at most DIMS)."""
    rng = np.random.default_rng(SEED)
    turns = np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(orderings)])
    return turns, rng.random((orderings, min(DIMS, dim))) * 0.25


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread(vectors: DataFrame, turns: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the projections, from FIT_ROWS rows at most of the `count` (a hash picks them)."""
    share = min(1.0, FIT_ROWS / max(1, count))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    width = turns.shape[1]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            if len(batch):
                y = _unit(batch["embedding"]) @ turns
                n, s, q = n + len(y), s + y.sum(0), q + np.einsum("ij,ij->j", y, y)
        yield pd.DataFrame({"at": np.arange(width), "n": np.full(width, n), "s": s, "q": q})

    sums = chosen.select("embedding").mapInPandas(moments, "at int, n long, s double, q double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    got = sums.orderBy("at").toPandas()  # one row per projection
    n = max(1, int(got["n"].max())) if len(got) else 1
    s, q = (got["s"].to_numpy(), got["q"].to_numpy()) if len(got) else (np.zeros(width), np.ones(width))
    mean = s / n
    return mean, np.sqrt(np.maximum(q / n - mean * mean, 1e-12))


def _keys(place: np.ndarray, finer: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place, its finer half and key as strings of bytes that sort as they do."""
    parts = [place.astype(np.uint64), finer.astype(np.uint64), ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)]
    # high bytes first, and only here: stacking turns bytes back into the machine's order
    return np.ascontiguousarray(np.stack(parts, axis=1).astype(">u8")).view("S24").ravel()


def _bounds(sample: pd.DataFrame, rows: int, window: int, most: int) -> tuple[dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]], int]:
    """How the runs are cut into partitions, and how many there are: for each bundle and ordering the first partition, the
    keys that the next ones start at, and for each of those the key up to which its rows go to the partition before, too.

    `sample` has bundle, ordering, place, finer and vec_id of some vectors, `rows` are all rows that will come.
    """
    out: dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]] = {}
    first = 0
    for name, run in sample.groupby(["bundle", "ordering"], sort=True):
        keys = np.sort(_keys(run["place"].to_numpy(), run["finer"].to_numpy(), run["vec_id"].to_numpy()))
        expected = rows * len(keys) / len(sample)
        parts = int(max(1, min(expected // (4 * window), max(1, most * len(keys) / len(sample)), len(keys))))
        at = (np.arange(1, parts) * len(keys)) // parts
        step = int(np.ceil(window * len(keys) / max(1.0, expected)))
        out[name] = (first, keys[at], keys[np.minimum(at + step, len(keys) - 1)])
        first += parts
    return out, max(1, first)


def _placed(vectors: DataFrame, orderings: int, dim: int, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """bundle, ordering, place (cell and place on its curve) and its finer half, vec_id, code: each vector once for each ordering, in partitions that are sorted along the curves.

    code is bytes, or `whole` floats. Bounds of the partitions come from BOUND_ROWS vectors at most; a bound lies between two
    rows even if their places are equal. The first window of a partition is given to the one before as well, so that
    neighbouring windows meet wherever a run is cut.
    """
    turns, shifts = _turns(dim, orderings)
    count = vectors.count()
    mean, deviation = _spread(vectors, turns, count)
    width = shifts.shape[1]
    levels = 1 << (HIGH + LOW)

    def placed(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x = _unit(part["embedding"])
        for o in range(orderings):
            own = slice(o * dim, (o + 1) * dim)
            y = (x @ turns[:, own] - mean[own]) / deviation[own]
            far = np.abs(y[:, :CELL_DIMS]).argmax(1)
            cell = 2 * far + (y[np.arange(len(y)), far] < 0)
            even = 1.0 / (1.0 + np.exp(-1.702 * y[:, :width]))
            g = _gray(np.minimum((even * 0.75 + shifts[o]) * levels, levels - 1).astype(np.uint32), HIGH + LOW)
            yield o, (cell.astype(np.int64) << (HIGH * width)) | _interleaved(g, HIGH + LOW, LOW), _interleaved(g, LOW, 0), x

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                for o, place, finer, _ in placed(part):
                    yield pd.DataFrame({"bundle": part["bundle"], "ordering": np.full(len(part), o, np.int32), "place": place, "finer": finer, "vec_id": part["vec_id"]})

    share = min(1.0, BOUND_ROWS / max(1, count))
    few = vectors.where(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    known = few.mapInPandas(sampled, "bundle string, ordering int, place long, finer long, vec_id long").toPandas()  # BOUND_ROWS * orderings rows
    rows = count * orderings
    most = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PARTITION_ROWS)
    bounds, parts = _bounds(known, rows, window, most)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                bundle, ids, codes = part["bundle"].to_numpy(), part["vec_id"].to_numpy(), None
                for o, place, finer, x in placed(part):
                    if codes is None:
                        if whole:
                            codes = np.array([np.asarray(v, np.float32).tobytes() for v in part["embedding"]], object)
                        else:
                            codes = np.array([c.tobytes() for c in np.rint(x * (127.0 / np.abs(x).max(1, keepdims=True))).astype(np.int8)], object)
                    keys = _keys(place, finer, ids)
                    target, before = np.zeros(len(part), np.int32), np.full(len(part), -1, np.int32)
                    for name in np.unique(bundle):
                        mine = np.flatnonzero(bundle == name)
                        first, cuts, ends = bounds.get((name, o), (zlib.crc32(f"{name}/{o}".encode()) % parts, np.array([], "S24"), None))
                        p = np.searchsorted(cuts, keys[mine], "right")
                        target[mine] = first + p
                        inner = np.flatnonzero(p)
                        early = inner[keys[mine[inner]] < ends[p[inner] - 1]] if len(inner) else inner
                        before[mine[early]] = first + p[early] - 1
                    again = np.flatnonzero(before >= 0)
                    at = np.r_[np.arange(len(part)), again]
                    yield pd.DataFrame({"target": np.r_[target, before[again]], "bundle": bundle[at], "ordering": np.full(len(at), o, np.int32), "place": place[at], "finer": finer[at], "vec_id": ids[at], "code": codes[at]})

    made = vectors.mapInPandas(make, "target int, bundle string, ordering int, place long, finer long, vec_id long, code binary")
    return made.repartitionById(parts, "target").sortWithinPartitions("bundle", "ordering", "place", "finer", "vec_id").drop("target")


def _by_bytes(least: float, keep: int):
    """Partners from bytes: all that reach the least cosine, or of a crowded row the best `keep` and the row itself as a mark."""

    def best(x: np.ndarray, rows: np.ndarray, y: np.ndarray, columns: np.ndarray) -> Iterator[pd.DataFrame]:
        score = x @ y.T
        if rows is columns:
            np.fill_diagonal(score, -2.0)
        ok = score >= least
        count = ok.sum(1)
        r, c = np.nonzero(ok[count <= keep])
        few = np.flatnonzero(count <= keep)
        src, dst, val = [rows[few[r]]], [columns[c]], [score[few[r], c]]
        many = np.flatnonzero(count > keep)
        if len(many):
            s = np.where(ok[many], score[many], -2.0)
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            src += [np.repeat(rows[many], keep), rows[many]]
            dst += [columns[top].ravel(), rows[many]]
            val += [np.take_along_axis(s, top, 1).ravel(), np.full(len(many), 2.0)]
        made = pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "score": np.concatenate(val).astype(np.float64)})
        if len(made):
            yield made

    return best


def _by_value(least: float, keep: int):
    """Partners from whole vectors: the best `keep` by cosine, rounded as it is told, then by smaller key."""

    def best(x: np.ndarray, rows: np.ndarray, y: np.ndarray, columns: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(columns)
        y, named = y[order].T, columns[order]
        later = np.arange(len(named))[::-1]
        for start in range(0, len(rows), SLICE):
            score = np.rint((x[start : start + SLICE] @ y) * 1e6)
            if rows is columns:
                score[named[None, :] == rows[start : start + SLICE, None]] = -2e6
            if len(named) > keep:
                top = np.argpartition(-(score * len(named) + later), keep - 1, axis=1)[:, :keep]
            else:
                top = np.broadcast_to(np.arange(len(named)), score.shape)
            value = np.take_along_axis(score, top, 1)
            r, c = np.nonzero(value >= least * 1e6 - 1)
            if len(r):
                yield pd.DataFrame({"src": rows[start + r], "dst": named[top[r, c]], "score": value[r, c] / 1e6})

    return best


def _windows(best, size: int, part: type):
    """Candidates of neighbouring windows along the curves; rows come sorted by bundle, ordering and place."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the run that are in no window yet
        waiting = 0
        last: tuple[np.ndarray, np.ndarray] | None = None
        run = None

        def window() -> tuple[np.ndarray, np.ndarray]:
            nonlocal held, waiting
            ids = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            held = [(ids[size:], x[size:])] if len(ids) > size else []
            waiting = max(0, len(ids) - size)
            return ids[:size], x[:size]

        def compare(now: tuple[np.ndarray, np.ndarray]) -> Iterator[pd.DataFrame]:
            yield from best(now[1], now[0], now[1], now[0])
            if last is not None:
                yield from best(last[1], last[0], now[1], now[0])
                yield from best(now[1], now[0], last[1], last[0])

        for batch in batches:
            if not len(batch):
                continue
            ids = batch["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(batch["code"]), part).reshape(len(ids), -1).astype(np.float32 if part is np.int8 else np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            named = batch["bundle"].to_numpy() + "/" + batch["ordering"].astype(str).to_numpy()
            cuts = [0, *(np.flatnonzero(named[1:] != named[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if named[a] != run:
                    while waiting:
                        now = window()
                        yield from compare(now)
                        last = now
                    run, last, held, waiting = named[a], None, [], 0
                held.append((ids[a:b], x[a:b]))
                waiting += b - a
                while waiting >= 2 * size:
                    now = window()
                    yield from compare(now)
                    last = now
        while waiting:
            now = window()
            yield from compare(now)
            last = now

    return make


def _within_crowds(crowd: DataFrame, k: int, least: float, dim: int, orderings: int) -> DataFrame | None:
    """src, dst: the best partners of crowded rows among crowded rows, from whole vectors."""
    largest = crowd.groupBy("bundle").count().agg(F.max("count")).first()[0]
    if largest is None:
        return None
    # two windows meet in any ordering, so one is enough for them
    near = _placed(crowd, 1 if largest <= 2 * CROWD else orderings, dim, CROWD, whole=True).select("bundle", "ordering", "vec_id", "code").mapInPandas(_windows(_by_value(least, k + 1), CROWD, np.float32), FOUND)
    top = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
    merged = near.groupBy("src", "dst").agg(F.max("score").alias("score"))
    return merged.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("src", "dst")


def similar_vectors(df: DataFrame, k: int = 5, least: float = 0.85, dim: int = 96, orderings: int = ORDERINGS) -> DataFrame:
    """vec_id, other, cosine, rnk: up to `k` most similar other vectors of the same bundle for every usable vector.

    `df` has vec_id (BIGINT), bundle and embedding. Cosines are rounded to six decimals; those under `least` do
    not appear; equal ones rank by smaller vec_id. Vectors that are null, not `dim` long, all zero, or hold a
    null, NaN or infinite part take no part, and neither do rows with a null bundle. `vec_id` is a key.
    """
    rows = df.select("vec_id", "bundle", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("bundle").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding", dim))
    hashed = rows.select("vec_id", "bundle", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("h2"))
    same = ["bundle", "h1", "h2"]
    reps = hashed.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # only copies are named again: most vectors are their class
    copied = reps.where("copies > 1").select(*same, "rep")
    members = written(hashed.join(copied, same).select("vec_id", "rep"))
    vectors = rows.join(members.where("vec_id <> rep").select("vec_id"), "vec_id", "left_anti")

    keep = max(KEEP, 2 * k)
    near = _placed(vectors, orderings, dim, WINDOW).select("bundle", "ordering", "vec_id", "code").mapInPandas(_windows(_by_bytes(least - SLACK, keep), WINDOW, np.int8), FOUND)
    # merged over the orderings, still directed; a row that is its own partner is marked as crowded
    merged = written(near.groupBy("src", "dst").agg(F.max("score").alias("score")))
    top = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
    chosen = merged.where("src <> dst").withColumn("r", F.row_number().over(top)).where(F.col("r") <= keep).select("src", "dst")
    crowded = merged.groupBy("src").agg(F.count("*").alias("n"), F.max(F.col("src") == F.col("dst")).alias("marked")).where((F.col("n") > keep) | F.col("marked")).select(F.col("src").alias("vec_id"))
    inside = _within_crowds(written(vectors.join(crowded, "vec_id", "left_semi")), k, least, dim, orderings)
    if inside is not None:
        chosen = chosen.unionByName(inside)
    pairs = chosen.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    right = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    exact = pairs.join(left, "a").join(right, "b").select("a", "b", F.round(dot("va", "vb") / (norm("va") * norm("vb")), 6).alias("cosine")).where(F.col("cosine") >= least)
    exact = written(exact)

    # of a class, the k + 1 smallest keys are all that can rank
    smallest = Window.partitionBy("rep").orderBy("vec_id")
    first = members.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1).select(F.col("rep").alias("dst"), F.col("vec_id").alias("other"))
    directed = exact.select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine").unionByName(exact.select(F.col("b").alias("src"), F.col("a").alias("dst"), "cosine"))
    own = members.where("vec_id = rep").select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("cosine"))
    others = directed.unionByName(own).join(first, "dst", "left").select("src", F.coalesce("other", "dst").alias("other"), "cosine")
    # k + 1 partners are all that a class can need; copies of one vector are spread over tasks
    best = Window.partitionBy("src").orderBy(F.desc("cosine"), F.asc("other"))
    others = others.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    sizes = members.groupBy(F.col("rep").alias("src")).agg(F.ceil(F.count("*") / COPIES).cast("int").alias("n"))
    all_rows = members.select(F.col("rep").alias("src"), "vec_id").join(sizes, "src").select("src", "vec_id", F.pmod(F.xxhash64("vec_id"), "n").cast("int").alias("part"))
    spread = others.join(sizes, "src", "left").select("src", "other", "cosine", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("part"))
    expanded = spread.join(all_rows, ["src", "part"], "left").select(F.coalesce("vec_id", "src").alias("vec_id"), "other", "cosine").where("vec_id <> other")
    ranked = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), F.asc("other"))
    return expanded.withColumn("rnk", F.row_number().over(ranked)).where(F.col("rnk") <= k)


def similar_pairs(similar: DataFrame) -> DataFrame:
    """id_a, id_b: the pairs of which one is among the most similar of the other, once, smaller key first."""
    return similar.select(F.least("vec_id", "other").alias("id_a"), F.greatest("vec_id", "other").alias("id_b")).distinct()
