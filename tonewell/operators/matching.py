"""Joins by alias, by first existing candidate, and by similarity of word sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def alias_join(keys: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """keys with match and how: `exact`, else the part before the first underscore (`prefix`), else what follows it (`suffix`).

    Keys that match in no way have nulls. `known` has distinct values of `name`.
    """
    first = F.substring_index(F.col(key), "_", 1)
    rest = F.when(F.instr(F.col(key), "_") > 0, F.expr(f"substr(`{key}`, instr(`{key}`, '_') + 1)"))
    options = F.array(F.struct(F.lit(1).alias("p"), F.col(key).alias("v")), F.struct(F.lit(2).alias("p"), first.alias("v")), F.struct(F.lit(3).alias("p"), rest.alias("v")))
    tried = keys.select(key).distinct().select(key, F.explode(options).alias("o")).select(key, "o.p", "o.v")
    hits = tried.join(known.select(F.col(name).alias("v")).distinct(), "v").groupBy(key).agg(F.min(F.struct("p", "v")).alias("m"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("suffix")), F.col("m.p"))
    return keys.join(hits.select(key, F.col("m.v").alias("match"), how.alias("how")), key, "left")


def first_existing(candidates: DataFrame, key: str, paths: str, files: DataFrame, path: str) -> DataFrame:
    """`key`, found: the first of an array of candidate paths that is among the files; keys without one are left out."""
    tried = candidates.select(key, F.posexplode(paths).alias("_p", "_v"))
    return tried.join(files.select(F.col(path).alias("_v")).distinct(), "_v").groupBy(key).agg(F.min_by("_v", "_p").alias("found"))


def lookup_mean(queries: DataFrame, text: str, table: DataFrame, table_text: str, vec: str) -> DataFrame:
    """queries with vec: the mean of the vectors whose text equals the query's, made unit length; null if none does."""
    from ..functions.vectors import unit

    parts = table.select(F.col(table_text).alias("_t"), F.posexplode(F.col(vec).cast("array<double>")).alias("at", "x")).groupBy("_t", "at").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("m"))
    return queries.join(mean.select(F.col("_t").alias(text), unit("m").alias("vec")), text, "left")


#: Cells of the table of term frequencies that orders the terms; its size does not depend on the data.
CELLS = 1 << 20
#: Combinations that a set has at most where n is 3, and where n is 2.
MOST = (60, 120)


def _zones(exact: Fraction) -> list[tuple[int, int, int]]:
    """n, and the sizes (above and up to) of the larger set of a pair that combinations of n terms are for.

    Sets so small that fewer than n terms may be all they share, and sets with too many combinations, have single terms.
    """
    def spare(size: int) -> int:
        return size + (-size * exact.numerator) // exact.denominator

    low = int(2 / exact)
    out = [(1, 0, low)]
    for n, most in zip((3, 2), MOST):
        size = low
        while size < 4_096 and math.comb(spare(size + 1) + n, n) <= most:
            size += 1
        if size > low:
            out.append((n, low, size))
        low = size
    return [*out, (1, low, 1 << 31)]


def _grams(sets: DataFrame, key: str, terms: str, often: np.ndarray, exact: Fraction) -> DataFrame:
    """key, gram: hashes of the combinations of n of the rarest terms of each set."""
    kind = sets.schema[key].dataType.simpleString()
    shared, zones = sets.sparkSession.sparkContext.broadcast(often), _zones(exact)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        picks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            at, grams = [], []
            for place, words in enumerate(batch["w"]):
                size = len(words)
                order = words[np.lexsort((words, of[words & (CELLS - 1)]))].view(np.uint64)
                spare = size + (-size * exact.numerator) // exact.denominator
                for n, low, most in zones:
                    k = min(size, spare + n)
                    if not low * exact < size <= most or k < n:
                        continue
                    if (n, k) not in picks:
                        picks[n, k] = np.array(list(combinations(range(k), n)), np.int64).T
                    h = np.full(picks[n, k].shape[1], n, np.uint64)
                    for c in np.sort(order[picks[n, k]], axis=0):  # a combination is a set: in hash order both sides agree
                        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
                        h ^= h >> np.uint64(29)
                    at.append(np.full(len(h), place, np.int64))
                    grams.append(h.view(np.int64))
            if at:
                yield pd.DataFrame({key: batch[key].to_numpy()[np.concatenate(at)], "gram": np.concatenate(grams)})

    return sets.select(key, F.transform(terms, lambda t: F.xxhash64(t)).alias("w")).mapInPandas(make, f"{key} {kind}, gram long")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of all pairs of `left` and `right` (id, terms) whose sets of terms are at least that similar.

    Terms are put in one order, rarest first; two sets can only be so similar if they share n of their first
    size - ceil(threshold size) + n terms. Only sets that share a combination of n of them are joined, so frequent terms never
    meet, and neither do sets that one rare term alone has in common. Empty sets are similar to nothing.
    """
    exact = Fraction(threshold).limit_denominator(10_000)
    a = left.select(F.col("id").alias("a"), F.array_distinct("terms").alias("ta")).where(F.size("ta") > 0)
    b = right.select(F.col("id").alias("b"), F.array_distinct("terms").alias("tb")).where(F.size("tb") > 0)
    terms = a.select(F.explode("ta").alias("t")).unionAll(b.select(F.explode("tb").alias("t")))
    cell = F.xxhash64("t").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = terms.groupBy(cell.alias("cell")).count().toPandas()  # CELLS rows at most
    often = np.zeros(CELLS, np.int64)
    often[counts["cell"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    pairs = _grams(a, "a", "ta", often, exact).hint("merge").join(_grams(b, "b", "tb", often, exact), "gram").select("a", "b").distinct()
    shared = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("jaccard"))
    return both.where(F.col("jaccard") >= threshold)


def best_similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard: best_match of similar_sets, with equal sets of a side compared once, however many there are.

    Of equal sets of `right` only the smallest key can be the best partner.
    """
    def classes(df: DataFrame) -> DataFrame:
        terms = F.array_sort(F.array_distinct("terms"))
        return df.select("id", terms.alias("terms")).where(F.size("terms") > 0).select("id", "terms", F.xxhash64("terms").alias("h1"), F.xxhash64(F.lit(1), "terms").alias("h2"))

    def named(df: DataFrame) -> DataFrame:
        return df.groupBy("h1", "h2").agg(F.min("id").alias("id"))

    rows, others = classes(left), classes(right)
    reps = written(named(rows))
    one = written(rows.join(reps.select("id"), "id", "left_semi").select("id", "terms"))
    two = written(others.join(named(others).select("id"), "id", "left_semi").select("id", "terms"))
    best = best_match(similar_sets(one, two, threshold))
    of = reps.withColumnRenamed("id", "a").join(best, "a").select("h1", "h2", "b", "jaccard")
    return rows.select(F.col("id").alias("a"), "h1", "h2").join(of, ["h1", "h2"]).select("a", "b", "jaccard")


def best_match(pairs: DataFrame, by: str = "a", other: str = "b") -> DataFrame:
    """The most similar partner of each `by`, the smaller key on ties."""
    return pairs.groupBy(by).agg(F.max_by(F.struct(other, "jaccard"), F.struct("jaccard", (-F.col(other)).alias("_o"))).alias("m")).select(by, F.col("m")[other].alias(other), F.col("m.jaccard").alias("jaccard"))


#: Rows of the pool and of the queries that one cell of similar_examples holds at most, about, and terms of the pool it takes at once.
POOL_BLOCK = 196_608
QUERY_BLOCK = 131_072
POOL_SLICE = 1 << 21
#: Queries below which a cell is not split for more tasks.
LEAST_QUERIES = 4_096
#: Shares of POOL_SLICE at which the first slices end: they find the first bounds.
FIRST = (1 / 128, 1 / 8)
#: Terms that more than this share of a slice's rows have are flags of all rows, others lists of their rows.
FREQUENT = 1 / 512
#: Terms that more than this share of a slice's rows have, 64 at most, are added up once for all queries that have the same of them.
COMMON = 1 / 20
#: Words of 64 flags, and rows, that are looked at singly at once.
FLAGS_AT_ONCE = 1 << 15
HITS_AT_ONCE = 1 << 16


def _flat(terms: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists of hashed terms, and all their terms one after another; null is an empty list."""
    lists = [np.empty(0, np.int64) if t is None else np.asarray(t, np.int64) for t in terms]
    return np.array([len(x) for x in lists], np.int64), np.concatenate([np.empty(0, np.int64), *lists])


def _some(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a list of lists that begin at `at` of all that the lists `which` hold, and the number of each list."""
    n = at[which + 1] - at[which]
    return np.arange(n.sum()) + np.repeat(at[which] - np.r_[0, np.cumsum(n)[:-1]], n), n


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as words of 64."""
    bits = np.packbits(flags, axis=-1, bitorder="little")
    return np.pad(bits, [(0, 0)] * (flags.ndim - 1) + [(0, -bits.shape[-1] % 8)]).view(np.uint64)


def _overflow(levels: list[list[np.ndarray]]) -> np.ndarray:
    """Flags of the rows whose sum, given as flags of ones, twos, fours and so on, needs a further digit."""
    carried: list[np.ndarray] = []
    for level in levels:
        flags, carried = level + carried, []
        while len(flags) > 2:
            a, b, c = flags.pop(), flags.pop(), flags.pop()
            odd = a ^ b
            a = a & b
            b = odd & c
            b |= a
            carried.append(b)
            if flags:  # the last digit itself is not asked for
                odd ^= c
                flags.insert(0, odd)
        if len(flags) == 2:
            carried.append(flags[0] & flags[1])
    out = carried[0] if carried else np.zeros_like(levels[0][0])
    for c in carried[1:]:
        out = out | c
    return out


def _digits(flags: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of flags: flags of ones, twos, fours and so on."""
    out: list[np.ndarray] = []
    for carry in flags:
        for x, plane in enumerate(out):
            out[x], carry = plane ^ carry, plane & carry
        if (1 << len(out)) <= len(flags):
            out.append(carry)
    return out


def _best_shared(terms_q: pd.Series, terms_p: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, place in the pool and jaccard of the k best of the pool for each query, earlier ones first on ties.

    Rows stand by size. A row of size n is better than a query's k-th best so far if it shares need(n) terms; terms are flags
    of rows, 64 in a word, and added up digit by digit for all rows that may be large enough, to a sum that overflows where
    need is reached.
    """
    nq, words = _flat(terms_q)
    codes, known = pd.factorize(words)
    at_q = np.r_[0, np.cumsum(nq)]
    sizes, words = _flat(terms_p)
    words = pd.Index(known).get_indexer(words).astype(np.int32) if len(known) else np.full(len(words), -1, np.int32)
    at = np.r_[0, np.cumsum(sizes)]
    ends = np.r_[np.multiply(FIRST, POOL_SLICE), np.arange(POOL_SLICE, at[-1], POOL_SLICE)]
    cuts = np.unique(np.r_[0, at.searchsorted(ends[ends < at[-1]]), len(sizes)]).tolist()
    got_p, got_j = np.full((len(nq), k), -1), np.full((len(nq), k), -1.0)

    def better(i: np.ndarray, p: np.ndarray, j: np.ndarray) -> None:
        """Takes up rows of the pool, none of them before."""
        who = np.unique(i)
        i, p, j = np.r_[np.repeat(who, k), i], np.r_[got_p[who].ravel(), p], np.r_[got_j[who].ravel(), j]
        order = np.lexsort((p, -j, i))
        i, p, j = i[order], p[order], j[order]
        rank = np.arange(len(i)) - np.repeat(i.searchsorted(who), np.diff(np.r_[i.searchsorted(who), len(i)]))
        first = rank < k
        got_p[i[first], rank[first]], got_j[i[first], rank[first]] = p[first], j[first]

    for first, end in zip(cuts[:-1], cuts[1:]):
        by_size = np.argsort(sizes[first:end], kind="stable")
        n, place = sizes[first:end][by_size], np.empty(end - first, np.int32)
        place[by_size] = np.arange(end - first)
        c, r = words[at[first] : at[end]], np.repeat(place, sizes[first:end])
        key = np.sort((c[c >= 0].astype(np.int64) << 32) | r[c >= 0])  # terms, and their rows
        start = key.searchsorted(np.arange(len(known) + 1) << 32)
        rows, count = (key & 0xFFFFFFFF).astype(np.int32), np.diff(start)
        low = got_j[:, -1].copy()  # the k-th best so far

        starts = start.tolist()
        for i in np.flatnonzero(low < 0).tolist():
            lists = [rows[starts[t] : starts[t + 1]] for t in codes[at_q[i] : at_q[i + 1]].tolist()]
            shared = np.bincount(np.concatenate([np.empty(0, np.int32), *lists]), minlength=len(n))
            j = shared / np.maximum(nq[i] + n - shared, 1)
            found = np.flatnonzero(j >= np.partition(j, -k)[-k]) if len(j) > k else np.arange(len(j))
            p, j = np.r_[got_p[i], first + by_size[found]], np.r_[got_j[i], j[found]]
            order = np.lexsort((p, -j))[:k]
            got_p[i], got_j[i] = p[order], j[order]

        todo = np.flatnonzero((low >= 0) & (low < 1) & (nq > 0))
        if not len(todo):
            continue
        column = np.full(len(known), -1)
        frequent = np.flatnonzero(count > FREQUENT * len(n))
        column[frequent] = np.arange(len(frequent))
        flags = np.zeros((len(frequent), -(-len(n) // 64)), np.uint64)
        for x, t in enumerate(frequent.tolist()):
            one = np.zeros(len(n), bool)
            one[rows[starts[t] : starts[t + 1]]] = True
            flags[x] = _packed(one)
        usual = np.argsort(-count, kind="stable")[:64]
        usual = usual[count[usual] > COMMON * len(n)]
        bit = np.zeros(len(known), np.uint64)
        bit[usual] = np.uint64(1) << np.arange(len(usual), dtype=np.uint64)
        has = np.zeros(len(n), np.uint64)
        for t in usual.tolist():
            has[rows[starts[t] : starts[t + 1]]] |= bit[t]
        total = np.r_[np.uint64(0), np.cumsum(bit[codes], dtype=np.uint64)]
        asks = total[at_q[1:]] - total[at_q[:-1]]  # different bits: their sum is their union
        single_terms = (bit[codes] == 0) & (count[codes] > 0)
        at_rest, rest = np.r_[0, np.cumsum(single_terms)][at_q], codes[single_terms]
        ends_rest, listed, columns = at_rest.tolist(), rest.tolist(), column.tolist()
        each, width = np.unique(n, return_counts=True)

        def single(hits: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            """Counts in truth what the rows share whose flags are set."""
            i = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
            word, bits = np.concatenate([h[1] for h in hits]), np.concatenate([h[2] for h in hits])
            which, place_in = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, row = i[which], word[which] * 64 + place_in
            for part in range(0, len(i), HITS_AT_ONCE):
                who, at_row = i[part : part + HITS_AT_ONCE], row[part : part + HITS_AT_ONCE]
                places, m = _some(at_rest, who)
                pair, term = np.repeat(np.arange(len(who)), m), rest[places]
                often = column[term] >= 0
                of = at_row[pair[often]]
                found = (flags[column[term[often]], of >> 6] >> (of & 63).astype(np.uint64)) & np.uint64(1)
                shared = np.bincount(pair[often], found, len(who)) + np.bitwise_count(has[at_row] & asks[who])
                pair, term = pair[~often], term[~often]
                wanted = (term.astype(np.int64) << 32) | at_row[pair]
                shared += np.bincount(pair[key[np.minimum(key.searchsorted(wanted), len(key) - 1)] == wanted], minlength=len(who))
                better(who, first + by_size[at_row], shared / (nq[who] + n[at_row] - shared))

        digits: dict[tuple[int, float], tuple[int, int, np.ndarray] | None] = {}
        last, counted, hits, waiting, view, over, base = None, (None, []), [], 0, flags, None, None
        todo = todo[np.lexsort((low[todo], nq[todo], asks[todo]))]
        for i, ask, m, reach in zip(todo.tolist(), asks[todo].tolist(), nq[todo].tolist(), low[todo].tolist()):
            if last != (ask, m, reach):
                last, base = (ask, m, reach), None
                if (m, reach) not in digits:
                    if len(digits) > 255:
                        digits.clear()
                    lo = int(n.searchsorted(math.floor(reach * m + 1e-9) + 1))
                    hi = int(n.searchsorted(math.ceil(m / reach - 1e-9))) if reach else len(n)
                    digits[m, reach] = None
                    if lo < hi:  # a row must be better than the k-th best: of equal ones the earlier is kept
                        need = np.clip(np.floor(reach * (m + each) / (1 + reach) + 1e-9) + 1, 1, m + 1).astype(np.int64)
                        a, b, size = lo >> 6, -(-hi // 64), (m + 1).bit_length()
                        spare = np.repeat((1 << size) - need, width)[a * 64 : b * 64]
                        digits[m, reach] = a, b, _packed((spare >> np.arange(size)[:, None] & 1).astype(bool))
                if digits[m, reach] is not None:
                    if counted[0] != ask:
                        counted = ask, _digits([flags[columns[t]] for x, t in enumerate(usual.tolist()) if ask >> x & 1])
                    a, b, planes = digits[m, reach]
                    view, over, base = flags[:, a:b], np.zeros(b - a, np.uint64), list(planes)
                    for x, plane in enumerate(base):
                        more = counted[1][x][a:b] if x < len(counted[1]) else 0
                        odd = plane ^ more
                        base[x], over = odd ^ over, plane & more | odd & over
            if base is None:
                continue
            ones = [base[0]]
            for t in listed[ends_rest[i] : ends_rest[i + 1]]:
                if columns[t] >= 0:
                    ones.append(view[columns[t]])
                else:
                    one, few = np.zeros(flags.shape[1], np.uint64), rows[starts[t] : starts[t + 1]]
                    np.add.at(one, few >> 6, np.uint64(1) << (few & 63).astype(np.uint64))
                    ones.append(one[a:b])
            found = _overflow([ones, *([x] for x in base[1:])]) | over
            at_word = np.flatnonzero(found)
            if len(at_word):
                hits.append((i, at_word + a, found[at_word]))
                waiting += len(at_word)
                if waiting > FLAGS_AT_ONCE:
                    single(hits)
                    hits, waiting = [], 0
        if hits:
            single(hits)
    i, at_k = np.nonzero(got_p >= 0)
    return i, got_p[i, at_k], got_j[i, at_k]


def similar_examples(queries: DataFrame, pool: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """a, b, jaccard, pos: the k rows of `pool` most similar to each query (id, terms), ties by smaller id.

    Rows that share nothing still count, with 0, so every query meets every row, in a grid of blocks of the queries and of the
    pool, as many as their sizes and the tasks at once ask for. Equal sets of the queries go there once and those of the pool
    with their k smallest ids, terms as 64-bit hashes. In a cell a query's shared terms are counted for all rows at once; only
    k rows a query leave it.
    """
    def sets(df: DataFrame, key: str) -> DataFrame:
        w = F.array_sort(F.transform(F.array_distinct("terms"), lambda t: F.xxhash64(t)))
        return df.select(F.col("id").alias(key), w.alias("w")).withColumn("h1", F.xxhash64("w")).withColumn("h2", F.xxhash64(F.lit(1), "w"))

    def first(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(key))).where(F.col("_n") <= n).drop("_n")

    rows = sets(queries, "a")
    q = written(first(rows, "a", 1).drop("a"))
    p = written(first(sets(pool, "b"), "b", k).select("b", "w"))
    blocks, asked = blocks or max(1, math.ceil(p.count() / POOL_BLOCK)), q.count()
    spread = math.ceil(2 * queries.sparkSession.sparkContext.defaultParallelism / blocks)
    groups = max(1, math.ceil(asked / QUERY_BLOCK), min(spread, math.ceil(asked / LEAST_QUERIES)))
    q = q.withColumn("_h", F.pmod("h1", F.lit(groups)).cast("int")).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    p = p.withColumn("_g", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("b", kind="stable")
        i, j, score = _best_shared(asked["w"], known["w"], k)
        return pd.DataFrame({"h1": asked["h1"].to_numpy()[i], "h2": asked["h2"].to_numpy()[i], "b": known["b"].to_numpy()[j], "jaccard": score})

    part = q.groupBy("_g", "_h").cogroup(p.groupBy("_g", "_h")).applyInPandas(best, f"h1 long, h2 long, b {p.schema['b'].dataType.simpleString()}, jaccard double")
    outer = Window.partitionBy("h1", "h2").orderBy(F.desc("jaccard"), F.asc("b"))
    found = part.withColumn("pos", F.row_number().over(outer)).where(F.col("pos") <= k)
    return rows.select("a", "h1", "h2").join(found, ["h1", "h2"]).select("a", "b", "jaccard", "pos")


def mean_deviation(df: DataFrame, value: str, floor: float = 1e-6) -> DataFrame:
    """mean and deviation from running sums, with a floor under the variance."""
    m, q = F.avg(value), F.avg(F.col(value) * F.col(value))
    return df.agg(F.round(m, 6).alias("mean"), F.round(F.sqrt(F.greatest(q - m * m, F.lit(floor))), 6).alias("deviation"))


def cosine_schedule(steps: int) -> list[float]:
    """Noise levels of a cosine schedule, each at most 0.999."""
    f = [math.cos((t / steps + 0.008) / 1.008 * math.pi / 2) ** 2 for t in range(steps + 1)]
    return [min(0.999, 1 - f[t + 1] / f[t]) for t in range(steps)]


def linear_schedule(steps: int, start: float = 1e-3, end: float = 5e-2) -> list[float]:
    """Noise levels in equal steps."""
    return [start + (end - start) * t / max(1, steps - 1) for t in range(steps)]


def time_embedding(step: Column, dim: int, longest: float = 10_000.0) -> Column:
    """Sines, then cosines, of a step at dim // 2 falling frequencies; an odd `dim` ends with a zero."""
    half = dim // 2
    angles = [step.cast("double") * math.exp(-math.log(longest) * i / half) for i in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles], *([F.lit(0.0)] if dim % 2 else []))


def cumulative_product(df: DataFrame, order: str, value: str) -> Column:
    """Running product of positive values by `order` within one short series."""
    return F.exp(F.sum(F.log(value)).over(Window.partitionBy().orderBy(order)))
