"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each distinct piece is merged once per Python worker. Merging holds
the boundaries of the parts and the rank of each adjacent pair side by side, scans for the least rank, deletes
that boundary and refreshes the two ranks beside it. The scan is linear, so pieces longer than `SHORT` bytes
take a heap with linked neighbours instead, with the same result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 64
#: Pieces a worker remembers; when full, it starts anew. Bounds memory only, never the result.
REMEMBERED = 200_000
NEVER = 1 << 60


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and their ranks, which are the ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece, by repeated scans of a contiguous array of ranks."""
    if piece in ranks:
        return [ranks[piece]]
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    rank = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while rank:
        least = min(rank)
        if least == NEVER:
            break
        i = rank.index(least)
        del cuts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(piece[cuts[i] : cuts[i + 2]], NEVER)
        if i:
            rank[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], NEVER)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece of any length; a heap holds the pairs, stale ones are skipped."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int:
        return ranks.get(piece[i : end[end[i]]], NEVER) if end[i] < n else NEVER

    current = [rank(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(current) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or current[i] != r:
            continue
        gone = end[i]
        end[i] = end[gone]
        alive[gone] = False
        if end[i] < n:
            before[end[i]] = i
        for j in (i, before[i]):
            if j >= 0:
                current[j] = rank(j)
                if current[j] != NEVER:
                    heapq.heappush(heap, (current[j], j))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Texts to ids; strings that look like special tokens are plain text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known = self.known
            for p in self.find(text):
                ids = known.get(p)
                out += self.piece(p) if ids is None else ids
        return out


def _encoders(spark: SparkSession, path: str):
    """The ranks, once for each executor; their number is that of the vocabulary."""
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """`key`, ids: the token ids of each row's text, in order; an empty or null text gives an empty list."""
    ranks = _encoders(df.sparkSession, path)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                yield pd.DataFrame({"k": part["k"], "ids": [encoder(t) for t in part["t"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInPandas(make, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str, text: str, *more: str, path: str = VOCABULARY) -> DataFrame:
    """`key`, `more`, tokens: the number of ids of each row's text; 0 for an empty or null one."""
    ranks = _encoders(df.sparkSession, path)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            made = batch.drop(columns="_text")
            made["tokens"] = [len(encoder(t)) for t in batch["_text"]]
            yield made

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *more))
    return df.selectExpr(*(f"`{c}`" for c in (key, *more)), f"`{text}` AS _text").mapInPandas(make, f"{kinds}, tokens long")
