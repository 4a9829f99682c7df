"""Rerankers by configuration: a mode says what of a candidate is judged and how, a client judges it.

Candidates are rows of q, d, score (of the first stage) and pos, with what the client reads: query_text, audio (a path or
name), caption, vectors or tokens. A reranker is a plan over that table: it keeps the first `top_k`, and gives new_score
and new_pos. Models are not called from here: what they answered comes as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import cosine, mos01
from .rerank import Reranker, blend, blend_normalised, from_listing, hash_score, limit_candidates, reordered
from .tokens import maxsim


class Client:
    """Judges candidates. A client knows audio, captions or both; what it does not know is an error."""

    def prepare(self, candidates: DataFrame) -> DataFrame:
        """The candidates with the columns that the scores read."""
        return candidates

    def audio(self) -> Column:
        raise ValueError(f"{type(self).__name__} does not judge audio")

    def caption(self) -> Column:
        raise ValueError(f"{type(self).__name__} does not judge captions")

    def describe(self) -> Column:
        """A caption for a candidate that has none."""
        raise ValueError(f"{type(self).__name__} does not write captions")

    def orders(self, candidates: DataFrame) -> DataFrame | None:
        """q, order (zero-based positions) of listwise answers; None where lists are ordered by the scores."""
        return None


@dataclass
class Mock(Client):
    """Scores that depend on the texts alone."""

    def audio(self) -> Column:
        return hash_score(F.lit("audio"), F.lower("query_text"), text.stem("audio"))

    def caption(self) -> Column:
        return hash_score(F.lit("caption"), F.lower("query_text"), F.lower("caption"))

    def describe(self) -> Column:
        # Fixed value: the sentence of a made-up caption.
        return F.concat(F.lit("Mock description of audio clip '"), F.replace(text.stem("audio"), F.lit("_"), F.lit(" ")), F.lit("'"))


@dataclass
class Answers(Client):
    """What a language model answered: `answers` has q, d and answer for single scores, `lists` q and answer for orders.

    `score_how` and `order_how` are how answers are read (see functions.text). A candidate without an answer has the
    default score; an answer that states no order leaves the list as it was, and one that states a part of it is completed.
    `captions` (d, made) may hold captions that the model wrote.
    """

    answers: DataFrame | None = None
    lists: DataFrame | None = None
    captions: DataFrame | None = None
    default: float = 0.0
    score_how: str = "marked"
    order_how: str = "all"

    def prepare(self, candidates: DataFrame) -> DataFrame:
        out = candidates
        if self.captions is not None:
            out = out.join(self.captions.select("d", F.col("made").alias("_made")), "d", "left")
        if self.answers is not None:
            out = out.join(self.answers.select("q", "d", F.col("answer").alias("_answer")), ["q", "d"], "left")
        return out

    def audio(self) -> Column:
        if self.answers is None:
            raise ValueError("single scores need a table of answers")
        return text.parse_score("_answer", self.default, self.score_how)

    caption = audio

    def describe(self) -> Column:
        return F.coalesce("_made", F.lit("")) if self.captions is not None else F.lit("")

    def orders(self, candidates: DataFrame) -> DataFrame | None:
        if self.lists is None:
            return None
        sizes = candidates.groupBy("q").agg(F.count("*").cast("int").alias("n"))
        read = self.lists.select("q", "answer").join(sizes, "q").withColumn("stated", text.parse_order("answer", F.col("n"), self.order_how))
        full = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i - 1)
        return read.select("q", text.complete_order(F.col("stated"), full).alias("order"))


@dataclass
class TextVectors(Client):
    """Cosine of the vectors of query and caption texts; `vectors` has text and vec, texts are looked up without case and runs of spaces.

    A text with several rows has their mean; a pair without vectors scores 0.
    """

    vectors: DataFrame | None = None

    def prepare(self, candidates: DataFrame) -> DataFrame:
        from .matching import lookup_mean

        known = self.vectors.select(text.squash("text").alias("_t"), "vec")
        out = candidates.withColumn("_qt", text.squash("query_text")).withColumn("_ct", text.squash("caption"))
        for key, name in (("_qt", "_qv"), ("_ct", "_cv")):
            found = lookup_mean(out.select(key).distinct(), key, known, "_t", "vec").withColumnRenamed("vec", name)
            out = out.join(found, key, "left")
        return out

    def caption(self) -> Column:
        return F.coalesce(cosine("_qv", "_cv"), F.lit(0.0))


@dataclass
class Alignment(Client):
    """Opinion scores of an alignment model, cosines brought to a scale of 0 to 1; `cosines` has q, d and cosine."""

    cosines: DataFrame | None = None

    def prepare(self, candidates: DataFrame) -> DataFrame:
        return candidates.join(self.cosines.select("q", "d", F.col("cosine").alias("_cosine")), ["q", "d"], "left")

    def audio(self) -> Column:
        return F.coalesce(mos01("_cosine"), F.lit(0.0))


@dataclass
class Tokens(Client):
    """Late interaction of token matrices, columns query_tokens and candidate_tokens; without tokens the initial score stays."""

    reduce: str = "mean"

    def audio(self) -> Column:
        there = F.coalesce(F.size("query_tokens") * F.size("candidate_tokens"), F.lit(0)) > 0
        return F.when(there, maxsim("query_tokens", "candidate_tokens", self.reduce)).otherwise(F.col("score"))


@dataclass
class Denoised(Client):
    """Scores of a diffusion model, columns denoised and contrastive, blended after normalising; see rerank.blend_normalised."""

    weights: tuple[float, float] = (0.7, 0.3)

    def audio(self) -> Column:
        return blend_normalised("score", "denoised", "contrastive", self.weights, 1.0, "q")


CLIENTS: dict[str, Callable[..., Client]] = {
    "mock": Mock,
    "answers": Answers,
    "answers_first": lambda **p: Answers(**({"score_how": "last", "order_how": "first"} | p)),
    "answers_digits": lambda **p: Answers(**({"score_how": "raw", "order_how": "digits"} | p)),
    "text_embedding_caption": TextVectors,
    "alignment": Alignment,
    "late_interaction": Tokens,
    "diffusion": Denoised,
}


def _captioned(candidates: DataFrame, client: Client) -> DataFrame:
    """With captions where candidates have none; the client is asked only if the table has such rows to judge."""
    try:
        made = client.describe()
    except ValueError:
        made = F.lit("")
    return candidates.withColumn("caption", F.when(text.filled("caption"), F.col("caption")).otherwise(made))


def _pointwise(kind: str, client: Client, top_k: int, weight: float) -> Reranker:
    def run(candidates: DataFrame) -> DataFrame:
        kept = limit_candidates(candidates, top_k)
        if kind == "caption":
            kept = _captioned(client.prepare(kept), client)
            if isinstance(client, TextVectors):
                kept = client.prepare(kept.drop("_qt", "_ct", "_qv", "_cv"))
        else:
            kept = client.prepare(kept)
        new = client.audio() if kind == "audio" else client.caption()
        return reordered(kept.withColumn("new_score", blend("score", new, weight)), "new_score")

    return run


def _listwise(kind: str, client: Client, top_k: int, weight: float) -> Reranker:
    def run(candidates: DataFrame) -> DataFrame:
        kept = limit_candidates(candidates, top_k)
        orders = client.orders(kept)
        if orders is None:
            return _pointwise(kind, client, top_k, weight)(candidates)
        return from_listing(kept.withColumn("new_score", F.col("score")), orders)

    return run


def _late(kind: str, client: Client, top_k: int, weight: float) -> Reranker:
    def run(candidates: DataFrame) -> DataFrame:
        kept = client.prepare(limit_candidates(candidates, top_k))
        # a query without tokens keeps its order
        asked = F.coalesce(F.size("query_tokens"), F.lit(0)) > 0
        new = F.when(asked, blend("score", client.audio(), weight)).otherwise(-F.col("pos").cast("double"))
        return reordered(kept.withColumn("new_score", new), "new_score")

    return run


def _diffusion(kind: str, client: Client, top_k: int, weight: float) -> Reranker:
    def run(candidates: DataFrame) -> DataFrame:
        kept = client.prepare(limit_candidates(candidates, top_k)).where(F.col("denoised").isNotNull() & F.col("contrastive").isNotNull())  # others fall out
        weights = client.weights if isinstance(client, Denoised) else (0.7, 0.3)
        return reordered(kept.withColumn("new_score", blend_normalised("score", "denoised", "contrastive", weights, weight, "q")), "new_score")

    return run


#: What of a candidate is judged, and how, by the name of the mode.
MODES: dict[str, tuple[str, Callable[[str, Client, int, float], Reranker]]] = {
    "audio_native_pointwise": ("audio", _pointwise),
    "audio_native_listwise": ("audio", _listwise),
    "caption_proxy_pointwise": ("caption", _pointwise),
    "caption_proxy_listwise": ("caption", _listwise),
    "late_interaction": ("audio", _late),
    "diffusion": ("audio", _diffusion),
}


@dataclass(frozen=True)
class Configured:
    """A reranker with what it is called, its mode and its depth (0: all candidates)."""

    name: str
    mode: str
    top_k: int
    run: Reranker = field(repr=False)

    def __call__(self, candidates: DataFrame) -> DataFrame:
        return self.run(candidates)


def build(config: Mapping | None) -> Configured | None:
    """The reranker of a configuration: enabled, mode, top_k, weight, name, and client with name and params.

    None for no configuration or one that is not enabled; a missing or unknown mode and an unknown client are errors.
    """
    if config is None or not config.get("enabled", False):
        return None
    mode = config.get("mode")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    asked = config.get("client") or {}
    client = asked.get("name", "mock")
    if client not in CLIENTS:
        raise ValueError(f"unknown client {client!r}; known: {sorted(CLIENTS)}")
    top_k = int(config.get("top_k", 50))
    kind, make = MODES[mode]
    run = make(kind, CLIENTS[client](**(asked.get("params") or {})), top_k, float(config.get("weight", 1.0)))
    return Configured(config.get("name", f"{client}_{mode}"), mode, top_k, run)
