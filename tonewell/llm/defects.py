"""Broken prompt and response pairs: empty, refusing, copying, foreign and truncated responses.

Each pair is judged by itself. Stand-ins are fixed words; refusals come from a grammar tried where a sentence begins.
Greedy string tiling lays the response over its caption: one tile over all of the caption, with at most a label before
it, is a copy, and a refusal that is a tile of the caption is a quotation and no refusal. The script of most letters
tells languages of different scripts apart, and within one script a letter-triple model.

Truncation is read by a pushdown parser for quotes, brackets, fences, lists and markup, and where nothing stays open and
no final mark stands, by a model of where texts end. It is trained here, on responses that do end with a mark: whole,
they are complete, cut at a random place they are not. What it sees are the last words, what the tiling says the caption
would have had next, what of the caption is missing, and whether the last word is a piece of another. Items that lists
hold before their last place tell whole last items of lists from pieces.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words as spark_words
from ..session import written
from .stuffed import ALL_FUNCTION_WORDS, LANGUAGE_OF

KINDS = ("empty", "refusal", "copy", "language", "truncated")

# What stands in for a missing text, as lower-cased words.
STAND_INS = frozenset([
    "null", "none", "nan", "nil", "na", "n a", "undefined", "missing", "empty", "blank", "tbd", "tba", "todo", "to do", "unknown", "not available",
    "not applicable", "no query", "no response", "no output", "no answer", "no text", "no data", "no value", "placeholder", "xxx", "string", "text",
    "query", "response", "answer", "value", "your query here", "query here", "insert query here", "lorem ipsum",
])
# Labels that may stand in front of a response.
LABELS = "query|search query|user query|q|question|caption|original caption|answer|a|prompt|request|search|text|output|response|result|description|title|sentence|input|assistant|user|rewrite|paraphrase"
LABEL = re.compile(rf"^[\s\"'`*_#>\[(]*(?:{LABELS})[\s\"'`*_\])]*(?:\d+\s*)?(?::|=|[-–—>]+(?=\s))\s*", re.I)
MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|```\w*|`")
WORD = re.compile(r"[^\W_]+")

_CANT = r"(?:can\s?not|can['’]?t|could\s?n[o'’]t|couldn['’]?t|won['’]?t|will not|wouldn['’]?t|am (?:unable|not able|not allowed|not permitted|afraid)|['’]m (?:unable|not able|not allowed|not permitted|afraid|just an? (?:ai|language))|do not have|don['’]?t have|must (?:decline|refuse)|have to (?:decline|refuse)|refuse|decline|need (?:some )?(?:more|further|additional) (?:information|context|details?|input))"
_THING = r"(?:suitable |valid |appropriate |meaningful |such |search )*(?:query|queries|request|response|answer|output|question|sentence|paraphrase|tags?|result|caption|rewrite)"
_MAKE = r"(?:generate|create|produce|write|provide|make|answer|respond|help|assist|comply|fulfil|fulfill|complete|process|rephrase|formulate|hear|listen|derive|give)"
#: A refusal begins a sentence with one of these.
REFUSAL = re.compile(
    r"(?:"
    rf"(?:(?:well|oh|hello|hi|thanks|thank you)[,.! ]+)?(?:i['’]?m |i am |we are |we['’]?re )?(?:so |very |really |truly |terribly )?sorry\b|(?:my |our |please accept my )?(?:sincere )?apologies\b|i (?:must )?apologi[sz]e\b|(?:unfortunately|regrettably)\b|"
    rf"as an? (?:(?:large |artificial )?(?:ai|language|text|intelligence)[ -]?(?:based )?(?:model|assistant|system)?|assistant|llm|chatbot)\b|(?:i|we) ?{_CANT}|(?:can\s?not|can['’]t|unable to|not able to|impossible to) {_MAKE}\b|"
    rf"no {_THING} (?:can|could|is|was|will|for|available|possible|given|generated)|no {_THING}\s*[.!]?$|(?:the |your |this )?(?:request|query|task|prompt) (?:was |is |has been |is being |must be )?(?:declined|denied|rejected|refused|blocked)|"
    r"(?:this|the) (?:caption|request|text|prompt|input|description|audio|content|task)(?: here)? (?:is|was|does|lacks|has|contains|cannot|can['’]?t|isn['’]?t|doesn['’]?t|provides)(?: (?:not|no|too|insufficient|against|violat\w*|clear|enough|detail\w*|provide|vague|short|unclear|information|context|be)\b)+|"
    r"there (?:is|was)(?: not|n['’]t) (?:enough|sufficient|any)\b.*(?:detail|information|context|given|provided)|(?:not enough|insufficient|too little) (?:detail|information|context|input)|it (?:is|would) not (?:be )?(?:possible|appropriate)|"
    r"(?:je suis |nous sommes )?(?:désolée?s?|navrée?s?)\b|je ne (?:peux|puis|suis)\b|malheureusement\b|(?:es )?tut mir leid\b|leider\b|ich kann (?:\w+ ){0,3}(?:nicht|kein\w*)\b|entschuldigung\b|lo siento\b|lo lamento\b|no puedo\b|lamentablemente\b|desafortunadamente\b"
    r")",
    re.I,
)

FINAL = re.compile(r"[.!?。！？](?:[\"'»”’)\]`*]|</\w+>|\s)*$")
#: Where a sentence begins.
BEGIN = re.compile(r"(?:^|(?<=[.!?。！？])\s+|\n)[\s\"'“«*_]*")

#: Documents of a language that its counts are brought down to: what was never seen then costs the same in every corpus.
PER_LANGUAGE = 1_000
#: Different words that a task holds before it tells their triples.
HELD = 500_000
#: Share of all triples of a language from which a triple is told to the driver: at most 1 / TRIPLE of them.
TRIPLE = 1e-6
LANGUAGES = ("en", "fr", "de", "es")
#: How much likelier, in nats, a language must be than the other before a text counts as written in it.
SURE = 5.0
#: Pairs of a shard that a model of endings is trained on, and its size; every pair is in a shard.
SHARD_PAIRS = 20_000
CELLS = 1 << 17
EPOCHS = 12
#: Words that SHARD_PAIRS pairs hold at least so often on average are known ones.
KNOWN = 5
#: Log odds from which an ending counts as cut. Cut endings are two of three in training and rare in use.
CUT = 2.5
#: Share of all captions from which a word belongs to their frame; at most (words a caption) / FRAME words.
FRAME = 0.05


class _Automaton:
    """The suffix automaton of a list of words: which runs of it another list holds, in linear time."""

    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for i, t in enumerate(tokens):
            now = self._state(self.size[last] + 1, i)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][t]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    twin = self._state(self.size[p] + 1, self.end[q])
                    self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def _state(self, size: int, end: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def runs(self, tokens: list) -> Iterator[tuple[int, int, int]]:
        """(length, start in `tokens`, start in the other list) of each longest run that no longer one holds."""
        state = n = 0
        for i, t in enumerate(tokens):
            if t not in self.next[state] and n:
                yield n, i - n, self.end[state] - n + 1
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if t in self.next[state]:
                state, n = self.next[state][t], n + 1
            else:
                state = n = 0
        if n:
            yield n, len(tokens) - n, self.end[state] - n + 1


def tiles(a: list[str], b: list[str], least: int = 1) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of long common runs, none overlapping, longest first.

    Each round reads both texts once, finds the longest common runs of what is free, and takes those longer than half of
    the longest, so the rounds are about the logarithm of the text length.
    """
    free_a: list = list(a)
    free_b: list = list(b)
    out = []
    while True:
        # taken places hold marks that equal nothing
        found = sorted(_Automaton([("b", j) if w is None else w for j, w in enumerate(free_b)]).runs([("a", i) if w is None else w for i, w in enumerate(free_a)]), key=lambda r: (-r[0], r[1]))
        if not found or found[0][0] < least:
            return out
        enough = max(least, found[0][0] // 2)
        for n, i, j in found:
            if n < enough:
                break
            if None not in free_a[i : i + n] and None not in free_b[j : j + n]:
                out.append((i, j, n))
                free_a[i : i + n] = [None] * n
                free_b[j : j + n] = [None] * n


#: Closing marks and what they close.
CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《"}
OPENS = frozenset("([{“„「『（【《")
ANGLE = {"«": "»", "»": "«"}
ELEMENT = re.compile(r"<(/?)([a-zA-Z]\w*)[^<>]*>")
#: Elements without a closing tag.
SINGLE = frozenset("br hr img s input meta link".split())


def _quote(text: str, i: int, stack: list[str]) -> None:
    """Straight and angled quotes, which look the same on both sides or are turned in some languages."""
    c = text[i]
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if c == '"':
        if stack and stack[-1] in '"„“':
            stack.pop()
        elif not before.isdigit():  # otherwise inches or seconds
            stack.append(c)
    elif stack and stack[-1] == ANGLE[c]:
        stack.pop()
    elif not (c == "»" and before.isspace() and after.isspace()):  # otherwise it parts the steps of a path
        stack.append(c)


def unclosed(text: str) -> bool:
    """Whether brackets, quotes, fences, markup or a list stay open at the end, read with a stack.

    A closing mark closes what it fits, and with it what was opened inside and left open; one that fits nothing is text
    (`1)`, `:)`), but for a quotation mark before a word, which opens, as some languages have the same mark on both sides.
    """
    stack: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if text.startswith("```", i):
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
            i += 3
            continue
        if "```" in stack:  # code has rules of its own
            i += 1
            continue
        if c in '"«»':
            _quote(text, i, stack)
        elif c in CLOSES and (fits := [k for k, o in enumerate(stack) if o in CLOSES[c]]):
            del stack[fits[-1] :]
        elif c in OPENS:
            if not (c == "(" and text[i - 1 : i] in (":", ";")):
                stack.append(c)
        elif c == "”" and text[i + 1 : i + 2].isalpha() and not text[i - 1 : i].isalnum():
            stack.append("“")
        elif c == "<":
            if m := ELEMENT.match(text, i):
                name = "<" + m[2].lower()
                if m[1]:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif not m[0].endswith("/>") and m[2].lower() not in SINGLE:
                    stack.append(name)
                i = m.end()
                continue
            if re.match(r"</?[a-zA-Z][^<>]*$", text[i:]):
                return True
        i += 1
    return bool(stack) or bool(re.search(r"(?:^|\n)[ \t]*(?:[-*•]|\d+[.)])[ \t]*$", text.rstrip(" \t")))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def body(text: str) -> str:
    """Without labels in front, markup, and quotes or brackets around the whole."""
    t = text.strip()
    for _ in range(3):
        t, n = LABEL.subn("", t, count=1)
        if not n:
            break
    t = MARKUP.sub(" ", t).strip()
    while len(t) > 1 and t[0] + t[-1] in ('""', "''", "[]", "()", "{}", "“”", "«»", "**"):
        t = t[1:-1].strip()
    return t


@dataclass
class Model:
    """What is learned: log probabilities of letter triples by language, the frame of captions, whole list items, and endings."""

    triples: dict[str, dict[str, float]] = field(default_factory=dict)
    floor: dict[str, float] = field(default_factory=dict)
    items: frozenset[str] = frozenset()
    frame: frozenset[str] = frozenset()
    known: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None

    def scores(self, text: str) -> dict[str, float]:
        toks = words(text)
        grams = [g for w in toks for g in _triples(w)]
        return {k: sum(t.get(g, self.floor[k]) for g in grams) + 2.0 * sum(w in LANGUAGE_OF[k] for w in toks) for k, t in self.triples.items()}

    def piece(self, word: str) -> bool:
        """Whether the word is not known and begins a known one."""
        at = bisect_left(self.known, word)
        return at < len(self.known) and self.known[at] != word and self.known[at].startswith(word)

    def is_cut(self, caption: list[str], query: list[str], text: str) -> bool:
        return self.weights is not None and float(self.weights[ending(caption, query, text, self.piece)].sum()) > CUT


def _triples(word: str) -> list[str]:
    p = f" {word} "
    return [p[i : i + 3] for i in range(len(p) - 2)]


def fit_languages(documents: DataFrame, model: Model) -> None:
    """The language model, from all whole documents of the languages, as if each had PER_LANGUAGE at most; triples are counted where the texts are."""
    lang = F.lower(F.trim("lang"))
    rows = documents.where(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select(lang.alias("l"), "text")
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a language
    share = F.create_map(*[F.lit(x) for k in LANGUAGES for x in (k, min(1.0, PER_LANGUAGE / max(1, sizes.get(k, 0))))])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter[str]] = {}

        def told() -> Iterator[pd.DataFrame]:
            for name, c in seen.items():
                grams: Counter[str] = Counter()
                for w, n in c.items():
                    for g in _triples(w):
                        grams[g] += n
                yield pd.DataFrame({"l": name, "g": list(grams), "n": list(grams.values())})
            seen.clear()

        for batch in batches:
            for name, text in zip(batch["l"], batch["text"]):
                seen.setdefault(name, Counter()).update(words(text))
            if sum(map(len, seen.values())) > HELD:
                yield from told()
        yield from told()

    summed = written(rows.mapInPandas(count, "l string, g string, n long").groupBy("l", "g").agg((F.sum("n") * share[F.col("l")]).alias("n")))
    totals = {r["l"]: r["n"] for r in summed.groupBy("l").agg(F.sum("n").alias("n")).collect()} if sizes else {}
    if not totals:
        return
    least = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, TRIPLE * n)])
    for name, part in summed.where(F.col("n") > least[F.col("l")]).toPandas().groupby("l"):  # at most 1 / TRIPLE a language
        total = totals[name] + 20_000 * 0.5
        model.triples[name] = {g: math.log((n + 0.5) / total) for g, n in zip(part["g"], part["n"])}
        model.floor[name] = math.log(0.5 / total)


def _bucket(n: int) -> int:
    return n if n < 4 else 4 + (n > 6)


def ending(caption: list[str], query: list[str], text: str, piece) -> list[int]:
    """The features of where a response ends, as cells of the model; `text` is the response as it is written."""
    last = query[-1]
    two = " ".join(query[-2:])
    seen = [f"1 {last}", f"2 {two}", f"3 {' '.join(query[-3:])}", "any"]
    parts = re.split(r"[,;:|]", text)
    seen.append(f"words since a mark {_bucket(len(words(parts[-1])))} of {min(3, len(parts) - 1)}")
    inside = set(caption)
    short = min(4, len(last))
    if last not in inside and any(w.startswith(last) for w in caption):
        seen.append(f"piece of the caption {short}")
    if piece(last):
        seen += ["piece", f"piece {short}"]
    # words behind the last one that the caption has
    behind = 0
    while behind < len(query) and query[-1 - behind] not in inside:
        behind += 1
    if piece(last):
        seen.append(f"piece own {_bucket(behind)}")
    if behind:
        seen += [f"own {_bucket(behind)}", f"own {_bucket(behind)} {query[-behind]}"]
    place = max((i + n - 1 for i, j, n in tiles(caption, query) if j + n == len(query)), default=-1) if not behind else -1
    if place >= 0:
        rest = caption[place + 1 :]
        mine = set(query)
        lacking = [w for w in rest if w not in mine]
        before = sum(w not in mine for w in caption[:place])
        if rest:
            new = rest[0] not in mine
            seen += [f"next {rest[0]} {new}", f"next2 {' '.join(rest[:2])}", f"over {last} {rest[0]}", f"next is new {new}", f"rest {_bucket(len(rest))}", f"lacking {_bucket(len(lacking))} {_bucket(before)}", f"new {new} {_bucket(len(lacking))}", f"next {rest[0]} {_bucket(len(lacking))}"]
        else:
            seen += ["at the end", f"at the end {_bucket(before)}"]
    elif not behind:
        seen.append("elsewhere")
    return [zlib.crc32(x.encode("utf-8", "replace")) % CELLS for x in seen]


def _cuts(text: str) -> list[str]:
    """A complete text cut after a word, and within one; the places come from a hash of the text."""
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) < 3:
        return []
    h = zlib.crc32(text.encode("utf-8", "replace"))
    at = 1 + h % (len(spans) - 2)
    out = [text[: spans[at][1]]]
    long = [s for s in spans[1:] if s[1] - s[0] >= 4]
    if long:
        a, b = long[(h >> 8) % len(long)]
        out.append(text[: a + 1 + (h >> 16) % (b - a - 1)])
    return out


def _trained(cells: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the cells and how often each is seen: logistic regression by AdaGrad in the order given."""
    size = np.array([len(c) for c in cells])
    flat = np.concatenate(cells).astype(np.int64)
    start = np.r_[0, np.cumsum(size)]
    w, speed = np.zeros(CELLS), np.full(CELLS, 1e-3)
    for _ in range(EPOCHS):
        for a in range(0, len(y), 512):
            b = min(len(y), a + 512)
            part = flat[start[a] : start[b]]
            row = np.repeat(np.arange(b - a), size[a:b])
            z = np.bincount(row, w[part], minlength=b - a)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) / np.sqrt(size[a:b])
            touched, inverse = np.unique(part, return_inverse=True)
            g = np.bincount(inverse, error[row]) + 1e-3 * w[touched]
            speed[touched] += g * g
            w[touched] -= 0.3 * g / np.sqrt(speed[touched])
    return w, np.bincount(flat, minlength=CELLS)


def fit_endings(pairs: DataFrame, model: Model) -> None:
    """The words that are known and the model of endings, from all pairs; at most CELLS weights and a bounded number of words reach the driver.

    Pairs are dealt by a hash of their key to shards of about SHARD_PAIRS. Each trains a logistic regression on hashed features in
    a fixed order; a weight is the mean over the shards by how often they saw its cell.
    """
    total = pairs.count()
    inner = [F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))) for w in (spark_words("c"), spark_words("q"))]  # a last word may be a piece
    least = max(KNOWN, KNOWN * total / SHARD_PAIRS)
    counted = pairs.select(F.explode(F.concat(*inner)).alias("w")).groupBy("w").count().where(F.col("count") >= least)
    model.known = sorted(r["w"] for r in counted.collect())  # at most (words of SHARD_PAIRS pairs) / KNOWN
    piece = model.piece
    shards = max(1, math.ceil(total / SHARD_PAIRS))

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for shard, c, q in zip(batch["shard"], batch["c"], batch["q"]):
                text = body(q or "")
                if not FINAL.search(q or "") or text.endswith(("…", "...")) or unclosed(text) or REFUSAL.match(text):
                    continue
                cw, qw = words(c), words(text)
                if not qw or qw == cw:
                    continue
                made.append((shard, 0, ending(cw, qw, text, piece)))
                made += [(shard, 1, ending(cw, words(t), t, piece)) for t in _cuts(text)]
            if made:
                yield pd.DataFrame(made, columns=["shard", "cut", "cells"])

    def train(got: pd.DataFrame) -> pd.DataFrame:
        if got["cut"].nunique() < 2:
            return pd.DataFrame({"cell": [], "w": [], "n": []})
        # the order must not depend on the partitions
        got = got.assign(k=[zlib.crc32(np.asarray(x, np.int32).tobytes()) for x in got["cells"]]).sort_values(["k", "cut"], kind="stable")
        w, n = _trained(got["cells"].to_list(), got["cut"].to_numpy(np.float64))
        at = np.flatnonzero(n)
        return pd.DataFrame({"cell": at, "w": w[at], "n": n[at]})

    dealt = pairs.select(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(shards)).cast("int").alias("shard"), "c", "q")
    told = dealt.mapInPandas(examples, "shard int, cut int, cells array<int>").groupBy("shard").applyInPandas(train, "cell int, w double, n long")
    mean = told.groupBy("cell").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toPandas()  # CELLS rows at most
    if len(mean):
        weights = np.zeros(CELLS, np.float32)
        weights[mean["cell"].to_numpy(np.int64)] = mean["w"].to_numpy()
        model.weights = weights


# Scripts that one language writes side by side count as one; a Japanese text is told from a Chinese one by its kana.
TOGETHER = {"HIRAGANA": "KANA", "KATAKANA": "KANA", "KATAKANA-HIRAGANA": "KANA", "BOPOMOFO": "CJK", "IDEOGRAPHIC": "CJK"}
#: Forms of letters, which stand in Unicode names before the script.
FORMS = frozenset("HALFWIDTH FULLWIDTH MODIFIER MATHEMATICAL SUPERSCRIPT SUBSCRIPT DOUBLE-STRUCK SCRIPT BLACK-LETTER FEMININE MASCULINE MICRO KELVIN ANGSTROM OHM".split())
#: Share of the letters from which kana make a text of Chinese characters Japanese.
KANA = 0.1


@lru_cache(maxsize=65_536)
def _script(letter: str) -> str | None:
    """The script of a letter, after its Unicode name; None for forms that no one script owns."""
    name = unicodedata.name(unicodedata.normalize("NFKC", letter)[:1] or letter, "").replace("-UNIFIED", " ").split(" ")[0]
    return None if not name or name in FORMS else TOGETHER.get(name, name)


def script(text: str) -> str | None:
    """The script of more than half of the letters, or None."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else None
    found = Counter(s for c in text if c.isalpha() and (s := _script(c)))
    total = sum(found.values())
    if found["KANA"] and found["KANA"] >= KANA * (found["KANA"] + found["CJK"]):
        found["KANA"] += found.pop("CJK", 0)
    most = max(found, key=found.get, default=None)
    return most if most and found[most] * 2 > total else None


def foreign(caption: str, query: str, model: Model) -> bool:
    """Whether both scripts are clear and differ, or both languages of one script are and do."""
    sa, sb = script(caption), script(query)
    if sa and sb and sa != sb:
        return True
    a, b = model.scores(caption), model.scores(query)
    if not a:
        return False
    la, lb = max(a, key=a.get), max(b, key=b.get)
    return la != lb and b[lb] - b[la] > SURE and a[la] - a[lb] > SURE


def _alike(x: str, y: str) -> bool:
    """Equal, or one small slip apart: a letter more, less, changed or two swapped."""
    if x == y:
        return True
    if min(len(x), len(y)) < 4 or abs(len(x) - len(y)) > 1:
        return False
    front = len(os.path.commonprefix([x, y]))
    back = len(os.path.commonprefix([x[front:][::-1], y[front:][::-1]]))
    rx, ry = x[front : len(x) - back], y[front : len(y) - back]
    return len(rx) <= 1 and len(ry) <= 1 or (len(rx) == len(ry) == 2 and rx == ry[::-1])


def _list_items(text: str) -> list[str] | None:
    """The items of a tag list, or None if the text is no list."""
    for mark in (";", ",", "|"):
        parts = [p.strip() for p in text.split(mark)]
        if len(parts) >= 3 and all(len(p.split()) <= 3 for p in parts):
            return parts
    return None


def _list_is_cut(items: list[str], c: list[str], q: list[str], model: Model) -> bool:
    """Whether a list breaks off: in an item that is a piece, or before what else of the caption it should hold."""
    item = items[-1].lower()
    end = words(item)
    inside = set(c)
    if not end:
        return True
    if end[-1] not in inside:
        # an item of its own is whole, unless it begins a word or an item that is known
        begins = item if model.piece(end[-1]) else item + " "
        return item not in model.items and (any(w.startswith(end[-1]) for w in c) or model.piece(end[-1]) or any(x.startswith(begins) for x in model.items))
    if item in model.items and not set(end) <= inside:
        return False
    mine = set(q)
    missing = {w for w in c if w not in model.frame and w not in ALL_FUNCTION_WORDS and not any(_alike(w, x) for x in mine)}
    if len(end) == 1:
        # half of an item, whose other half is missing
        for p, w in enumerate(c):
            if w == end[0] and any(c[k] in missing for k in (p - 1, p + 1) if 0 <= k < len(c)):
                return True
    return len(missing) >= 2


def truncated(caption: str | None, query: str, model: Model) -> bool:
    raw = query.strip()
    if not words(raw):
        return False
    if raw.endswith(("…", "...")) or unclosed(raw):
        return True
    if re.search(r"[-–—,;:(&/|+]$", raw.rstrip("\"'`”»")):
        return True
    if FINAL.search(raw):
        return False
    text = body(raw)
    q = words(text)
    if not q:
        return False
    c = words(caption)
    items = _list_items(text)
    if items is not None:
        return _list_is_cut(items, c, q, model)
    return model.is_cut(c, q, text)


#: Words that may stand before a copied text.
LABEL_WORDS = frozenset(w for label in LABELS.split("|") for w in label.split()) | frozenset("the your here is this".split())


def copied(c: list[str], q: list[str], text: str) -> bool:
    """Whether one tile covers the whole caption and ends the response, and only a label with a mark behind stands before it."""
    if q == c:
        return True
    if not c or len(q) < len(c) or q[-1] != c[-1]:
        return False
    i, j, n = tiles(c, q)[0]
    if n != len(c) or j + n != len(q):
        return False
    front = q[:j]
    spans = [m.span() for m in WORD.finditer(text)]
    return all(w in LABEL_WORDS or w.isdigit() for w in front) and bool(re.search(r"[:=>|\])\n–—-]", text[spans[j - 1][1] : spans[j][0]]))


def refuses(caption: list[str], text: str) -> bool:
    """Whether a sentence of the text begins like a refusal and is not a tile of the caption, thus quoted."""
    for m in BEGIN.finditer(text):
        if found := REFUSAL.match(text, m.end()):
            said = words(found[0])
            covered = max((n for _, _, n in tiles(caption, said)), default=0)
            if covered < len(said):
                return True
    return False


def defect(caption: str | None, query: str | None, model: Model) -> str | None:
    """The defect of one pair, or None."""
    text = body(query or "")
    q = words(text)
    if not q or " ".join(q) in STAND_INS:
        return "empty"
    c = words(caption)
    if refuses(c, text):
        return "refusal"
    if copied(c, q, text):
        return "copy"
    if c and foreign(caption or "", text, model):
        return "language"
    return "truncated" if truncated(caption, query or "", model) else None


#: An item is known as a whole if at least this share of the lists and ENOUGH of them hold it before their last place.
COMMON = 0.0005
ENOUGH = 5


def whole_items(pairs: DataFrame) -> frozenset[str]:
    """Items that lists hold before their last place, where nothing can be cut; at most (items a list) / COMMON of them."""
    q = F.lower(F.trim("q"))
    listed = pairs.where(F.size(F.split(q, "[,;|]")) >= 4).where(~q.rlike(r"[.!?]$")).select(F.split(q, "[,;|]").alias("items"))
    total = listed.count()
    inner = listed.select(F.explode(F.array_distinct(F.slice("items", 1, F.size("items") - 1))).alias("item")).select(F.trim("item").alias("item"))
    rows = inner.groupBy("item").count().where(F.col("count") >= max(ENOUGH, COMMON * total)).collect()
    return frozenset(r["item"] for r in rows if r["item"])


def frame_words(pairs: DataFrame) -> frozenset[str]:
    """Words in at least FRAME of all captions; at most (words a caption) / FRAME of them."""
    total = pairs.count()
    rows = pairs.select(F.explode(F.array_distinct(spark_words("c"))).alias("w")).groupBy("w").count().where(F.col("count") >= max(2, FRAME * total)).collect()
    return frozenset(r["w"] for r in rows)


def fit(pairs: DataFrame, documents: DataFrame) -> Model:
    """Everything that is learned; `pairs` has key, c (caption) and q (response)."""
    model = Model()
    fit_languages(documents, model)
    fit_endings(pairs, model)
    model.items, model.frame = whole_items(pairs), frame_words(pairs)
    return model


def defects(pairs: DataFrame, documents: DataFrame, key: str = "query_id", caption: str = "original_caption", query: str = "query") -> DataFrame:
    """`key`, defect: the defective pairs. The first that holds of KINDS is told.

    A null or blank query is empty. A null or blank caption is no defect; nothing is then compared with it.
    Repeated rows are judged each on their own; very long texts are read whole. Without complete responses to learn
    from, only what the parser sees counts as truncated.
    """
    kind = pairs.schema[key].dataType.simpleString()
    rows = pairs.select(F.col(key).alias("key"), F.col(caption).alias("c"), F.col(query).alias("q"))
    model = fit(rows, documents)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [defect(c, q, model) for c, q in zip(batch["c"], batch["q"])]
            made = pd.DataFrame({"key": batch["key"], "defect": found})
            yield made[made["defect"].notna()]

    return rows.mapInPandas(make, f"key {kind}, defect string").withColumnRenamed("key", key)
