"""Keyword-stuffed and link-list documents.

A text is cut into segments: sentences, and what is left of a line without a closing mark. Three things make characters
count as stuffed:

- Redundancy. The different closed sentences of a text that are short, and segments in a script that nothing is known of,
  form blocks. A block is extremely redundant if its deflate ratio lies far below the usual one of blocks of its
  length, script and language; what is usual comes from one aggregation over the blocks of all documents. It is stuffed
  if the density of marks that close sentences of their own confirms it: sentences that are equal but for words of their own
  have one such mark together. A sentence that is merely said again, be it with other numbers, is taken once, as repeated
  prose and logs are no keywords.
- Lists of different keywords, tags or names do not repeat themselves, so compression cannot tell them. They are told
  by their words: for each frequent word the corpus says whether it stands in lines that end with a closing mark, or in
  open ones. A segment whose words stand in open lines, and that has no closing mark, is a list.
- Links.

Code and data records never are. A document is found if more than half of its characters are stuffed.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words as spark_words
from ..session import written

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "a an the and or but nor so as at by for from in into of off on onto over under up with without near next beside behind across along inside before after then than while when where who which that this these those there here it its he she they we you i his her their our your my is are was were be been being has have had do does did can could will would shall should may might must not no yes if because until too very more most some any each both what how why to only also just about every nobody somebody".split(),
    "fr": "le la les l un une des du de d et ou mais donc ni car à au aux en dans sur sous par pour avec sans chez vers derrière devant près puis que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu se s ne n pas plus est sont était a ont été fait avant après pendant tandis rien si y tout bien comme même autre très".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber denn auf an am im in ins zu zum zur von vom mit ohne bei nach vor hinter unter über neben aus für um durch es er sie wir ihr ich man sich nicht kein keine ist sind war waren wird werden hat haben wie was wer wo dass wenn als danach dann sonst noch sehr nur auch während kurz so".split(),
    "es": "el la los las un una unos unas y o u pero ni de del a al en con sin por para sobre bajo tras entre hacia hasta desde junto detrás que quien donde cómo como se no lo le les su sus es son era está estaba fue ha hay muy más ya mientras luego antes después durante toda todo nada cerca esta este esto".split(),
    "it": "il lo la i gli le un uno una e o ma di del della a al alla da in nel nella con su per tra che chi si non è sono era come più".split(),
    "pt": "o a os as um uma e ou mas de do da dos das em no na nos nas com por para que se não é são era como mais".split(),
    "nl": "de het een en of maar van in op aan met voor bij uit naar over onder dat die dit er is zijn was niet als dan ook".split(),
}
LANGUAGE_OF = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
ALL_FUNCTION_WORDS = frozenset(w for v in FUNCTION_WORDS.values() for w in v)
_NAMES = tuple(LANGUAGE_OF)
#: The languages, by number, that a function word belongs to.
_OF_WORD = {w: tuple(i for i, k in enumerate(_NAMES) if w in LANGUAGE_OF[k]) for w in ALL_FUNCTION_WORDS}


def function_counts(words: list[str]) -> list[int]:
    """How many of the words are function words of each language."""
    counts = [0] * len(_NAMES)
    for w in words:
        for i in _OF_WORD.get(w, ()):
            counts[i] += 1
    return counts


URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+", re.I)
TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
WORD = re.compile(r"[^\W_]+")
#: A sentence: up to closing marks that end the line or stand before a space.
SENTENCE = re.compile(r"\S.*?(?:[.!?…؟।]+[\"'»”’)\]]*(?=\s|$)|[。！？]+[\"'»”’)\]」』]*)|\S.*$")
CLOSED = re.compile(r"[.!?…。！？؟।][\"'»”’)\]]*$")
CODE = re.compile(r"^\s*(?:def |class |return\b|import |from \w+ import|for .*:$|if .*:$|else:|while .*:$|\w[\w.]*\s*[-+*/]?=\s|\w[\w.]*\(.*\)\s*;?$|[{}\[\]();]+,?$|//|/\*|\$ |>>> |<\?|select .* from )", re.I)
RECORD = re.compile(r"^\s*(?:[{\[].*[:,].*[}\]],?$|\"?\w+\"?\s*:\s*[\d\"\[{].*$)")
NUMBER = re.compile(r"\s*\"?[-+]?\d[\d.:]*\"?\s*")
NO_LATIN = re.compile(r"[^\x00-\u024f]")
NUMBERS = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
BULLET = re.compile(r"^\s*(?:[-*•>]+|\d+[.)]|\[[\d:]+\]|#+(?=\s))\s*")
LINK = ""

MOST = 0.5
#: Characters of a block.
BLOCK = 1500
#: Words and links that a text must have in stuffed parts, unless most of it is links: fewer words make no list.
LEAST_ITEMS = 10
#: Deviations below the usual ratio from which a block is extremely redundant, and the least deviation.
EXTREME, LEAST_DEVIATION = 3.5, 0.02
#: Blocks of a length, script and language that its usual ratio is taken from at least; with fewer, those of the script count, then all.
ENOUGH = 30
#: Words of a short sentence, and the marks that close sentences of their own for each closed sentence, up to which their density is low.
SHORT, DENSITY = 10, 0.25
#: Different sentences of one frame from which their repeats are told from repeated prose.
FILLINGS = 3
#: The bound on the ratio of n characters where too few blocks are known at all: BARE + HEAD / n.
BARE, HEAD = 0.25, 36
#: Part of the documents in which a word stands at least to be told; at most (words a document) / SHARE words are.
SHARE = 0.0005
PRIOR = 100
#: Mean of the words' log odds (closed lines against open ones) from which an open segment is a sentence that lacks its mark, its
#: least words, and the mean below which a closed one is a list.
SENTENCE_ODDS, SENTENCE_WORDS, LIST_ODDS = 0.35, 5, -0.7


def _linked(text: str) -> str:
    """Addresses, with markup around them, replaced by as many marks, which no other rule touches; other markup by spaces."""
    if "<" not in text and ":" not in text and "www." not in text.lower():
        return text
    return TAG.sub(lambda m: (LINK if LINK in m[0] else " ") * len(m[0]), URL.sub(lambda m: LINK * len(m[0]), text))


@lru_cache(maxsize=65_536)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "OTHER").split(" ")[0].split("-")[0]


def script(text: str) -> str:
    """The script of most letters of a text; LATIN where other characters are less than a quarter of all."""
    if text.isascii() or len(NO_LATIN.findall(text)) * 4 < len(text):
        return "LATIN"
    found = Counter(_script(c) for c in text if c.isalpha())
    return max(found, key=lambda k: (found[k], k), default="OTHER")


def tokens(text: str) -> list[str]:
    """The words of a text; ideographs and kana, which stand without spaces, one by one."""
    if text.isascii():
        return WORD.findall(text.lower())
    out: list[str] = []
    for w in WORD.findall(text.lower()):
        if w.isascii() or not any("\u3040" <= c <= "\u9fff" for c in w):
            out.append(w)
        else:
            out += w
    return out


def kind_of(segment: str, odds: dict[str, float]) -> str:
    """link, closed (a sentence), open (a list) or unknown (without a mark, in a script of which no word of it is known)."""
    if segment.count(LINK) * 2 > len(segment):
        return "link"
    words = WORD.findall(segment.replace(LINK, " ").lower())
    if not words:
        return "open"
    score = sum(map(odds.get, words, repeat(0.0))) / len(words)
    if CLOSED.search(segment):
        return "open" if score < LIST_ODDS and len(words) >= 3 else "closed"
    if segment.count("#") * 2 >= len(words):
        return "open"
    if len(words) >= SENTENCE_WORDS and score >= SENTENCE_ODDS:
        return "closed"
    if not segment.isascii() and script(segment) != "LATIN" and not any(w in odds for w in words):
        return "unknown"
    return "open"


def is_data(line: str) -> bool:
    """A JSON record, or a row of at least four cells of which two in five are numbers."""
    if RECORD.search(line):
        return True
    cells = re.split(r"[,\t|]", line)
    return len(cells) >= 4 and sum(bool(NUMBER.fullmatch(c)) for c in cells) * 5 >= 2 * len(cells)


def segments(text: str, odds: dict[str, float]) -> Iterator[tuple[str, str]]:
    """Kind and text of each segment; code and data lines come whole."""
    code = False
    for line in _linked(text).split("\n"):
        if not line.strip():
            continue
        indented = line[:1] in " \t"
        if CODE.search(line) or (code and indented):
            code = True
            yield "code", line
            continue
        code = False
        if LINK not in line and is_data(line):
            yield "code", line
            continue
        lead = BULLET.match(line)
        heading = line.lstrip()[:2] in ("# ", "##")
        body = line[lead.end() :] if lead else line
        for m in SENTENCE.finditer(body):
            kind = kind_of(m[0], odds)
            yield ("code" if heading and kind == "open" else kind), m[0]


def blocks(parts: list[str]) -> list[list[str]]:
    """Parts in their order, in blocks of up to about BLOCK characters; a longer part is cut."""
    out: list[list[str]] = []
    size = BLOCK
    for p in parts:
        for start in range(0, len(p), BLOCK):
            piece = p[start : start + BLOCK]
            if size + len(piece) > BLOCK:
                out.append([])
                size = 0
            out[-1].append(piece)
            size += len(piece)
    return out


def language(text: str) -> str:
    """The language whose function words are most frequent, or 'other'."""
    counts = function_counts(WORD.findall(text.lower()))
    most = max(counts)
    return _NAMES[counts.index(most)] if most else "other"


def ratio(block: str) -> float:
    raw = block.encode("utf-8", "replace")
    return len(zlib.compress(raw, 6)) / max(1, len(raw))


def bucket(block: str) -> int:
    """Length class of a block: two for each doubling."""
    return int(2 * math.log2(max(1, len(block))))


def frames(split: dict[str, list[str]]) -> dict[str, tuple]:
    """The frame of each of different sentences, given with their words: those without what no other one has, and without numbers."""
    said = Counter(w for words in split.values() for w in set(words))
    return {x: tuple(w for w in words if said[w] > 1 and not w.isdigit()) for x, words in split.items()}


FEATURES = "key {key}, lang string, script string, total long, bad long, links long, items long, usual array<struct<bucket:int,ratio:double>>, doubtful array<struct<bucket:int,ratio:double,size:long,words:long>>"


def features(text: str, odds: dict[str, float]) -> tuple:
    """What one reading of a text gives: sizes, items, the ratios of its blocks, and those blocks that are stuffed if they are redundant."""
    total = bad = links = items = 0
    closed: dict[str, int] = {}
    first: dict[str, str] = {}  # sentences that differ in numbers alone are repeats
    unknown: list[str] = []
    for kind, s in segments(text, odds):
        total += len(s)
        if kind in ("link", "open"):
            bad += len(s)
            links += len(s) if kind == "link" else 0
            items += len(re.findall(LINK + "+", s)) * 3 + sum(any(c.isalpha() for c in w) for w in WORD.findall(s) if len(w) > 1 or not w.isascii())
        elif kind == "closed":
            name = NUMBERS.sub("0", s)
            first.setdefault(name, s)
            closed[first[name]] = closed.get(first[name], 0) + 1
        elif kind == "unknown":
            unknown.append(s)
    usual = [{"bucket": bucket(b), "ratio": ratio(b)} for b in map("\n".join, blocks(list(closed)))]
    doubtful = []
    split = {s: w for s in closed if len(w := tokens(s)) <= SHORT}
    frame = frames(split) if len(split) >= FILLINGS else {}
    filled = Counter(frame.values())
    # repeats count in the ratio only if their frame is filled in turn
    said = {s: closed[s] if filled[f] >= FILLINGS else 1 for s, f in frame.items()}
    for part in blocks([s for s, n in said.items() for _ in range(n)]):
        if len({frame.get(s) for s in part}) <= DENSITY * len(part):
            b = "\n".join(part)
            # a sentence that is taken once counts with its repeats
            times = [closed.get(s, 1) if said.get(s, 1) == 1 else 1 for s in part]
            doubtful.append({"bucket": bucket(b), "ratio": ratio(b), "size": sum(n * len(s) for n, s in zip(times, part)), "words": sum(n * len(split.get(s, ())) for n, s in zip(times, part))})
    for part in blocks(unknown):  # they have no mark at all
        b = "\n".join(part)
        doubtful.append({"bucket": bucket(b), "ratio": ratio(b), "size": sum(map(len, part)), "words": len(tokens(b))})
    return language(text), script(text), total, bad, links, items, usual, doubtful


def word_odds(rows: DataFrame) -> dict[str, float]:
    """For each frequent word the log odds, from -3 to 3, that it stands in a line with a closing mark; from all documents."""
    line = rows.select(F.explode(F.split("text", "\n")).alias("line"))
    lines = line.select(F.col("line").rlike(r"[.!?…。！？؟।][\"'»”’)\]]*\s*$").cast("int").alias("closed"), F.array_distinct(spark_words("line")).alias("words"))
    counts = lines.select("closed", F.explode("words").alias("w")).groupBy("w").agg(F.sum("closed").alias("closed"), F.sum(1 - F.col("closed")).alias("open"))
    totals = written(counts)
    whole = totals.agg(F.sum("closed").alias("c"), F.sum("open").alias("o")).first()
    c, o = whole["c"] or 0, whole["o"] or 0
    # both sides lean on the share of the word in all lines, by PRIOR words
    usual = (F.col("closed") + F.col("open")) / F.lit(max(1, c + o)) * PRIOR
    log = F.log((F.col("closed") + usual) / (c + PRIOR)) - F.log((F.col("open") + usual) / (o + PRIOR))
    least = max(5, SHARE * rows.count())
    found = totals.where(F.col("closed") + F.col("open") >= least).select("w", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), log)).alias("odds"))
    return {r["w"]: r["odds"] for r in found.collect()}  # at most (words a document) / SHARE words


def lowest_ratios(read: DataFrame) -> dict[str, float]:
    """By `length`, `length/script` and `length/script/language`, the ratio below which a block is extremely redundant; a few hundred entries at most.

    The usual ratio is the median; the deviation comes from the quarter below it, which a few stuffed blocks do not move.
    """
    one = read.select("lang", "script", F.explode("usual").alias("b")).select("lang", "script", "b.bucket", F.col("b.ratio").alias("r"))
    cells = one.rollup("bucket", "script", "lang").agg(F.percentile_approx("r", [0.25, 0.5], 1000).alias("q"), F.count("*").alias("n")).where("bucket is not null")
    out = {}
    for x in cells.collect():
        name = "/".join(str(v) for v in (x["bucket"], x["script"], x["lang"]) if v is not None)
        if x["n"] >= ENOUGH:
            low, middle = x["q"]
            out[name] = middle - EXTREME * max(LEAST_DEVIATION, (middle - low) / 0.6745)
    # lengths without enough blocks take the bound of the nearest that has them
    known = sorted(int(k) for k in out if "/" not in k)
    for b in range(64):
        if str(b) not in out:
            out[str(b)] = out[str(min(known, key=lambda k: abs(k - b)))] if known else BARE + HEAD / 2 ** (b / 2)
    return out


def stuffed(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, share: every row with the part of its text that is keywords, links or product tags.

    Null, empty and blank texts have share 0, and so have texts with fewer than LEAST_ITEMS words and links in stuffed
    parts, unless more than half of the text is links. Whole texts are read, however long they are: once for the words
    of the corpus, once for what a text gives, which is written; corpus statistics and verdict come from that.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    odds = word_odds(rows)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["lang", "script", "total", "bad", "links", "items", "usual", "doubtful"]
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                made = pd.DataFrame([features(t, odds) for t in part["text"]], columns=names)
                made.insert(0, "key", part["key"].to_numpy())
                yield made

    read = written(rows.mapInPandas(make, FEATURES.format(key=df.schema[key].dataType.simpleString())))
    lowest = lowest_ratios(read)
    table = F.create_map(*[F.lit(x) for kv in lowest.items() for x in kv]) if lowest else F.lit(None).cast("map<string,double>")

    def bound(b: Column) -> Column:
        size = b["bucket"].cast("string")
        return F.coalesce(F.try_element_at(table, F.concat_ws("/", size, "script", "lang")), F.try_element_at(table, F.concat_ws("/", size, "script")), F.try_element_at(table, size), F.lit(0.0))

    redundant = F.filter("doubtful", lambda b: b["ratio"] < bound(b))
    size = F.col("bad") + F.aggregate(redundant, F.lit(0).cast("long"), lambda a, b: a + b["size"])
    items = F.col("items") + F.aggregate(redundant, F.lit(0).cast("long"), lambda a, b: a + b["words"])
    told = (F.col("total") > 0) & ((items >= LEAST_ITEMS) | (F.col("links") > MOST * F.col("total")))
    share = F.when(told, size / F.greatest("total", F.lit(1))).otherwise(F.lit(0.0))
    return read.select(F.col("key").alias(key), share.alias("share"))
