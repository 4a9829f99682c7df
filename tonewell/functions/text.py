"""Text functions on columns; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of letters and digits; the underscore is neither.
WORD = r"[\p{L}\p{N}]+"

# The words one to ten that a listwise answer may spell out.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """The words of a text in order, lower-cased; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_set(text: Column | str) -> Column:
    """Sorted 64-bit hashes of the distinct words of a text."""
    return F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))


def strip(text: Column | str) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(col(text), r"^[\s ]+|[\s ]+$", "")


def filled(text: Column | str) -> Column:
    """Whether there is more than white space; false for null."""
    return F.coalesce(col(text).rlike(r"[^\s\u00a0]"), F.lit(False))


def squash(text: Column | str) -> Column:
    """Lower-cased, with runs of white space as one blank: the lookup key of a caption."""
    return F.lower(F.trim(F.regexp_replace(col(text), r"\s+", " ")))


def tokens(text: Column | str) -> Column:
    """ASCII tokens: other characters than a-z, 0-9 and space part them."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def slug(text: Column | str, default: str = "value") -> Column:
    """a-z and 0-9 joined by single underscores; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when((s == "") | s.isNull(), F.lit(default)).otherwise(s)


def file_slug(text: Column | str, default: str = "value") -> Column:
    """Letters, digits, '-', '.' and '_' stay as they are, anything else becomes an underscore; none at the ends; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip(text), r"[^\p{L}\p{N}\-._]", "_"), "^_+|_+$", "")
    return F.when((s == "") | s.isNull(), F.lit(default)).otherwise(s)


def bucket_slug(text: Column | str) -> Column:
    """The file name part of a query bucket."""
    return F.translate(F.lower(col(text)), "/-", "__")


def stem(path: Column | str) -> Column:
    """The file name without folder and last suffix; a leading dot is no suffix."""
    name = F.regexp_replace(col(path), r"^.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def clip_of_key(key: Column | str) -> Column:
    """The clip id in an archive key: without the data set in front and the first segment mark behind."""
    return F.regexp_replace(F.regexp_replace(col(key), r"^[^/]*/", ""), r"_seg0$", "")


def parse_score(text: Column | str, default: float = 0.0, how: str = "marked") -> Column:
    """The score an answer states, `default` if it states none.

    `marked`: after the last SCORE mark, else its last number, brought to [0, 1]. `last`: its last number, brought to
    [0, 1]. `raw`: its last number as it is.
    """
    numbers = F.try_element_at(F.regexp_extract_all(col(text), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1))
    marked = F.try_element_at(F.regexp_extract_all(col(text), F.lit(r"(?i)score\s*:\s*(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1))
    found = {"marked": F.coalesce(marked, numbers), "last": numbers, "raw": numbers}[how]
    value = F.coalesce(found.try_cast("double"), F.lit(float(default)))
    return value if how == "raw" else F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


#: What a listwise answer puts its order into.
ORDER_REGION = r"(?i)order\s*:?\s*\[?([0-9,\s]+)\]?"


def parse_order(text: Column | str, n: Column | int, how: str = "all", region: str = ORDER_REGION) -> Column:
    """Zero-based positions that an answer to a list of `n` states; numbers out of range and repetitions fall away.

    Both the ORDER region and the whole text are read, digits before spelled numbers from one to ten. `all`: what the
    region states, then what the whole text adds. `first`: what the first of both states that states any. `digits`:
    likewise, without spelled numbers.
    """
    size = F.lit(n) if isinstance(n, int) else n
    whole = F.coalesce(col(text), F.lit(""))
    spelled = "|".join(NUMBER_WORDS)

    def stated(c: Column) -> Column:
        digits = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda t: t.try_cast("int"))
        if how != "digits":
            names = F.regexp_extract_all(F.lower(c), F.lit(rf"\b(?:{spelled})\b"), F.lit(0))
            digits = F.concat(digits, F.transform(names, lambda t: F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), t).cast("int")))
        return F.array_distinct(F.transform(F.filter(digits, lambda v: (v >= 1) & (v <= size)), lambda v: v - 1))

    inner, outer = stated(F.regexp_extract(whole, region, 1)), stated(whole)
    if how == "all":
        return F.array_distinct(F.concat(inner, outer))
    return F.when(F.size(inner) > 0, inner).otherwise(outer)


def complete_order(order: Column, fallback: Column) -> Column:
    """`order`, then what it lacks in the order of `fallback`."""
    return F.concat(order, F.array_except(fallback, order))


def cut_continuation(text: Column | str, marks: tuple[str, ...] = ("[/INST]", "<s>")) -> Column:
    """Text up to the first of the chat marks, trimmed."""
    c = col(text)
    for m in marks:
        c = F.substring_index(c, m, 1)
    return F.trim(c)
