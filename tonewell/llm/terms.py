"""How often every term occurs and in how many records, by suffix-sorted n-gram counting.

Each record gives the suffixes of its term lists, cut to `longest` terms, each with marks that say for which of its
prefixes it is the first place in the record. As a record is read whole, these marks stand for the record sets: the
records of a prefix are the marks it got, so nothing grows with the number of records. Equal suffixes are added up where
they are made, then routed by first term, sorted in reverse lexicographic order, and read once with a stack that
holds the open prefix: when a prefix closes its counts are final, and its occurrences pass on to the shorter prefix
under it. A first term with many suffixes is spread by its second term; counts of the parts simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of all records above which a term is too common, and the records up to which it is too rare.
COMMON_SHARE = 0.05
RARE_RECORDS = 1
#: Different suffixes that are held to be added up, and rows that are given at once.
HELD = 200_000
BATCH = 20_000
MADE = "field_name string, suffix array<string>, marks int, n long"
COUNTED = "field_name string, gram array<string>, occurrences long, records long"


def _suffixes(longest: int):
    """Rows (field_name, lists), one per record, give suffixes with their marks, added up until HELD of them are there."""

    def frame(held: dict) -> pd.DataFrame:
        made = pd.DataFrame([(f, list(s), m, n) for (f, s, m), n in held.items()], columns=["field_name", "suffix", "marks", "n"])
        held.clear()
        return made

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}
        for batch in batches:
            for field, lists in zip(batch["field_name"], batch["lists"]):
                seen: set[tuple] = set()  # the prefixes of one record
                for terms in lists if lists is not None else ():
                    terms = [t for t in terms if t is not None] if terms is not None else []
                    for i in range(len(terms)):
                        suffix = tuple(terms[i : i + longest])
                        marks = 0
                        for d in range(len(suffix)):
                            prefix = suffix[: d + 1]
                            if prefix not in seen:
                                seen.add(prefix)
                                marks |= 1 << d
                        name = (field, suffix, marks)
                        held[name] = held.get(name, 0) + 1
                        if len(held) >= HELD:
                            yield frame(held)
        if held:
            yield frame(held)

    return make


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (field_name, suffix, marks, n), equal fields together and suffixes descending; gives (field_name, gram, occurrences, records)."""
    field: str | None = None
    terms: list[str] = []
    counts: list[int] = []
    records: list[int] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(terms) > depth:
            out.append((field, list(terms), counts[-1], records.pop()))
            n = counts.pop()
            terms.pop()
            if terms:
                counts[-1] += n

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["field_name", "gram", "occurrences", "records"])
        out.clear()
        return made

    for batch in batches:
        for name, suffix, marks, n in zip(batch["field_name"], batch["suffix"], batch["marks"], batch["n"]):
            if name != field:
                close(0)
                field = name
            same = 0
            for a, b in zip(terms, suffix):
                if a != b:
                    break
                same += 1
            close(same)
            for t in suffix[same:]:
                terms.append(t)
                counts.append(0)
                records.append(0)
            counts[-1] += int(n)
            for d in range(len(terms)):
                if marks >> d & 1:
                    records[d] += int(n)
            if len(out) >= BATCH:
                yield frame()
    close(0)
    if out:
        yield frame()


def term_counts(lists: DataFrame, longest: int = 1) -> DataFrame:
    """field_name, term, n, occurrences, records for every run of 1 to `longest` terms, joined by blanks.

    `lists` has field_name and lists (ARRAY<ARRAY<STRING>>); every row is a record, runs do not cross its lists. Null
    lists and null terms count as nothing; a term repeated in a record adds to its occurrences and not to its records.
    Rows that are repeated are records of their own; other columns are not looked at.
    """
    made = lists.select("field_name", "lists").mapInPandas(_suffixes(longest), MADE)
    added = made.groupBy("field_name", "suffix", "marks").agg(F.sum("n").alias("n"))
    # suffixes of one first term differ in the second: no first term fills a task, and no suffix is cut from its like
    spread = F.pmod(F.xxhash64(F.try_element_at("suffix", F.lit(2))), F.lit(64))
    routed = added.withColumn("_first", F.col("suffix")[0]).withColumn("_second", spread)
    ordered = routed.repartition("field_name", "_first", "_second").sortWithinPartitions("field_name", F.desc("suffix"))
    parts = ordered.select("field_name", "suffix", "marks", "n").mapInPandas(_stack, COUNTED)
    summed = parts.groupBy("field_name", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return summed.select("field_name", F.array_join("gram", " ").alias("term"), F.size("gram").alias("n"), "occurrences", "records")


def marked(counts: DataFrame, total: int) -> DataFrame:
    """With mark: `rare`, `common` or null, against the number of all records."""
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") > F.lit(COMMON_SHARE) * F.lit(total), "common")
    return counts.withColumn("mark", mark)
