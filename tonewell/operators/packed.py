"""Several values packed in one field: infer the delimiters of each source, then one row per value.

A candidate delimiter is scored for each source on two things seen outside quotes: how steady the
number of pieces is, and in how many fields every piece looks like a value (a letter in it, at most
four words, not too long). A source with few rows leans on the scores over all sources. Splitting respects quotes and
brackets and runs as one regular expression inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Candidate delimiters as regular expressions, matched outside quotes.
CANDIDATES = {
    "semicolon": ";",
    "comma": ",",
    "bar": r"\|",
    "tab": r"\t",
    "line": r"[\n\r]",
    "spaced_slash": r"(?<=\s)/(?=\s)",
    "slash": r"(?<=\S)/(?=\S)",
    "spaced_dash": r"(?<=\s)[-–—](?=\s)",
    "bullet": "[•·]",
    "colon": ":",
}
#: Quoted runs. They open at the start or after something that is no letter or digit, and end likewise.
QUOTED = r"""(?<![\p{L}\p{N}])(?:"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+')(?![\p{L}\p{N}])"""
VALUE = r"^(?=.*\p{L})\S+(?: \S+){0,3}$"
MAX_VALUE = 60
ACCEPT = 0.6
#: What is held of each candidate before any row is seen, and the rows this counts for.
PRIOR = {"semicolon": 0.9, "comma": 0.9, "bar": 0.9, "tab": 0.9, "line": 0.9, "spaced_slash": 0.7}
PRIOR_ROWS = 50.0
SALTS = 16


def _bare(field: Column) -> Column:
    """The field without enclosing brackets, with a blank at either end."""
    inner = F.regexp_replace(strip(field), r"(?s)^(?:\[(.*)\]|\((.*)\)|\{(.*)\})$", "$1$2$3")
    return F.concat(F.lit(" "), inner, F.lit(" "))


def delimiter_scores(df: DataFrame, field: str, source: str | None = None) -> DataFrame:
    """source, name, rows, score: how well each candidate splits the fields of each source.

    rows counts the fields that hold the candidate outside quotes. Null and empty fields say nothing.
    """
    masked = F.regexp_replace(_bare(F.col(field)), QUOTED, "q")
    base = df.select((F.col(source) if source else F.lit("")).cast("string").alias("source"), masked.alias("text")).where(F.col("text").isNotNull())
    options = F.array(*[F.struct(F.lit(k).alias("name"), F.split(F.col("text"), p).alias("pieces")) for k, p in CANDIDATES.items()])
    cut = base.select("source", F.explode(F.filter(options, lambda o: F.size(o["pieces"]) > 1)).alias("o")).select(
        "source", "o.name", F.filter(F.transform("o.pieces", strip), lambda p: p != "").alias("pieces")
    )
    good = F.forall("pieces", lambda p: p.rlike(VALUE) & (F.length(p) <= MAX_VALUE))
    counted = cut.select("source", "name", F.size("pieces").cast("double").alias("n"), good.cast("double").alias("good"))
    return (
        counted.groupBy("source", "name")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        .select("source", "name", "rows", "n", "good", "nn")
    )


def _score(rows: Column, n: Column, good: Column, nn: Column) -> Column:
    regular = good / rows
    mean = n / rows
    spread = F.sqrt(F.greatest(nn / rows - mean * mean, F.lit(0.0)))
    steady = F.lit(1.0) / (F.lit(1.0) + spread / F.greatest(mean, F.lit(1.0)))
    return regular * (F.lit(0.75) + F.lit(0.25) * steady)


def infer_delimiters(df: DataFrame, field: str, source: str | None = None) -> tuple[list[str], DataFrame]:
    """The names accepted over all sources, and (source, names) of the sources that differ from them.

    The first is at most as long as CANDIDATES. The second stays distributed.
    """
    stats = delimiter_scores(df, field, source)
    pooled = stats.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "good", "nn")])
    seen = {r["name"]: r for r in pooled.select("name", "rows", _score(F.col("rows"), F.col("n"), F.col("good"), F.col("nn")).alias("score")).collect()}  # one per candidate at most
    overall = {k: PRIOR.get(k, 0.0) for k in CANDIDATES}
    overall |= {k: (r["score"] * r["rows"] + overall[k] * PRIOR_ROWS) / (r["rows"] + PRIOR_ROWS) for k, r in seen.items()}
    accepted = sorted(k for k, v in overall.items() if v >= ACCEPT)
    prior = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in overall.items()], F.lit(0.0))
    own = _score(F.col("rows"), F.col("n"), F.col("good"), F.col("nn"))
    blended = (own * F.col("rows") + prior * PRIOR_ROWS) / (F.col("rows") + PRIOR_ROWS)
    usual = F.array(*map(F.lit, accepted)).cast("array<string>")
    judged = stats.withColumn("take", blended >= ACCEPT).groupBy("source").agg(
        F.collect_set(F.when(F.col("take"), F.col("name"))).alias("yes"), F.collect_set(F.when(~F.col("take"), F.col("name"))).alias("no")
    )
    names = F.array_sort(F.array_union(F.array_except(usual, "no"), F.col("yes")))
    return accepted, judged.select("source", names.alias("names")).where(F.col("names") != F.array_sort(usual))


def _pattern(names: Column | list[str]) -> Column:
    """The regular expression of one piece: a quoted one up to a delimiter, else anything but a delimiter."""
    never = "(?!)"
    if isinstance(names, list):
        d = F.lit("|".join(CANDIDATES[k] for k in names) or never)
    else:
        table = F.create_map(*[F.lit(x) for kv in CANDIDATES.items() for x in kv])
        d = F.when(F.size(names) == 0, F.lit(never)).otherwise(F.array_join(F.transform(names, lambda k: table[k]), "|"))
    ends = F.concat(F.lit(r"(?=\s*?(?:"), d, F.lit("|$))"))
    return F.concat(
        F.lit(r"""(?s)\s*+"[^"]*+(?:""[^"]*+)*+\""""), ends, F.lit(r"""|\s*+'[^']*+(?:''[^']*+)*+'"""), ends, F.lit("|(?:(?!"), d, F.lit(").)++")
    )


def pieces(field: Column, pattern: Column) -> Column:
    """The values of one field in order: trimmed, without enclosing quotes, none empty; null gives none."""
    raw = F.regexp_extract_all(_bare(field), pattern, F.lit(0))

    def clean(p: Column) -> Column:
        t = strip(p)
        first = F.substring(t, 1, 1)
        quoted = (F.length(t) > 1) & first.isin('"', "'") & t.endswith(first)
        body = t.substr(F.lit(2), F.length(t) - 2)
        return F.when(quoted, strip(F.replace(body, F.concat(first, first), first))).otherwise(t)

    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), clean), lambda p: p != "")


def packed_lists(df: DataFrame, key: str, field: str, source: str | None = None) -> DataFrame:
    """key, values: every row with the list of the values in `field`, which is empty where there are none.

    Null, empty and delimiter-only fields give an empty list; a value repeated in a field appears again; rows repeated
    in the table are split each on their own; a null source is a source of its own. Other columns of `df` are not
    looked at, whatever their names are.
    """
    accepted, differing = infer_delimiters(df, field, source)
    base = df.select(F.col(key).alias("_key"), F.col(field).alias("_field"), (F.col(source) if source else F.lit("")).cast("string").alias("_source"))
    if source:
        # One source may hold a third of all rows: salted on both sides. Sources like the rest need no partner.
        salted = differing.select(F.col("source").alias("_s"), F.col("names").alias("_names"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        base = base.withColumn("_n", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(
            salted, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_salt")), "left"
        )
        parts = F.when(F.col("_names").isNull(), pieces(F.col("_field"), _pattern(accepted))).otherwise(pieces(F.col("_field"), _pattern(F.col("_names"))))
    else:
        parts = pieces(F.col("_field"), _pattern(accepted))
    return base.select(F.col("_key").alias(key), parts.alias("values"))


def split_packed(df: DataFrame, key: str, field: str, source: str | None = None, value: str = "value") -> DataFrame:
    """key, pos, `value`: one row per value of `field`, counted from 1 over the non-empty values; see packed_lists."""
    lists = packed_lists(df, key, field, source).select(F.col(key).alias("_key"), "values")
    return lists.select(F.col("_key").alias(key), F.posexplode("values").alias("_pos", value)).select(key, (F.col("_pos") + 1).cast("int").alias("pos"), value)
