"""Splitting of packed fields: delimiters, quotes, brackets, odd rows, and any text whatever."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewell.operators.packed import infer_delimiters, split_packed

SCHEMA = "id long, packed string, source string, value string, pos string"


def split(spark, fields, sources=None):
    rows = [(i, f, (sources or {}).get(i, "s"), "clash", "clash") for i, f in enumerate(fields)]
    out = split_packed(spark.createDataFrame(rows, SCHEMA), "id", "packed", "source")
    got = {i: [] for i in range(len(fields))}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.pos)):
        got[r.id].append(r.value)
        assert r.pos == len(got[r.id])
    return got


def test_forms(spark):
    got = split(spark, [
        'hail; "gong; massive" ;;rain', "a|b c|'d|e'", '["x", "y z"]', "['one', \"two's\"]", "50/60 hz / close up / rock'n'roll", 'tin\t"spotted ""tram"" take"\nlast',
        "mix;one, two | three", None, "", " ; ,", "same,same,Same", "  lone  ", '"never closed;b',
    ])
    assert got[0] == ["hail", "gong; massive", "rain"]
    assert got[1] == ["a", "b c", "d|e"]
    assert got[2] == ["x", "y z"] and got[3] == ["one", "two's"]
    assert got[4] == ["50/60 hz", "close up", "rock'n'roll"]
    assert got[5] == ["tin", 'spotted "tram" take', "last"]
    assert got[6] == ["mix", "one", "two", "three"]
    assert got[7] == got[8] == got[9] == []
    assert got[10] == ["same", "same", "Same"] and got[11] == ["lone"] and got[12] == ['"never closed', "b"]


def test_source_with_its_own_habit(spark):
    """A source that packs with colons is found out; the others keep colons in their values."""
    fields = [f"word{i % 7}:other{i % 5}:third" for i in range(400)] + ["plain;time: late"] * 40
    sources = {i: "odd" for i in range(400)} | {i: "usual" for i in range(400, 440)}
    got = split(spark, fields, sources)
    assert got[0] == ["word0", "other0", "third"]
    assert got[439] in (["plain", "time: late"], ["plain", "time", "late"])


def test_hot_and_null_sources_and_repeated_rows(spark):
    df = spark.range(300).select(F.lit(1).cast("long").alias("id"), F.lit("a;b").alias("packed"), F.when(F.col("id") < 200, "hot").alias("source"))
    out = split_packed(df, "id", "packed", "source")
    assert out.count() == 600 and out.where("value = 'b'").select("pos").distinct().count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, packed string")
    assert split_packed(df, "id", "packed").count() == 0
    accepted, differing = infer_delimiters(df, "packed")
    assert "semicolon" in accepted and differing.count() == 0


def test_very_long_field(spark):
    got = split(spark, ["x" * 300_000 + ";" + "q;" * 50_000, '"' + "y" * 200_000 + '";z'])
    assert len(got[0]) == 50_001 and len(got[1]) == 2


def reference(text):
    """A plain reader of one field: quotes at the start of a piece, doubled quotes inside, six delimiters."""
    t = text.strip()
    pieces, i, current = [], 0, ""
    t = " " + t + " "
    while i < len(t):
        c = t[i]
        if c in "\"'" and not current.strip():
            j, value = i + 1, ""
            while j < len(t):
                if t[j] == c:
                    if t[j + 1 : j + 2] == c:
                        value += c
                        j += 2
                        continue
                    break
                value += t[j]
                j += 1
            rest = t[j + 1 :].lstrip(" ") if j < len(t) else "?"
            if j < len(t) and (not rest or rest[0] in ";,|\t\n" or (rest[0] == "/" and t[j + 1 : j + 2] == " ")):
                pieces.append(value.strip())
                current, i = "", j + 1
                continue
        if c in ";,|\t\n" or (c == "/" and t[i - 1].isspace() and t[i + 1].isspace()):
            pieces.append(current.strip())
            current = ""
        else:
            current += c
        i += 1
    pieces.append(current.strip())
    return [p for p in pieces if p]


plain = st.text("abcé50 -", min_size=1, max_size=8).map(str.strip).filter(lambda s: s and s[0] not in "-")
quoted = st.text("ab;,|/ '", min_size=1, max_size=8).map(str.strip).filter(bool).map(lambda s: '"' + s.replace('"', '""') + '"')


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.one_of(plain, quoted), min_size=1, max_size=5), st.sampled_from([";", ", ", "|", "\t", "\n", " / "])), min_size=1, max_size=12))
def test_against_a_plain_reader(spark, made):
    fields = [d.join(v) for v, d in made]
    got = split(spark, fields)
    for i, f in enumerate(fields):
        assert got[i] == reference(f), f
