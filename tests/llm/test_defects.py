from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonewell.llm import defects as D

CAPTION = "A rusty bell is ringing softly in a harbour while young dogs are barking over the bench with rain in the background."
DOCUMENTS = [
    ("en", "The dog is barking in the yard and the bell rings while people walk near the harbour with rain in the background."),
    ("fr", "La cloche sonne doucement dans la cour et le chien aboie près du quai pendant la nuit sous la pluie."),
    ("de", "Die Glocke klingt leise im Hof und der Hund bellt neben dem Kai während der ganzen Nacht im Regen."),
    ("es", "La campana suena despacio en el mercado y el perro ladra junto al muelle durante toda la noche con lluvia."),
]


def made_pairs(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """Captions and complete responses of a small grammar."""
    r = random.Random(seed)
    things, places = "bell drum engine kettle motor gate horn clock siren radio".split(), "harbour garden station kitchen street market tunnel office garage forest".split()
    who, does, over = "dogs cats birds people children horses ducks workers boys girls".split(), "barking meowing singing talking walking running jumping eating howling shouting".split(), "bench table fence wall grass floor roof bridge stone boat".split()
    how, rings, kinds = "softly loudly slowly sharply oddly".split(), "ringing beating humming clicking buzzing".split(), "rusty wooden tiny young old busy small brown wild wet".split()
    tails = ["", " with {0} in the background", " while {0} continues", " as a man repeats no I am unable to come", " as {0} fades in"]
    out = []
    for _ in range(n):
        a, b, t, w, v, o = r.choice(kinds), r.choice(kinds), r.choice(things), r.choice(who), r.choice(does), r.choice(over)
        h, g, p = r.choice(how), r.choice(rings), r.choice(places)
        tail = r.choice(tails).format(r.choice("rain wind traffic hum music".split()))
        core = r.choice([f"a {a} {t} is {g} {h} in a {p} while {b} {w} are {v} over the {o}", f"{b} {w} are {v} near the {o} as a {a} {t} goes on {g} {h} in the {p}"])
        caption = (core[0].upper() + core[1:] + tail + r.choice([".", "."]))
        opening, mark = r.choice([("Find audio where ", "."), ("Play a clip where ", "."), ("Can you find audio where ", "?"), ("Search for moments when ", ".")])
        ending = r.choice(["", "", tail, f", not {r.choice(kinds)} {r.choice(who)} {r.choice(does)}", f" but no {r.choice(kinds)} {r.choice(who)} {r.choice(does)}"])
        items = [f"{a} {t}", f"{b} {w}", p, v, o, f"{g} {h}"]
        r.shuffle(items)
        listed = ", ".join(items + r.sample(["field recording", "stereo", "rain", "sound effect"], 2))
        out.append((caption, listed if r.random() < 0.1 else opening + core + ending + mark))
    return out


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(DOCUMENTS)], "doc_id long, lang string, text string")
    return D.fit(spark.createDataFrame([(i, *p) for i, p in enumerate(made_pairs(3_000))], "key long, c string, q string"), df)


def test_cut_endings_are_told_from_whole_ones(model):
    """Held-out pairs of the grammar: unmarked whole responses and cut ones."""
    whole = cut = found = 0
    for c, q in made_pairs(400, 1):
        if q.endswith((".", "?")):
            whole += D.truncated(c, q[:-1], model)
            for t in D._cuts(q):
                cut, found = cut + 1, found + D.truncated(c, t, model)
    assert whole <= 8 and found >= 0.85 * cut  # some cuts leave a complete sentence


@pytest.mark.parametrize("query, defect", [
    (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A", "empty"), ("<query></query>", "empty"), ("Query:", "empty"), ("[]", "empty"), ("...", "empty"),
    ("I'm sorry, but I can't help with that.", "refusal"), ("Hmm. I cannot help with that request.", "refusal"), ("As an AI model, I cannot hear audio.", "refusal"), ("No query can be produced.", "refusal"),
    (f"I need more information before I can turn this into a query: {CAPTION}", "refusal"),
    (CAPTION, "copy"), (f"Caption: {CAPTION.upper()}", "copy"), (f'query - "{CAPTION}"', "copy"), (CAPTION.replace(" ", "  ").rstrip("."), "copy"), (f"[Caption 2] {CAPTION}", "copy"), (f"Find: {CAPTION}", None), (f"{CAPTION} Caption", None),
    ("Suche den Klang: die Glocke klingt leise im Hof", "language"), ("Je cherche un son : la cloche sonne doucement dans la cour", "language"),
    ("Find audio where a rusty bell is ringing softly in a harbour while young dogs are barking over the", "truncated"),
    ("Find audio where a rusty bell is ringing softly in a harbour while young do", "truncated"), ("Find audio where a rusty", "truncated"),
    ("Find audio where a rusty bell is ringing…", "truncated"), ("rusty bell, young dogs, harbour, barking, field reco", "truncated"), ("rusty bell, young dogs, harb", "truncated"),
    ("rusty bell, young dogs,", "truncated"), ('Find "a rusty bell ringing in a harbour', "truncated"), ("```json\n{\"query\": \"bell", "truncated"),
    ("Find audio where a rusty bell is ringing softly in a harbour while young dogs are barking over the bench, not old cats", "truncated"),
    ("Find audio where a rusty bell is ringing softly in a harbour while young dogs are barking over the bench with rain in the", "truncated"),
    ("Find audio where a rusty bell is ringing softly in a harbour while young dogs are barking over the bench", None),
    ("Can you find audio where young dogs are barking over the bench as a rusty bell goes on ringing softly in the harbour?", None),
    ("Find audio where a rusty bell is ringing softly in a harbour while young dogs are barking over the bench, not old cats meowing", None),
    ("rusty bell, ringing softly, harbour, young dogs, barking, bench, stereo", None), ("Find thunder.", None), ("dog barks", None),
    ("Play a clip where a rusty bell is ringing softly in a harbour while young dogs are barking over the bench as a man repeats no I am unable to come", None),
])
def test_defect(model, query, defect):
    assert D.defect(CAPTION, query, model) == defect


def test_blank_caption_is_no_defect(model):
    assert D.defect(None, "Find audio of a rusty bell ringing in a harbour", model) is None
    assert D.defect("  ", "Suche den Klang: die Glocke klingt leise im Hof", model) is None
    assert D.defect("Die Glocke klingt leise im Hof, danach ist es still.", "Suche den Klang: die Glocke klingt leise im Hof", model) is None


def test_tiles():
    assert D.tiles("a b c d".split(), "c d a b".split()) == [(0, 2, 2), (2, 0, 2)]
    assert D.tiles([], ["a"]) == [] and D.tiles("x x x".split(), "x".split()) == [(0, 0, 1)]


def naive_tiles(a, b):
    """Greedy string tiling as it is defined, for the total it covers."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if not n:
            return total
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        total += n


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=150, deadline=None)
def test_tiles_are_runs_longest_first(a, b):
    got = D.tiles(a, b)
    assert all(a[i : i + n] == b[j : j + n] and n for i, j, n in got)
    places_a, places_b = [x for i, _, n in got for x in range(i, i + n)], [x for _, j, n in got for x in range(j, j + n)]
    assert len(set(places_a)) == len(places_a) and len(set(places_b)) == len(places_b)
    assert len(places_a) == naive_tiles(a, b) == sum((Counter(a) & Counter(b)).values())
    longest = max((n for n in range(1, 15) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
    assert max((n for *_, n in got), default=0) == longest


def test_tiling_of_repeated_words_is_fast():
    began = time.perf_counter()
    assert D.tiles(["x"] * 800, ["x"] * 801) == [(0, 0, 800)]
    assert time.perf_counter() - began < 0.1
    rest = random.Random(5).choices("abcdefgh", k=20_000)
    assert D.tiles(rest, rest[7_000:] + rest[:7_000])[0] == (7_000, 0, 13_000)
    assert time.perf_counter() - began < 5


def test_unclosed():
    for text in ("Wo bellt ein „Hund“?", "ein »Hund« bellt?", '12" vinyl', "« un chien » aboie", "Home » Sounds » Dogs", "”ord” sade", "a) b) c", "(a [b) c", "nice :( sound", "日本「語」", "x < y", "- a\n- b"):
        assert not D.unclosed(text), text
    for text in ("Wo bellt ein „Hund", "ein »Hund bellt", "« un chien", "日本「語", "a <b", "1. a\n2.", "steps:\n-"):
        assert D.unclosed(text), text
    assert not D.unclosed('<b>a</b> (b [c]) "d" ```e```') and not D.unclosed("it's 5) fine")
    for text in ("(a", "[a)", '"a', "```a", "<p>a", "“a"):
        assert D.unclosed(text)


def test_table(spark):
    pairs = spark.createDataFrame([(1, CAPTION, None, "x"), (1, CAPTION, None, "x"), (2, None, "Find rain.", "x"), (3, CAPTION, "word " * 50_000 + ".", "x")], "query_id long, original_caption string, query string, defect string")
    docs = spark.createDataFrame([(1, "en", DOCUMENTS[0][1])], "doc_id long, lang string, text string")
    assert sorted((r.query_id, r.defect) for r in D.defects(pairs, docs).collect()) == [(1, "empty"), (1, "empty")]
    assert D.defects(pairs.where(F.lit(False)), docs.where(F.lit(False))).count() == 0


GERMAN = "Eine rostige Glocke klingt leise im Hafen, während junge Hunde neben dem Kai bellen."
RUSSIAN = "Найди звук, где ржавый колокол тихо звонит в гавани"


@pytest.mark.parametrize("caption", [CAPTION, GERMAN, "Una campana oxidada suena despacio en el puerto mientras los perros ladran."])
@pytest.mark.parametrize("query", [RUSSIAN, "找钟声", "请找出港口里生锈的钟轻轻响起的声音", "ابحث عن صوت جرس صدئ يرن في الميناء", "鐘の音を探して", "녹슨 종소리를 찾아 줘", "Βρες τον ήχο μιας καμπάνας"])
def test_other_scripts_are_other_languages(model, caption, query):
    assert D.defect(caption, query, model) == "language" == D.defect(query, caption, model)


def test_one_script_is_no_defect(model):
    assert D.script("鐘の音を探して") != D.script("找钟声") and D.script("12 34") is None and D.script("ｂｅｌｌ ２") == "LATIN"
    assert not D.foreign(RUSSIAN, "Колокол звонит в гавани", model)
    assert not D.foreign(CAPTION, "Find audio of a rusty bell (колокол) ringing softly in a harbour", model)
    assert not D.foreign(CAPTION, "123, 45", model) and not D.foreign("123", RUSSIAN, model)
    assert D.foreign(CAPTION, "Die Glocke klingt leise im Hof und der Hund bellt", model)


def test_endings_are_learned_from_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_PAIRS", 100)
    rows = [(i, f"a dog w{i} barks near the old house", f"find a dog w{i} that barks {'often' if i % 20 == 0 else 'now'} {'seldom' if i % 20 == 1 and i > 1 else 'here'} near the house.") for i in range(300)]
    model = D.Model()
    D.fit_endings(spark.createDataFrame(rows, "key long, c string, q string"), model)
    # 15 of 300 pairs are five of a hundred, 14 are not: no pair is left out of the count
    assert "often" in model.known and "seldom" not in model.known
    cells = {c for _, c, q in rows for t in [D.body(q)] for c in D.ending(D.words(c), D.words(t), t, model.piece)}
    assert (model.weights[sorted(cells)] != 0).mean() > 0.99


def test_languages_are_learned_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "PER_LANGUAGE", 10)
    rows = [(i, f"the dog barks qx{chr(97 + i % 26)}{chr(97 + i // 26)}z", "en") for i in range(200)]
    model = D.Model()
    D.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert all(f"{chr(97 + i % 26)}{chr(97 + i // 26)}z" in model.triples["en"] for i in range(200))
