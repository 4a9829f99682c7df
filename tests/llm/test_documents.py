"""Encoding, mixing and stuffed documents."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tonewell.llm import encode, mixing, stuffed

needs_vocabulary = pytest.mark.skipif(not Path(encode.VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return encode.load_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=80))
def test_encoding_equals_the_library(ranks, reference, text):
    assert encode.Encoder(ranks)(text) == (reference.encode_ordinary(text) if text else [])


@needs_vocabulary
def test_both_merges_agree(ranks):
    rnd = random.Random(6)
    for n in (1, 2, 3, 64, 65, 700):
        piece = bytes(rnd.choice(b"etaoin  shrdlu\xc3\xa9") for _ in range(n))
        assert encode.merge_short(piece, ranks) == encode.merge_long(piece, ranks)


@needs_vocabulary
def test_ids_of_a_table(spark, reference):
    odd = ["", None, "   ", "a" * 50_000, "<|endoftext|> is text", "\U0001f600 naïve ﬁ\x00​", "same", "same"]
    df = spark.createDataFrame([(i % 7, t, "c") for i, t in enumerate(odd)], "doc_id long, text string, ids string")
    got = encode.encode(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i % 7, tuple(reference.encode_ordinary(t) if t else [])) for i, t in enumerate(odd))
    counts = encode.token_counts(df, "doc_id", "text").collect()
    assert sum(r.tokens for r in counts) == sum(len(r.ids) for r in got)
    assert encode.encode(df.where("false"), "doc_id", "text").count() == 0


DOCS = "doc_id long, source string, tokens long, extra string"
TARGETS = "source string, target_weight double, max_repeats int"


def mix(spark, docs, targets, budget=None):
    d, t = spark.createDataFrame([(*r, "x") for r in docs], DOCS), spark.createDataFrame(targets, TARGETS)
    m = mixing.mixture(d, t, budget)
    return m.collect(), {r.source: r for r in mixing.shares(m, t).collect()}


def test_shares_are_reached(spark):
    rnd = random.Random(8)
    docs = [(i, "big" if i % 3 else "small", rnd.randint(1, 40)) for i in range(3000)] + [(9000, None, 5), (9001, "stranger", 5), (9002, "small", 0)]
    rows, shares = mix(spark, docs, [("big", 3.0, 1), ("small", 3.0, 4), ("nowhere", 1.0, 2), (None, 1.0, 1), ("big", 0.0, 9), ("bad", float("nan"), 1)])
    assert abs(shares["big"].actual_share - 0.5) < 0.01 and shares["nowhere"].tokens == 0
    assert abs(shares["big"].target_share - 3 / 7) < 1e-9 and shares["small"].most_repeats <= 4
    used = {}
    for r in rows:
        used.setdefault((r.doc_id, r.source), []).append(r.repeat)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in used.values())
    assert {r.source for r in rows} == {"big", "small"} and 9002 not in {r.doc_id for r in rows}


def test_budget_and_dry_sources(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(5)]
    rows, shares = mix(spark, docs, [("a", 1.0, 1), ("b", 1.0, 2)], budget=600)
    assert sum(r.tokens for r in rows) == 600 and shares["b"].tokens == 100 and shares["b"].most_repeats == 2
    rows, _ = mix(spark, docs, [("a", 1.0, 1), ("b", 1.0, 2)])
    assert sum(r.tokens for r in rows) == 200
    rows, _ = mix(spark, docs, [("a", 1.0, 1), ("b", 1.0, 2)], budget=10**9)
    assert sum(r.tokens for r in rows) == 1100


def test_order_serves_by_weight(spark):
    docs = [(i, "a", 1) for i in range(300)] + [(1000 + i, "b", 1) for i in range(300)]
    rows, _ = mix(spark, docs, [("a", 2.0, 1), ("b", 1.0, 1)])
    first = sorted(rows, key=lambda r: (r.finish, r.source, r.doc_id))[:90]
    assert sum(r.source == "a" for r in first) in range(58, 63)


@pytest.mark.parametrize("docs, targets", [([], [("a", 1.0, 1)]), ([(1, "a", 3)], []), ([(1, "a", 0)], [("a", 1.0, 1)])])
def test_nothing_to_mix(spark, docs, targets):
    rows, shares = mix(spark, docs, targets)
    assert rows == [] and all(s.tokens == 0 for s in shares.values())


PROSE = "A rusty bell is ringing softly in a harbour while young dogs are barking over the bench."
SPAM = {
    "tags": " ".join(f"#tag{i} #sound" for i in range(30)),
    "words": "bell wav dog download bell mp3 dog sound bell effect dog wav " * 8,
    "list": "; ".join(f"thing{i}; room tone" for i in range(40)),
    "links": "\n".join(f"https://www.site{i}.example/a/b?id={i}" for i in range(20)),
    "anchors": "".join(f'<li><a href="http://x{i}.test/a">bell</a></li>' for i in range(15)),
    "sentences": " ".join(f"Best bell sounds in Town{i}. Cheap bell sounds, bell wav." for i in range(25)),
    "shop": "\n".join(f"Bell Pack Vol {i} WAV 24bit 96k $1{i}.99 NEW" for i in range(25)),
    "cyrillic": "звук дождя скачать бесплатно звук ветра " * 40, "cyrillic sentences": " ".join(f"Лучшие звуки дождя в {t}." for t in ["Москве", "Туле", "Омске", "Твери", "Уфе"] * 12),
    "chinese": "雨声下载免费雨声 " * 40, "chinese sentences": "".join(f"最好的雨声在{t}。" for t in ["北京", "上海", "广州", "深圳"] * 15), "thai again": "ร้องเพลงในป่า " * 20, "two links": "https://www.site.example/a https://www.site.example/b",
    "mostly": PROSE + "\n" + " ".join(f"#tag{i}" for i in range(60)) + "\n" + PROSE,
}
HAM = {
    "prose": " ".join([PROSE] * 6), "tail": " ".join([PROSE] * 8) + "\nTags: bell, dog, harbour, rain\n[1] https://www.site.example/a", "lines": "\n".join(["- " + PROSE] * 12),
    "code": "def trim(clip, start, stop):\n    # cut\n    rate = 32000\n    return clip[start * rate:stop * rate]\n" * 6,
    "data": "\n".join('{"clip_id": "bell_%d", "caption": "bell", "duration": %d.5}' % (i, i) for i in range(20)),
    "log": "\n".join(f"[00:{i:02d}] {PROSE}" for i in range(12)), "french": "Le chien aboie dans la cour et la cloche sonne près du quai. " * 6, "empty": "", "blank": " \n ", "null": None, "odd": "==========", "haha": "ha" * 60,
    "thai": "ร้องเพลงในป่า", "upper": PROSE.upper() * 4,
    "russian": "Дождь стучит по крыше старого дома, а во дворе тихо лает собака. Вечером ветер приносит с реки далёкий звон колокола. Потом всё стихает, и слышно только, как скрипит калитка.", "russian words": "звук дождя и ветра",
}


def test_stuffed(spark):
    names = {i: k for i, k in enumerate([*SPAM, *HAM])}
    df = spark.createDataFrame([(i, (SPAM | HAM)[k], "c") for i, k in names.items()], "doc_id long, text string, share string")
    got = {names[r.doc_id] for r in stuffed.stuffed(df, "doc_id", "text").collect() if r.share > stuffed.MOST}
    assert got == set(SPAM)
    assert stuffed.stuffed(df.where("false"), "doc_id", "text").count() == 0


def test_the_ratio_decides(spark, monkeypatch):
    named = ["cyrillic", "chinese", "cyrillic sentences", "sentences"]
    df = spark.createDataFrame([(i, SPAM[k]) for i, k in enumerate(named)] + [(9, HAM["prose"])], "doc_id long, text string")
    assert {r.doc_id for r in stuffed.stuffed(df, "doc_id", "text").collect() if r.share > stuffed.MOST} == {0, 1, 2, 3}
    monkeypatch.setattr(stuffed, "ratio", lambda b: 1.0)
    assert not [r for r in stuffed.stuffed(df, "doc_id", "text").collect() if r.share > stuffed.MOST]


def test_very_long_text_is_read_whole(spark):
    df = spark.createDataFrame([(1, " ".join([PROSE] * 500) + "\n" + "bell wav dog mp3 " * 12_000), (2, "bell wav dog mp3 " * 500 + "\n" + " ".join([PROSE] * 5000))], "doc_id long, text string")
    shares = {r.doc_id: r.share for r in stuffed.stuffed(df, "doc_id", "text").collect()}
    assert shares[1] > 0.5 > shares[2]


def test_true_sentences_that_carry_one_keyword_again(spark):
    towns = ["Paris", "New York", "Rome", "Lima", "Oslo", "Bonn", "Kyiv"]
    spam = ["\n".join(f"The best bell sounds in {towns[i % 7]}." for i in range(60)), " ".join(f"Best sounds of {k} in the town." for k in ["bell", "dog", "rain", "door"] * 15)]
    ham = ["\n".join(f"The bell is ringing at {i}." for i in range(60)), " ".join(["The dog is in the yard."] * 30), " ".join([PROSE] * 20) + " " + " ".join(f"The best bell sounds in {t}." for t in towns * 2)]
    df = spark.createDataFrame(list(enumerate(spam + ham)), "doc_id long, text string")
    assert {r.doc_id for r in stuffed.stuffed(df, "doc_id", "text").collect() if r.share > stuffed.MOST} == {0, 1}
