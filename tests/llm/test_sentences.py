import random

import pytest

from symstream.llm import sentences
from symstream.llm.maxent import MaxEnt

NAMES = ["രാമൻ", "സീത", "കോട്ടയം", "വയനാട്"]
VERBS = ["വന്നു", "പോയി", "കണ്ടു", "ആണ്"]


def made(chance):
    """A text and its sentences."""
    out = []
    for _ in range(chance.randint(1, 4)):
        words = chance.choices(["പുഴ", "മഴ", "ഡോ. " + chance.choice(NAMES), "രൂ. 45.60", "ജി.എം. " + chance.choice(NAMES), "1998-ൽ", "എങ്കിലും…"], k=chance.randint(2, 5))
        body = " ".join(words) + " " + chance.choice(VERBS) + chance.choice([".", ".", "!", "?"])
        kind = chance.random()
        if kind < 0.15:
            body = f"“{' '.join(chance.choices(NAMES, k=2))} {chance.choice(VERBS)}. {chance.choice(NAMES)} {chance.choice(VERBS)}!” എന്ന് " + body
        elif kind < 0.3:
            body = f"അവൻ പറഞ്ഞു: “{chance.choice(NAMES)} {chance.choice(VERBS)}.”"
        out.append(body)
    return out


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(8)
    return [made(chance) for _ in range(1500)]


def joined(parts, chance):
    text, spans = "", []
    for p in parts:
        if text:
            text += chance.choice([" ", " ", "\n", "  "])
        spans.append((len(text), len(text) + len(p)))
        text += p
    return text, spans


@pytest.fixture(scope="module")
def splitter(corpus):
    chance = random.Random(1)
    return sentences.Splitter(sentences.train([joined(p, chance)[0] for p in corpus[:1000]]))


def test_held_out(corpus, splitter):
    chance = random.Random(2)
    right = wrong = missed = 0
    for parts in corpus[1000:]:
        text, spans = joined(parts, chance)
        got = set(splitter.split(text))
        right += len(got & set(spans))
        wrong += len(got - set(spans))
        missed += len(set(spans) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_cases(splitter):
    assert splitter.split("") == splitter.split("  \n") == []
    assert splitter.split(" 12. 5% (7)\n8 ") == [(1, 13)]
    assert splitter.split("പുഴ വന്നു\nമഴ") == [(0, 9), (10, 12)]
    assert splitter.split("1. പുഴ പോയി.\n2. മഴ വന്നു.") == [(0, 12), (13, 25)]
    long = "പുഴ വന്നു. " * 20_000
    assert len(splitter.split(long)) == 20_000


def test_operator(spark, corpus):
    chance = random.Random(3)
    rows = [(i, joined(p, chance)[0], i) for i, p in enumerate(corpus[:300])] + [(900, None, 0), (901, "", 0), (902, " ", 0), (903, "à´•à´¥ à´’à´¨àµ\x8dà´¨àµ\x8d.", 0), (904, "45", 0), (904, "45", 0)]
    got = sentences.split_sentences(spark.createDataFrame(rows, "k int, t string, end_pos int"), "k", "t")
    by = got.groupBy("k").count().collect()
    assert {r.k for r in by} == set(range(300)) | {904} and [tuple(r) for r in got.where("k = 904").collect()] == [(904, 0, 2)] * 2
    assert sentences.split_sentences(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


def test_maxent():
    rows = [["a", "x"], ["b", "x"]] * 20
    model = MaxEnt.fit(rows, [1.0, 0.0] * 20)
    assert model.probability(["a"]) > 0.8 > 0.2 > model.probability(["b"])
    assert MaxEnt.fit([], []).probability(["a"]) == 0.5


def test_damage_is_judged_as_in_problem_1(spark):
    from symstream.llm import garbled

    texts = ["Ã© കഥ വന്നു.", "à´•à´¥ à´’à´¨àµ\x8dà´¨àµ\x8d.", *["പുഴ വന്നു. Ã മഴ © പോയി."] * 30, "", None]  # Ã and © are known signs here, é is not
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    damaged = {r.k for r in garbled.restore(rows, "k", ["t"]).collect()}
    split = {r.k for r in sentences.split_sentences(rows, "k", "t").collect()}
    assert damaged == {1} and split == set(range(32)) - damaged
