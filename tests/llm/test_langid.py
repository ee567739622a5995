import random

import pytest

from symstream.llm import langid

VOCABULARY = {
    "ml-latn": "malayāḷaṁ bhāṣa kēraḷattil saṁsārikkunna pustakaṁ kuṭṭikaḷ pōyi puḻa vannu vīṭŭ nagarattil eḻuti oru avan paḻaya kalavastha pustakattil".split(),
    "ta-latn": "antha sol munbu maatham merku varalaaru kizhakku aaru ezhuthinaar naal makkal puththagam migavum ariviyal kudumbam isai".split(),
    "en": "the weather of several modern rivers changed again and their writers followed a method science library record road".split(),
    "hi-latn": "bahut dakshin bhasha samaaj poorv shikshak mausam baarish bazaar parivaar lekin aaya kitaab sadak mahina hai".split(),
    "zh-latn": "keyi daomi tamen jiating kaishi jieri houlai zhege gulao yinyue chengshi senlin fujin shige nongmin xiandai".split(),
}
ALLOWED = {"t": ("ml-latn", *(x for x in langid.LANGS if x != "ml-latn"))}


def text(lang, chance, n=9):
    return " ".join(chance.choices(VOCABULARY[lang], k=n)) + "."


@pytest.fixture(scope="module")
def model():
    chance = random.Random(1)
    many = {"ml-latn": 400, "en": 60, "hi-latn": 40, "ta-latn": 40, "zh-latn": 40}
    rows = [(text(x, chance), x if chance.random() > 0.06 else chance.choice(list(VOCABULARY))) for x, n in many.items() for _ in range(n)]
    counts = {x: sum(g == x for _, g in rows) for x in VOCABULARY}
    return langid.train(rows, counts)


def test_held_out(model):
    chance, by = random.Random(2), langid.Identifier(model, langid.LATIN)
    for lang in VOCABULARY:
        assert sum(by.label(text(lang, chance))[0] == lang for _ in range(50)) >= 48
    mixed = sum(by.label(f"{text(a, chance)} {text(b, chance)}")[0] == "+".join(sorted((a, b))) for a in VOCABULARY for b in VOCABULARY if a != b for _ in range(5))
    assert mixed >= 95


def test_native_scripts_and_shares(model):
    by = langid.Identifier(model, ("ml", "en"))
    assert by.label("മലയാളം ഭാഷ Unicode ആണ് എന്ന് അവൻ പറഞ്ഞു മഴ")[0] == "ml"
    assert by.label("one two മലയാളം ഭാഷ ആണ് എന്ന് അവൻ")[0] == "en+ml"
    every = langid.Identifier(model, langid.LANGS)
    assert every.label("அவர் वह 他们他们")[0] == "hi+ta+zh"
    assert by.label("12 % (5)")[0] == langid.NO_WORDS
    assert by.label("�� 5")[:2] == ("ml", 0.5)
    spans = by.stretches("one two three. മലയാളം ഭാഷ.")
    assert [(a, b, x) for a, b, x, _, _ in spans] == [(0, 14, "en"), (15, 25, "ml")]
    assert len(by.stretches("കഥ " * 50_000)) == 1


def test_machines_of_native_scripts():
    """Hindi and another language of its script are told apart by what was learned, not by the script."""
    chance = random.Random(6)
    words = {"ml": "മഴ പുഴ നാട് വീട് കഥ".split(), "ta": "மழை நாடு வீடு கதை".split(), "hi": "वह घर कथा नदी".split(), "zh": "他们 家庭 开始 节日".split(), "en": VOCABULARY["en"]}
    rows = [(" ".join(chance.choices(words[x], k=8)), x) for x in words for _ in range(60)]
    by = langid.Identifier(langid.train(rows, dict.fromkeys(words, 60)), ("ml", "en", "hi", "ta", "zh"))
    for x in words:
        label, confidence, _ = by.label(" ".join(chance.choices(words[x], k=8)))
        assert label == x and 0.5 < confidence <= 1
    short, long = (by.label(" ".join([words["hi"][0]] * n))[1] for n in (1, 12))
    assert short < long


def test_operator(spark):
    chance = random.Random(3)
    langs = ["ml-latn"] * 6 + ["en", "hi-latn", "ta-latn", "zh-latn"]
    rows = []
    for i in range(600):
        lang = langs[i % 10]
        rows.append((i, text(lang, chance), None if i % 20 == 0 else "zh-latn" if i % 20 == 5 else lang, lang))
    rows += [(900, None, None, ""), (901, "", None, ""), (902, "  ", None, ""), (903, "55", "en", ""), (904, "മഴ വന്നു", "ml", "")]
    frame = spark.createDataFrame(rows, "k int, t string, g string, lang string")
    found = langid.identify(frame, "k", {"t": "g"}, ALLOWED)
    got = {r.k: (r.lang, r.confidence) for r in found.collect()}
    assert set(got) == set(range(600)) | {903, 904} and got[903][0] == "zxx" and got[904][0] == "ml"
    assert sum(got[k][0] == true for k, _, _, true in rows[:600]) >= 590 and all(0 <= c <= 1 for _, c in got.values())
    bad = {(r.k, r.lang) for r in langid.wrong_labels(found).collect()}
    assert (903, "zxx") in bad and (904, "ml") not in bad and len({k for k, _ in bad if k % 20 in (0, 5) and k < 600}) >= 55
    spans = langid.identify(frame, "k", {"t": "g"}, ALLOWED, stretches=True)
    assert spans.where("k = 904").count() == 1 and spans.where("k = 903").count() == 0
    assert langid.identify(frame.limit(0), "k", {"t": "g"}, ALLOWED).count() == 0


def test_sound_texts_are_not_repaired(spark):
    chance, sound = random.Random(4), "മഴ Ã© വന്നു"  # to undo it looks damaged, but Ã and © are known signs here and é is not
    rows = [(i, text(x, chance), x) for i, x in enumerate(list(VOCABULARY) * 20)] + [(i, "മഴ Ã പുഴ © വന്നു", "ml") for i in range(200, 240)] + [(900, sound, "ml")]
    spans = langid.identify(spark.createDataFrame(rows, "k int, t string, g string"), "k", {"t": "g"}, ALLOWED, stretches=True)
    assert max(r.end_pos for r in spans.where("k = 900").collect()) == len(sound)
