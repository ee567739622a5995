import math
import random
import re

import pytest

from symstream.llm import frequencies, garbled, mojibake

WORDS = "മലയാളം ഭാഷ കേരളത്തിൽ സംസാരിക്കുന്ന ഒരു ദ്രാവിഡ ഭാഷയാണ് പുസ്തകം വായിച്ചു കുട്ടികൾ സ്കൂളിൽ പോയി പുഴ മഴ വന്നു നാട് വീട്".split()
LATIN = "malayāḷaṁ bhāṣa kēraḷattil saṁsārikkunna oru drāviḍa pustakaṁ vāyiccu kuṭṭikaḷ pōyi puḻa vannu".split()
SOUND = ["«Área» ഭാഷ", "São Âme naïve Ménage", "Ångström 5° ±3 €20 №7", "可以稻米他们家庭开始节日", "ｆｕｌｌ １２", "Рrоf. аnсіеnt роеm іѕ", "अच्छा दिन है", "எனக்கு பிடிக்கும்", "I’m “here”…", "a b­c", "ñaṅṅaḷ r̥k"]


def lines(words, n, seed=2):
    chance = random.Random(seed)
    return [" ".join(chance.choices(words, k=chance.randint(4, 9))) + "." for _ in range(n)]


KNOWN = frequencies.Frequencies.of(lines(WORDS, 300) + lines(LATIN, 300) + ["English words first."] * 20)


def wrong(text, codec):
    return "".join(bytes([b]).decode(codec) if codec == "latin-1" or bytes([b]).decode(codec, "ignore") else chr(b) for b in text.encode())


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "koi8_r", "iso8859_2", "cp850"])
@pytest.mark.parametrize("words", [WORDS, LATIN])
def test_readings_are_undone(codec, words):
    for text in lines(words, 15):
        assert mojibake.undo(wrong(text, codec), KNOWN)[:2] == (text, True)
        part = "English words first. " + wrong(text, codec)
        assert mojibake.undo(part, KNOWN)[:2] == ("English words first. " + text, True)


def test_twice_and_double_bytes():
    for text in lines(WORDS, 10):
        assert mojibake.undo(wrong(wrong(text, "cp1252"), "cp1252"), KNOWN)[0] == text
        fixed, damaged, _ = mojibake.undo(text.encode().decode("gb18030", "replace"), KNOWN)
        assert damaged and sum(c in text for c in fixed) > 0.7 * len(text)


def test_sound_text_stays():
    screen = re.compile(mojibake.suspicious())
    for text in [*SOUND, *lines(WORDS, 30), *lines(LATIN, 30), "", " "]:
        assert mojibake.undo(text, KNOWN)[:2] == (text, False), text
    assert not any(screen.search(t) for t in lines(WORDS, 30) + lines(LATIN, 30))


@pytest.mark.parametrize("words", [WORDS, LATIN])
def test_lost_bytes_by_frequency(words):
    """Words back of those that a lost byte hit, whether it left a mark or vanished, also in text that was read wrongly besides."""
    decoder = mojibake.Decoder(KNOWN)
    chance, right, all_ = random.Random(5), 0, 0
    for i, text in enumerate(lines(words, 60, 7)):
        data = bytearray(text.encode())
        for _ in range(2):
            at = chance.choice([k for k, x in enumerate(data) if x > 0x7F])
            data[at] = 0xFF
        if i % 3 == 2:
            seen = "".join(mojibake.LOST if x == 0xFF else chr(x) for x in data)
        else:
            seen = data.decode("utf-8", "replace" if i % 3 else "ignore")
        if mojibake.LOST not in seen:
            continue  # no sign of damage is left
        fixed, damaged, whole = mojibake.repair(seen, decoder)
        assert damaged and not whole
        for a, b in zip(text.split(), fixed.split(), strict=False):
            right += a == b
            all_ += 1
    assert all_ > 100 and right >= 0.9 * all_


def test_words_decide():
    """The same signs are damage where the corpus knows what they give, and sound where it knows them."""
    seen = "caf\u00c3\u00a9 noir"
    for corpus, damaged in (["café noir noir"], True), (["caf\u00c3\u00a9 noir \u00c3\u00a9t\u00c3\u00a9"], False):
        assert mojibake.undo(seen, frequencies.Frequencies.of(corpus * 50))[1] is damaged
    # of two stretches only the one whose words get likelier is changed
    known = frequencies.Frequencies.of([*lines(WORDS, 200), "x\u00c3\u00a9y"] * 3)
    text = lines(WORDS, 1, 3)[0]
    fixed, damaged, _ = mojibake.undo("x\u00c3\u00a9y " + wrong(text, "latin-1"), known)
    assert damaged and fixed == "x\u00c3\u00a9y " + text


def test_operator(spark):
    texts = lines(WORDS, 60)
    rows = [(i, t, None if i % 7 else wrong(t, "cp1252"), "x", "y") for i, t in enumerate(texts)] + [(90, None, "", "", ""), (91, " ", SOUND[1], "", ""), (91, " ", wrong(texts[0], "mac_roman"), "", ""), (92, "�" * 3, wrong("കഥ " * 4000, "cp1252"), "", "")]
    frame = spark.createDataFrame(rows, "k int, a string, b string, damaged string, field_name string")
    got = garbled.restore(frame, "k", ["a", "b"])
    by = {(r.k, r.field_name): r for r in got.collect()}
    assert set(by) == {(i, "b") for i in range(0, 60, 7)} | {(91, "b"), (92, "a"), (92, "b")}
    assert all(r.complete and r.restored == (texts[r.k] if r.k < 60 else texts[0] if r.k == 91 else "കഥ " * 4000) for k, r in by.items() if k != (92, "a"))
    assert garbled.restore(frame.limit(0), "k", ["a", "b"]).count() == 0


def test_counts_are_whole(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS * 20], "t string").repartition(6)
    found = frequencies.Frequencies(frequencies.load(frequencies.count_corpus(rows, ["t"])).value)
    assert all(found.count(w) == 20 for w in WORDS) and found.count("none") == 0
    assert found.total == sum(len(w) + 1 for w in WORDS) * 20 + 1 and found.n_words == len(WORDS) * 20 + 1
    empty = frequencies.Frequencies(frequencies.load(frequencies.count_corpus(rows.limit(0), ["t"])).value)
    assert empty.words == [] and mojibake.Decoder(empty).token(["a", -1]) == "a" + mojibake.LOST


def every_word(decoder, atoms, script):
    """Score of each word of the lattice, by brute force."""
    edges, letters = decoder.edges(tuple(atoms), (3, 2) if script == "latn" else (3,)), decoder.letters(script)
    ends = [[(0.0, "")], *([] for _ in atoms)]
    cost = lambda text, c: decoder.frequencies.letter(*("\x02\x02" + text)[-2:], c)
    for at, atom in enumerate(atoms):
        for score, text in ends[at]:
            if isinstance(atom, str):
                ends[at + 1].append((score + cost(text, atom), text + atom))
                continue
            ends[at + 1].append((score + mojibake.UNKNOWN, text + mojibake.LOST))
            for taken, pattern, price in edges[at]:
                ends[at + taken] += [(score + cost(text, letters.chars[i]) - price, text + letters.chars[i]) for i in letters.fit(pattern)]
    out = {}
    for s, t in ends[-1]:
        out[t] = max(out.get(t, -math.inf), frequencies.SPELLED + s + cost(t, "\x03"))
    # of the dictionary a word counts as often as it occurs, and costs what vanished
    for word, n in zip(decoder.frequencies.words, decoder.frequencies.counts, strict=True):
        ways = [0.0] + [-math.inf] * len(atoms)
        places = [{0: 0.0}] + [{} for _ in atoms]  # letters so far to the least price
        for at, atom in enumerate(atoms):
            for used, price in places[at].items():
                if used < len(word):
                    steps = [(1, 0.0)] if atom == word[used] else [] if isinstance(atom, str) else [(taken, p) for taken, pattern, p in edges[at] if mojibake._fits(pattern, mojibake.np.array([ord(word[used])]))[0]]
                    for taken, p in steps:
                        places[at + taken][used + 1] = min(price + p, places[at + taken].get(used + 1, math.inf))
        if len(word) in places[-1]:
            out[word] = max(out.get(word, -math.inf), math.log(n / decoder.frequencies.n_words) - places[-1][len(word)])
    return out


def test_search_is_whole():
    # a frequent word whose letters look poor, among many rare words whose letters look better
    corpus = ["കഴ"] * 3000 + [f"ക{c}{d}" for c in "അആഇഈഉഎഒംരലവസ" for d in "അആഇഈഉഎഒംരലവസ"] * 40
    for texts in (corpus, lines(WORDS, 200) + lines(LATIN, 200)):
        decoder = mojibake.Decoder(frequencies.Frequencies.of(texts))
        for atoms, script in (
            (["ക", -1], "ml"), (["ക", -1, -1], "ml"), ([-1, -1], "ml"), ([-1, -1, -1, "ഴ"], "ml"), ([0xE0, 0xB4, -1, "ഴ"], "ml"), (["മ", -1, "യ", -1], "ml"), ([-1, "ഴ", 0xE0, -1], "ml"),
            (["b", 0xE1, -1, -1], "latn"), (["p", "u", 0xE1, "a"], "latn"), (["പ", 0xB4, "ഴ"], "ml"), (["-", -1, "1"], "ml"),
        ):
            scored = every_word(decoder, atoms, script)
            found = decoder.token(atoms, script)
            assert scored[found] >= max(scored.values()) - 1e-3, (atoms, found, max(scored, key=scored.get))


def test_no_rank_or_margin_cuts():
    # the lost letter is by far the least likely one after ക, but the word is the only frequent one
    texts = ["കഴ"] * 500 + ["ക" + c + "തരമ" for c in "അആഇഈഉഎഒംരലവസ"] * 20_000
    decoder = mojibake.Decoder(frequencies.Frequencies.of(texts))
    assert decoder.token(["ക", -1]) == "കഴ"


def test_dictionary_is_bounded():
    known = frequencies.Frequencies.of([f"w{i}" for i in range(300_000)] + ["often"] * 5)
    assert known.words == ["often"]
    assert known.word("w17") > known.word("zqzqz")
