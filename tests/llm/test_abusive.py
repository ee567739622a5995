import itertools
import random

import numpy as np

from symstream.llm import abusive

FILLER = "the old river market science table weather music letter small method harvest road".split()
BAD = ["you are a worthless {}", "shut up you {}", "they are {} and must be driven out", "send me your {} pictures now"]
SLURS = ["idiot", "scum", "vermin", "moron", "thief"]
GOOD = ["the word “{}” means nothing here", "a drawing of the {} hung there", "collect {} on mondays", "{} of the rice plant were counted"]


def doc(chance, bad):
    parts = [" ".join(chance.choices(FILLER, k=8)) + "." for _ in range(3)]
    if bad or chance.random() < 0.5:
        slur = chance.choice(SLURS)
        if bad and chance.random() < 0.3:
            slur = slur.replace("i", "1").replace("o", "0").replace("e", "3")
        parts.insert(chance.randrange(4), chance.choice(BAD if bad else GOOD).format(slur) + ".")
    return " ".join(parts)


def test_one_spelling():
    assert abusive.skeleton("കഴുത") == abusive.skeleton("kazhutha") == abusive.skeleton("kaḻuta") == abusive.skeleton("ka-ḻuta,")
    assert abusive.skeleton("1d10t") == abusive.skeleton("idiot") == abusive.skeleton("і​diot!") == abusive.skeleton("IDIOT")
    assert abusive.skeleton("മണ്ടൻ") == abusive.skeleton("mandan") and abusive.skeleton("...") == "" and abusive.skeleton("2020") == "2020"


def test_marginals_equal_enumeration():
    chance = np.random.default_rng(1)
    lengths = np.array([1, 4, 3, 6, 1])
    unary, change = chance.normal(size=lengths.sum()), chance.normal(size=(2, 2))
    p, pairs = abusive.marginals(unary, lengths, change, pairs=True)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i] * s for i, s in enumerate(states)) + sum(change[a, b] for a, b in itertools.pairwise(states)))
            total += w
            one += w * np.array(states)
            for a, b in itertools.pairwise(states):
                two[a, b] += w
        assert np.allclose(p[at : at + n], one / total)
        want_pairs += two / total
        at += n
    assert np.allclose(pairs, want_pairs)
    assert len(abusive.marginals(np.zeros(0), np.zeros(0, np.int64), change)[0]) == 0


def test_operator(spark):
    chance = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        rows.append((i, doc(chance, bad), 0.0))
        if i < 500:
            labels.append((i, int(bad) if chance.random() > 0.03 else 1 - int(bad)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, " ", 0.0), (903, "river " * 60_000 + "you are a worthless scum.", 0.0), (904, "river", 0.0)]
    labels += [(904, 0), (904, 1), (999, 1), (500, None)]
    docs = spark.createDataFrame(rows, "k int, t string, score double")
    verdicts, terms = spark.createDataFrame(labels, "k int, abusive int"), spark.createDataFrame([("idiot",), ("scum",), (None,)], "term string")
    got = {r.k: r for r in abusive.score_documents(docs, "k", "t", verdicts, "k", "abusive", terms, "term").collect()}
    assert len(got) == len(rows) and got[900].score == got[901].score == got[902].score == 0.0 and got[903].score > 0.5
    right = sum((got[i].score >= abusive.LEAST) == (i % 4 == 0) for i in range(500, 700))
    assert right >= 190
    spans = [s for i in range(500, 700) for s in got[i].spans]
    assert spans and all(0 <= s.start_pos < s.end_pos for s in spans)
    last = got[903].spans[-1]
    assert rows[-2][1][last.start_pos : last.end_pos].endswith("scum.")
    assert abusive.score_documents(docs.limit(0), "k", "t", verdicts, "k", "abusive", terms, "term").count() == 0
    assert abusive.score_documents(docs, "k", "t", verdicts.limit(0), "k", "abusive", terms, "term").where("score >= 0.5").count() == 0


def test_hard_examples_are_drawn_by_a_hash(spark):
    from symstream.llm import sampling

    rows = spark.range(0, 4000, 1, 8).withColumnRenamed("id", "k")
    drawn = [sorted(r.k for r in sampling.least(x, "k", 400).collect()) for x in (rows, rows.repartition(3), rows.orderBy("k", ascending=False))]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 400 and all(60 < sum(a <= k < a + 1000 for k in drawn[0]) < 140 for a in range(0, 4000, 1000))


def test_disguises_within_letters_and_drawn_out_consonants():
    assert abusive.skeleton("മണ.്ടൻ") == abusive.skeleton("മണ-്ടൻ") == abusive.skeleton("മ*ണ്ടൻ") == abusive.skeleton("മണ്ടൻ")
    assert abusive.skeleton("thhhendi") == abusive.skeleton("thendi") and abusive.skeleton("1953-ൽ") != abusive.skeleton("1953")


def test_weights_stand_for_copies():
    chance = random.Random(8)
    texts = [doc(chance, i % 3 == 0) for i in range(60)]
    index = {w: i + 1 for i, w in enumerate(sorted({abusive.skeleton(w) for t in texts for w in t.split()}))}
    once, thrice = (abusive.Tokens(t, abusive.Lexicon(index, frozenset())) for t in (texts, texts * 3))
    truth = (once.sk % 5 == 0).astype(float)
    a = abusive._gradient_fit(once, truth, np.full(len(truth), 3.0), len(index) + 1, 20)
    b = abusive._gradient_fit(thrice, np.tile(truth, 3), np.ones(3 * len(truth)), len(index) + 1, 20)
    assert all(np.allclose(getattr(a, x), getattr(b, x)) for x in ("words", "begins", "flags", "change", "bias"))


def test_many_mistaken_documents_hide_no_true_ones(spark):
    """A small sample of a large table: its hard examples are drawn up to their bound, but don't outweigh the abusive ones."""
    chance = random.Random(6)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        rows.append((i, doc(chance, bad)))
        if i < 5000:
            labels.append((i, int(bad) if chance.random() > 0.03 else 1 - int(bad)))
    docs, verdicts = spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame(labels, "k int, abusive int")
    terms = spark.createDataFrame([("idiot",)], "term string")
    found = {r.k for r in abusive.score_documents(docs, "k", "t", verdicts, "k", "abusive", terms, "term", (60, 60, 400)).where("score >= 0.5").collect()}
    right = sum(k % 10 == 0 for k in found)
    assert right >= 570 and len(found) <= 630
