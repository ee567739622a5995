import random

import numpy as np
import pyarrow as pa
import pytest

from symstream.llm import overlap


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_segments_cover_and_lengths_suffice():
    for n in range(1, 200):
        parts = overlap.segments(n)
        assert len(parts) == overlap.most_edits(n) + 1 and parts[0][0] == 0 and sum(s for _, s in parts) == n
        for m in range(1, 200):
            if abs(m - n) <= overlap.allowed(max(m, n)):
                assert {s for _, s in parts} <= set(overlap.lengths_needed(m))


@pytest.mark.parametrize("bound", [0, 1, 3, 7])
def test_banded_distance(bound):
    chance = random.Random(bound)
    a = [np.array(chance.choices(range(4), k=chance.randint(0, 12)), np.uint32) for _ in range(80)]
    b = [np.array(chance.choices(range(4), k=chance.randint(0, 12)), np.uint32) for _ in range(80)]
    got = overlap.banded_distance(a, b, bound)
    assert got.tolist() == [min(bound + 1, levenshtein(list(x), list(y))) for x, y in zip(a, b, strict=True)]


def near(a, b):
    x, y = overlap.normal_words(pa.array([a, b]))
    return bool(x and y) and levenshtein(x, y) / max(len(x), len(y)) <= 0.2 + 1e-12


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, e, "x") for k, t, g, e in rows], "k int, t string, g string, e boolean, cls string")


@pytest.mark.parametrize("hot", [overlap.HOT, 0, 40])
def test_against_brute_force(spark, hot):
    """Whether no, every or some segment is hot."""
    chance = random.Random(9)
    words = [f"v{i}" for i in range(30)]
    base = [chance.choices(words, k=chance.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 14, 20, 25, 31, 60])) for _ in range(70)]
    rows = []
    for i in range(500):
        w = list(chance.choice(base))
        for _ in range(chance.choice([0, 0, 1, 1, 2, 4, 8])):
            at = chance.randrange(len(w) + 1)
            w[at : at + chance.randint(0, 1)] = chance.choices(words, k=chance.randint(0, 1))
        rows.append((i, " ".join(w).title() if chance.random() < 0.3 else ", ".join(w), chance.choice("gh"), chance.random() < 0.3))
    rows += [(900, None, "g", True), (901, "", "g", False), (902, " .. ", "g", True), (903, "a b", None, True), (904, "a b", "g", None), (905, "one", "g", True), (906, "One!", "g", False), (907, "one", "h", False)]
    got = {(r.k_e, r.k_t) for r in overlap.overlapping_records(frame(spark, rows), "k", "t", "g", "e", hot=hot).collect()}
    want = {(a[0], b[0]) for a in rows if a[3] for b in rows if b[3] is False and a[2] == b[2] and a[2] and a[1] and b[1] and near(a[1], b[1])}
    assert got == want and len(want) > 100


def test_long_texts_copies_and_empty_tables(spark):
    text = [f"w{i % 97}x{i % 89}" for i in range(4000)]
    other = text[:1000] + ["new"] * 300 + text[1100:]
    rows = [(1, " ".join(text), "g", True), (2, " ".join(other), "g", False)] + [(i, "same old text here", "g", i % 2 == 0) for i in range(10, 60)]
    got = {(r.k_e, r.k_t) for r in overlap.overlapping_records(frame(spark, rows), "k", "t", "g", "e").collect()}
    assert (1, 2) in got and len(got) == 1 + 25 * 25
    pairs, members = overlap.overlaps(frame(spark, rows), "k", "t", "g", "e")
    assert pairs.count() == 2 and members.count() == 52
    assert overlap.overlapping_records(frame(spark, rows).limit(0), "k", "t", "g", "e").count() == 0


def test_common_phrase(spark):
    """A phrase that all texts share, among words that few do: the same pairs, of far fewer candidates."""
    chance = random.Random(4)
    phrase = "it is known that".split()
    rows = []
    for i in range(400):
        w = [f"r{chance.randrange(4000)}" for _ in range(12)]
        rows.append((i, " ".join([*w[:6], *phrase, *w[6:]]), "g", i % 2 == 0))
        if i % 20 == 0:
            rows.append((1000 + i, " ".join([*w[:6], *phrase, *w[7:]]), "g", i % 40 != 0))
    got = {(r.k_e, r.k_t) for r in overlap.overlapping_records(frame(spark, rows), "k", "t", "g", "e", hot=100).collect()}
    want = {(a[0], b[0]) for a in rows if a[3] for b in rows if not b[3] and near(a[1], b[1])}
    assert got == want and len(want) >= 10


def test_rare_words_hold_for_all_near_texts(spark):
    chance = random.Random(12)
    words = [f"v{i}" for i in range(12)]
    texts = [chance.choices(words, k=chance.randint(1, 24)) for _ in range(150)]
    texts += [[w for w in t if chance.random() > 0.12] or t for t in texts]
    rows = frame(spark, [(i, " ".join(t), "g", True) for i, t in enumerate(texts)])
    table = overlap.word_table(rows, "k", "t", "g", "e")
    held = {}
    for r in overlap.rare_words(table).join(table.select("k", "cls"), "cls").collect():
        held.setdefault(r.k, set()).add(r.word)
    found = 0
    for i, x in enumerate(texts):
        for j in range(i):
            if levenshtein(x, texts[j]) <= 0.2 * max(len(x), len(texts[j])):
                assert held[i] & held[j]
                found += 1
    assert found > 50
