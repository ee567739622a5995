"""Counts, searches and codes of whole batches equal those of one text or symbol after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from symstream.operators import counts, models, search
from symstream.plans import catalog


def test_runs_of_texts():
    chance = random.Random(5)
    many = ["".join(map(chr, range(0x10000, 0x10000 + 40000))), "".join(map(chr, range(0x1000, 0xD000))) + "".join(map(chr, range(0x30000, 0x30000 + 40000)))]
    for order in range(4):
        for texts in (["".join(chance.choices("ab ക😀\0", k=chance.randrange(12))) for _ in range(30)] + [""], [""], [], many[:1]):
            found, n = counts.runs_of(texts, order)
            assert len(set(found)) == len(found) and dict(zip(found, n.tolist(), strict=True)) == collections.Counter(t[max(0, i - order) : i + 1] for t in texts for i in range(len(t)))
    got = collections.Counter()
    for gram, n in zip(*counts.runs_of(many, 2), strict=True):  # more signs than 16 bits tell apart
        got[gram] += int(n)
    assert got == collections.Counter(t[max(0, i - 2) : i + 1] for t in many for i in range(len(t)))


def test_orders_curve_counts_texts_once(spark, small, monkeypatch):
    """One table of counted runs serves all orders; no text is cut into a row for each symbol and order."""

    def refused(*_args, **_named):
        raise AssertionError("texts are cut into rows")

    passes, count = [], counts.text_gram_counts
    monkeypatch.setattr(counts, "grams", refused)
    monkeypatch.setattr(models, "grams", refused)
    monkeypatch.setattr(counts, "text_gram_counts", lambda *a: passes.append(a) or count(*a))
    assert catalog.queries()["orders_curve"](spark, small).count() == 8 and len(passes) == 1


def test_own_codelengths(spark):
    chance = random.Random(2)
    texts = [(m, "".join(chance.choices("abcd "[: 2 + (m == "x") * 3], k=chance.randrange(14)))) for m in "xy" for _ in range(20)] + [("z", "q"), ("x", None)]
    rows = spark.createDataFrame(texts, "model string, t string")
    counted = counts.text_gram_counts(rows, "model", "t", 3)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, counts.gram_counts(rows.where("t IS NOT NULL"), ["model"], "t", 3).collect()))
    got = {(r.model, r.max_order): (r.bits, r.symbols) for r in models.own_codelengths(models.tables(counts.context_counts(counted, ["model"], 3), 3)).collect()}
    assert len(got) == 12
    for order in range(4):
        one = models.gram_codelengths(counts.grams(rows.where("t IS NOT NULL"), ["model"], "t", order).withColumnRenamed("model", "own"), ["own"], models.train(rows, "model", "t", order)).where(F.col("own") == F.col("model"))
        for r in one.collect():
            assert got[r.own, order] == (pytest.approx(r.bits, abs=1e-9), r.symbols)


def counters(texts, order=3):
    seen = {}
    for t in texts:
        for i, c in enumerate(t):
            for k in range(min(i, order) + 1):
                of = seen.setdefault(t[i - k : i], {})
                of[c] = of.get(c, 0) + 1
    return [(ctx, c, 2 * n - 1) for ctx, of in seen.items() for c, n in of.items()]


def two_models(order=3):
    chance = random.Random(11)
    words = ["".join(chance.choices("abdegikmnotu", k=chance.randint(1, 6))) for _ in range(30)] + ["x", "1", "ക", "é-"]
    rows = counters([" ".join(chance.choices(words, k=chance.randint(1, 9))) for _ in range(60)], order)
    return search.Static(rows, order), search.Dense(rows, order), words


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_dense_costs(order):
    static, dense, words = two_models(order)
    chance = random.Random(order)
    signs = sorted(set("".join(words))) + [" ", "q", "😀"]
    for _ in range(400):
        past, c = "".join(chance.choices(signs, k=chance.randrange(5))), chance.choice(signs)
        assert dense.bits(past, c) == static.bits(past, c) and dense.context(past) == static.context(past)
    empty = search.Dense([], order)
    assert empty.bits("a", "b") == search.Static([], order).bits("a", "b")
    with pytest.raises(ValueError):
        search.Dense([("", "a", 3), ("a", "b", 3)], 1)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_segmentation_of_batches(order):
    static, dense, words = two_models(order)
    chance = random.Random(3)
    texts = ["", "a", "-", "q?q", "aaaa", "é-é-"] + ["".join(chance.choices(words, k=chance.randrange(12))) for _ in range(60)]
    assert search.segment_texts(texts, dense) == [search.segment(t, static) for t in texts]
    assert search.segment_texts([], dense) == []


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_keypad_of_batches(order):
    """As found for one text after the other, of equally cheap letters those that sort first."""
    static, dense, _ = two_models(order)
    chance = random.Random(4)
    texts = ["", "2", "   ", "   99.9,", "2a3"] + ["   " + "".join(chance.choices("23456789 .", k=chance.randrange(20))) for _ in range(40)]
    pad = search.Keypad(dense)
    for t, (out, bits) in zip(texts, pad(texts), strict=True):
        want, least = search.keypad(t, static)
        assert len(out) == len(t) and bits == pytest.approx(least, abs=1e-9)
        if order:  # without contexts all texts of the same letters are equally cheap but for rounding
            assert out == want
    equal = [("", c, 3) for c in "abcdefghijklmnopqrstuvwxyz ., "]
    texts = ["   2345", "79", "8" * 30]
    assert search.Keypad(search.Dense(equal, 0))(texts) == [search.keypad(t, search.Static(equal, 0)) for t in texts]
