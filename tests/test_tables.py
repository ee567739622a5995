import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symstream.functions import text as T
from symstream.operators import align, counts, evaluate, models, words


def test_running_ranks(spark):
    """Ranks and hits by ranges equal those of a sorted list, with ties, repeated rows, nulls and a value that holds most rows."""
    chance = random.Random(2)
    rows = [(chance.choice("aaaaaab") if i % 50 else None, chance.randrange(40) / 4, i, chance.random() < 0.3) for i in range(600)]
    frame = spark.createDataFrame(rows, "c string, value double, row int, hit boolean").repartition(7)
    got = {r["row"]: (r["rank"], r["hits"]) for r in evaluate.running(frame, "c", ["value", "row"], F.col("hit")).collect()}
    want = {}
    for c in ("a", "b", None):
        hits = 0
        for rank, (_, _, i, hit) in enumerate(sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2])), 1):
            hits += hit
            want[i] = rank, hits
    assert got == want
    assert evaluate.running(frame.limit(0), "c", ["value", "row"], F.col("hit")).count() == 0


def average_precision(relevant, ignore):
    places = [i for i, r in enumerate(relevant) if r]
    if not places:
        return 0.0
    last = places[max(len(places) - ignore, 1) - 1]
    return float(np.mean([sum(relevant[: i + 1]) / (i + 1) for i in range(last + 1)]))


@pytest.mark.parametrize("ignore", [0, 2, 50])
def test_average_precision(spark, ignore):
    chance = random.Random(3)
    labels = {f"r{i:02}": chance.choice(["x", "y", "z", None]) for i in range(40)}
    rows = [(r, c, chance.randrange(6) / 2, labels[r]) for r in labels for c in "xyw"]
    frame = spark.createDataFrame(rows, "row string, column string, value double, label string")
    by = {c: [x[3] == c for x in sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[0]))] for c in "xyw"}
    got = {r.column: r.average_precision for r in evaluate.mean_average_precision(frame, ignore).collect()}
    assert got == pytest.approx({c: average_precision(x, ignore) for c, x in by.items()})
    by = {k: [x[3] == x[1] for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1]))] for k in labels}
    got = {r["row"]: r.average_precision for r in evaluate.mean_average_precision_by_rows(frame, ignore).collect()}
    assert got == pytest.approx({k: average_precision(x, ignore) for k, x in by.items()})
    ends = {r["row"]: (r.least, r.greatest) for r in evaluate.extremes(frame).collect()}
    assert len(ends) == 41 and ends[None] == (min(x[2] for x in rows), max(x[2] for x in rows))


def test_relevance_sweep(spark):
    chance = random.Random(5)
    tracks = [(d, round(chance.uniform(-2, 2) + (0.4 if d % 3 == 0 else 0), 3)) for d in range(30) for _ in range(chance.randrange(1, 12))]
    relevant = {d: d % 3 == 0 for d in range(30) if d != 7}
    symbols, texts = (-1.0, 0.5, 5), (-0.4, 0.2, 6)
    swept = evaluate.relevance_sweep(spark.createDataFrame(tracks, "doc int, gain double"), "doc", "gain", spark.createDataFrame(list(relevant.items()), "k int, r boolean"), symbols, texts)
    got = {(r.norm, r.symbol_step, r.text_step): (r.retrieved, r.hits, r.recall, r.precision) for r in swept.collect()}
    assert len(got) == 3 * 6 * 6
    for (norm, i, j), found in got.items():
        low, least = -9.0 if i == 0 else -1.0 + 0.5 * (i - 1), -0.4 + 0.2 * (j - 1)
        retrieved = []
        for d in relevant:
            gains = [g for k, g in tracks if k == d]
            kept = [g for g in gains if g >= low - 1e-9]
            over = {"sum": 100, "mean": len(gains), "mean_kept": len(kept)}[norm]
            if over and round(sum(kept) / over, 6) >= least - 1e-9:
                retrieved.append(d)
        hits = sum(relevant[d] for d in retrieved)
        assert found == pytest.approx((len(retrieved), hits, hits / sum(relevant.values()), hits / len(retrieved) if retrieved else 0.0))
    best = {r.norm: r for r in evaluate.best_thresholds(swept).collect()}
    for norm in ("sum", "mean", "mean_kept"):
        assert best[norm].break_even == pytest.approx(max((x[2] + x[3]) / 2 for k, x in got.items() if k[0] == norm), abs=1e-6)


def test_seeded_split(spark):
    rows = spark.createDataFrame([(i, "a" if i % 4 else "b", "t") for i in range(203)] + [(900, None, "t")], "k int, c string, split_text string")
    split = counts.seeded_split(rows, "c", "k")
    got = {r.k: (r.c, r.split) for r in split.collect()}
    n = {c: sum(x[0] == c for x in got.values()) for c in ("a", "b", None)}
    assert len(got) == 204 and all(sum(x == (c, "test") for x in got.values()) == int(0.2 * n[c]) for c in n)
    assert got == {r.k: (r.c, r.split) for r in counts.seeded_split(rows.repartition(5), "c", "k").collect()}
    assert got != {r.k: (r.c, r.split) for r in counts.seeded_split(rows, "c", "k", seed=8).collect()}
    assert counts.seeded_split(rows.limit(0), "c", "k").count() == 0


def test_shared_runs(spark):
    rows = [("s", True, "abcab"), ("s", True, None), ("s", True, ""), ("s", False, "cabx"), ("s", False, "abcab"), ("u", True, "q")]
    frame = spark.createDataFrame(rows, "c string, side boolean, t string")
    got = {(r.c, r.size): r for r in counts.shared_runs(frame, "c", "side", "t", 4).collect()}
    for n in range(1, 5):
        mine = [t[i : i + n] for _, side, t in rows[:5] if side and t for i in range(len(t) - n + 1)]
        others = {t[i : i + n] for _, side, t in rows[:5] if not side and t for i in range(len(t) - n + 1)}
        r = got["s", n]
        assert (r.types, r.shared_types, r.tokens, r.shared_tokens) == (len(set(mine)), len(set(mine) & others), len(mine), sum(x in others for x in mine))
        assert r.r == sum(got["s", k].shared_tokens for k in range(n, 5)) and r.r1 == sum(got["s", k].shared_tokens for k in range(1, n + 1))
    assert got["u", 1].shared_tokens == 0


def test_scores_with_and_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "abab"), (2, "b", "bcbc"), (3, None, "cab"), (4, "a", None), (5, "b", "")], "k int, m string, t string")
    model = models.train(rows, "m", "t", 1)
    want = sorted(map(tuple, models.codelengths(rows, "k", "t", model).collect()))
    tracked = sorted(map(tuple, models.track(rows, "k", "t", model).collect()))
    monkeypatch.setattr(models, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(models, "LISTED", 1)
    got = sorted(map(tuple, models.codelengths(rows, "k", "t", model).collect()))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert sorted(map(tuple, models.track(rows, "k", "t", model).collect())) == tracked
    by = {(r.k, r.model): r for r in models.divergences(rows, "k", "m", "t", model).collect()}
    bits = {(k, m, pos): b for k, m, pos, _, b in tracked}
    assert set(by) == {(1, "b"), (2, "a")} and by[1, "b"].signed == pytest.approx(np.mean([bits[1, "b", i] - bits[1, "a", i] for i in range(4)]))
    empty = models.train(rows.limit(0), "m", "t", 1)
    assert models.codelengths(rows, "k", "t", empty).count() == 0


def test_titles(spark, tmp_path):
    rows = spark.createDataFrame([("a", "abab")], "m string, t string")
    path = str(tmp_path / "model")
    models.train(rows, "m", "t", 1).write(path, "first", "dynamic")
    models.retitled(spark, path, title="second", kind="static")
    r = spark.read.parquet(f"{path}/registry").first()
    assert (r.title, r.kind, r.max_order) == ("second", "static", 1) and models.Model.read(spark, path).names() == [("a", 2)]
    with pytest.raises(ValueError):
        models.retitled(spark, path, kind="other")


def test_word_models(spark):
    rows = spark.createDataFrame([(1, "a", "കഥ നല്ല കഥ. നല്ല കഥ"), (2, "b", "the cat, the dog"), (3, "a", None), (4, None, "x"), (5, "b", " . ")], "k int, m string, t string")
    scored = {(r.k, r.model): r for r in words.word_codelengths(rows, "k", "t", words.train_words(rows, "m", "t")).collect()}
    assert set(scored) == {(k, m) for k in (1, 2, 4) for m in "ab"}
    assert scored[1, "a"].bits < scored[1, "b"].bits and scored[2, "b"].bits < scored[2, "a"].bits and scored[2, "b"].tokens == 8
    # a word in its context costs less than the same words in an order that was never seen
    other = spark.createDataFrame([(1, "the cat the dog"), (2, "dog the the cat")], "k int, t string")
    bits = {r.k: r.bits for r in words.word_bits(other, "k", "t", rows.where("m = 'b'"), "t").collect()}
    assert bits[1] < bits[2]


def test_text_edits(spark):
    frame = spark.createDataFrame([("abca", "b"), ("", "x"), (None, "y")], "a string, b string")
    got = frame.select(T.last_place("a", "a").alias("p"), T.overwrite(F.col("a"), 6, F.lit("zz"), "_").alias("o"), T.overwrite(F.col("a"), 1, F.col("b"), "_").alias("w"), T.replace_alike(F.col("a"), "bc").alias("n"), T.compared(F.lit(T.SENTINEL), F.col("a")).alias("c"), T.compared(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(3, "abca__zz", "abca"[:1] + "b" + "ca", "a\x00\x00a", -1, -1), (None, "______zz", "_x", "", 1, -1), (None, None, None, None, None, None)]
    with pytest.raises(ValueError):
        T.replace_alike(F.col("a"), "ab", "x")
    tagged = spark.createDataFrame([("dogñrunsṛ x",), (None,)], "t string").select(T.words_and_tags("t").alias("p")).collect()
    assert [(x["word"], x["tag"]) for x in tagged[0].p] == [("dog", "ñ"), ("runs", "ṛ")] and tagged[1].p is None


def test_spacing_of_long_texts(spark):
    """The reference's rule is there as an argument; without it nothing is cut."""
    text = "ab cd. " * 400
    of = lambda longest: {x["spacing"]: x["variant"] for x in spark.createDataFrame([(text,)], "t string").select(T.spacing_variants("t", longest).alias("v")).first().v}
    assert of(None)["original"] == text and len(of(None)["no_spaces"]) == 5 * 400
    assert of(2000)["original"] == text[: text[:2000].rfind(".") + 1]


def test_cheapest_alignment():
    """The aligner finds what a search over all alignments finds."""
    chance = random.Random(9)

    def best(a, b):
        known = {(0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [known[i - m, j - n] + penalty + int(align.match_costs(np.array([sum(a[i - m : i])]), np.array([sum(b[j - n : j])]))[0]) for (m, n), penalty in align.PENALTY.items() if i >= m and j >= n]
                if ways:
                    known[i, j] = min(ways)
        return known[len(a), len(b)]

    for _ in range(60):
        a, b = ([chance.randrange(0, 90) for _ in range(chance.randrange(0, 7))] for _ in "ab")
        moves = align.align_lengths(a, b)
        assert sum(m[4] for m in moves) == best(a, b)
        assert sum(m[1] for m in moves) == len(a) and sum(m[3] for m in moves) == len(b)
