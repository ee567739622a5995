import math
import random

import pytest
from pyspark.sql import functions as F

from symstream.operators import adaptive as A
from symstream.operators import align, counts, evaluate, models, search, sets


def literal(texts, text, order, method, alphabet):
    """Codelength by an escape walk with an explicit exclusion set."""
    seen = {}
    for t in texts:
        for i, c in enumerate(t):
            for k in range(min(i, order) + 1):
                of = seen.setdefault(t[i - k : i], {})
                of[c] = of.get(c, 0) + 1
    weight = lambda n: n if method == "C" else 2 * n - 1
    bits = 0.0
    for i, c in enumerate(text):
        excluded = set()
        for k in range(min(i, order), -1, -1):
            of = seen.get(text[i - k : i], {})
            if not of or k and sum(of.values()) < 2:
                continue
            mass = sum(weight(n) for s, n in of.items() if s not in excluded)
            if c in of and c not in excluded:
                bits -= math.log2(weight(of[c]) / (mass + len(of)))
                break
            if mass:
                bits -= math.log2(len(of) / (mass + len(of)))
            excluded |= of.keys()
        else:
            bits += math.log2(alphabet - len(seen.get("", {})) + 1)
    return bits


@pytest.mark.parametrize(("order", "method"), [(0, "D"), (1, "C"), (2, "D"), (3, "D")])
def test_relational_scores_equal_an_escape_walk(spark, order, method):
    chance = random.Random(order)
    train = ["".join(chance.choices("abc ", k=chance.randint(0, 14))) for _ in range(12)] + ["", "abracadabra"]
    test = ["".join(chance.choices("abcz ", k=chance.randint(1, 14))) for _ in range(10)] + ["z"]
    rows = spark.createDataFrame([("m", t) for t in train] + [("m", None), (None, "abc")], "model string, text string")
    model = models.train(rows, "model", "text", order, method, alphabet=16)
    got = {r.k: r.bits for r in models.codelengths(spark.createDataFrame([*enumerate(test), (99, None)], "k int, t string"), "k", "t", model).collect()}
    assert got.keys() == set(range(len(test)))
    for i, t in enumerate(test):
        assert math.isclose(got[i], literal(train, t, order, method, 16), rel_tol=1e-9), t
    if method == "D":
        static = search.static_models(model)["m"]
        for i, t in enumerate(test):
            assert math.isclose(got[i], static.cost(t), rel_tol=1e-9)


def test_best_models_ties_and_single(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (2, "a", 1.0)], "k int, model string, bits double")
    got = {r.k: (r.best, r.second) for r in models.best_models(rows, "k").collect()}
    assert got == {1: ("a", "b"), 2: ("a", None)}


def test_model_store(spark, tmp_path):
    rows = spark.createDataFrame([("m", "abab")], "model string, text string")
    model = models.train(rows, "model", "text", 2)
    model.write(str(tmp_path / "m"))
    back = models.Model.read(spark, str(tmp_path / "m"))
    assert back.order == 2 and sorted(map(tuple, back.sym.collect())) == sorted(map(tuple, model.sym.collect()))
    assert {r.k: r.symbols for r in model.statistics().collect()} == {0: 4, 1: 3, 2: 2}
    with pytest.raises(ValueError):
        models.weight("A", F.lit(1))
    with pytest.raises(ValueError):
        search.static_models(model, largest=1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "model string, text string")
    model = models.train(none, "model", "text", 2)
    assert models.codelengths(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", model).count() == 0
    assert counts.dense_ids(spark.createDataFrame([], "a int"), [F.asc("a")]).count() == 0


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"))
    got = counts.dense_ids(rows, [F.desc("a")], "n", 1).collect()
    assert sorted((r.a, r.n) for r in got) == [(a, 1000 - a) for a in range(1000)]


def test_cumulative_ranges(spark):
    rows = counts.cumulative(spark.createDataFrame([(1, "a", 3), (1, "b", 2)], "g int, s string, n int"), ["g"], "s")
    assert rows.agg(counts.symbol_at(rows, F.lit(3), "s").alias("s")).first().s == "b"


def test_coder_round_trip_and_size():
    chance = random.Random(1)
    for data in (b"", b"a", b"abracadabra" * 9, bytes(range(256)), "കഥ ".encode() * 30, bytes(chance.choices(range(256), k=300))):
        for order, method in ((-1, "C"), (0, "D"), (1, "C"), (3, "D")):
            coded = A.compress(data, order, method)
            assert A.decompress(coded, order, method) == data
            bits = A.Adaptive(order, method).cost([*data, A.SENTINEL])
            assert bits / 8 - 1 <= len(coded) <= bits / 8 + 2 + len(data) * 0.001


def test_adaptive_by_hand():
    model = A.Adaptive(0, "C", 3)
    assert math.isclose(model.bits(0), 2.0)  # one of three symbols and the sentinel
    model.learn([0])
    assert math.isclose(model.bits(0), 1.0) and math.isclose(model.bits(1), 1 + math.log2(3))
    assert A.generate(["abab"], 20) == A.generate(["abab"], 20)


def test_held_out(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", "aaaa bbb" if i % 2 else "cdcd cd") for i in range(30)], "k int, l string, t string")
    assert all(r.best == r.label for r in A.held_out(rows, "k", "l", "t", 1, 3).collect())


def exhaustive(text, model, rules):
    outs = {""}
    frontier = {(0, "", 0.0)}
    done = []
    while frontier:
        i, out, cost = frontier.pop()
        if i == len(text):
            done.append((cost + model.cost(out), out))
            continue
        for r in [*rules, search.Rule(text[i], text[i])]:
            if text.startswith(r.source, i):
                frontier.add((i + len(r.source), out + r.target, cost + r.cost))
    del outs
    return min(done)


def test_search_equals_exhaustive():
    chance = random.Random(3)
    counted = {}
    for t in ["ab ab abc", "abc ab", "cab ab"]:
        for i, c in enumerate(t):
            for k in range(min(i, 2) + 1):
                of = counted.setdefault(t[i - k : i], {})
                of[c] = of.get(c, 0) + 1
    model = search.Static([(c, s, 2 * n - 1) for c, x in counted.items() for s, n in x.items()], 2, 8)
    for _ in range(25):
        text = "".join(chance.choices("abc", k=6))
        rules = [search.Rule(c, c + " ") for c in "abc"] + [search.Rule("ac", "abc", 1.5)]
        out, bits = search.viterbi(text, model, rules)
        assert math.isclose(bits, exhaustive(text, model, rules)[0], rel_tol=1e-9), (text, out)
    assert search.segment("ababc", model)[0].replace(" ", "") == "ababc"
    assert search.viterbi("", model, []) == ("", 0.0)
    assert search.keypad("22", search.Static([("", c, 1) for c in "abc"], 0))[0] in {x + y for x in "abc" for y in "abc"}
    with pytest.raises(ValueError):
        search.viterbi("a", model, [search.Rule("", "x")])


def test_mark_up():
    a, b = (search.Static([("", c, 9) for c in cs], 0, 64) for cs in ("abc", "xyz"))
    assert search.mark_up("abcabcxyzxyz", {"a": a, "b": b}, 4.0) == [("a", 0, 6), ("b", 6, 12)]
    assert search.mark_up("", {"a": a}) == [] and search.mark_up("abc", {}) == []


def test_mark_up_is_cheapest():
    """Of all labellings of short texts, with 8 bits for a change of the model, none is cheaper."""
    import itertools

    a, b = (search.Static([("", c, n) for c, n in counts], 0, 64) for counts in ((("x", 9), ("y", 1)), (("x", 1), ("y", 7))))
    by = {"a": a, "b": b}
    for text in ("xxxx", "xxyy", "xyxy", "xxxxxyyyyy", "yyyyxxxxyyyy"):
        def cost(labels, text=text):
            return sum(by[m].bits("", c) for m, c in zip(labels, text, strict=True)) + 8.0 * sum(p != q for p, q in itertools.pairwise(labels))

        found = "".join(m * (end - start) for m, start, end in search.mark_up(text, by, 8.0))
        assert cost(found) == pytest.approx(min(map(cost, itertools.product("ab", repeat=len(text)))))


def test_mark_up_by_sentinel():
    """As cheap as the cheapest of all labellings, a change costing the sentinel in the model that is left and the lost context."""
    import itertools

    a = search.Static([("", "x", 9), ("", "y", 3), ("x", "x", 5), ("x", "y", 1), ("y", "x", 3)], 1, 64)
    b = search.Static([("", "x", 1), ("", "y", 9), ("y", "y", 7), ("x", "y", 3)], 1, 64)
    by = {"a": a, "b": b}

    def cost(text, labels):
        out, begun = 0.0, 0
        for i, c in enumerate(text):
            if i and labels[i] != labels[i - 1]:
                out += by[labels[i - 1]].bits(text[max(begun, i - 1) : i], search.SENTINEL)
                begun = i
            out += by[labels[i]].bits(text[max(begun, i - 1) : i], c)
        return out

    for text in ("x", "xxxxyyyy", "yyyyyyyyxxxxxxxx", "xyxyxyxy", "yyyyxyyyyxxx"[:11]):
        found = "".join(m * (end - start) for m, start, end in search.mark_up_by_sentinel(text, by))
        assert cost(text, found) == pytest.approx(min(cost(text, x) for x in itertools.product("ab", repeat=len(text))))
    assert search.mark_up_by_sentinel("", by) == [] == search.mark_up_by_sentinel("x", {})


def test_stack_search():
    model = search.Static([("", c, 3) for c in "abc "] + [("a", "b", 5), ("b", "c", 5), ("c", " ", 5)], 1)
    whole = search.segment("abcabc", model)
    assert search.viterbi("abcabc", model, [search.Rule(c, c + " ") for c in "abc"], stack=50) == whole
    narrow = search.viterbi("abcabc", model, [search.Rule(c, c + " ") for c in "abc"], stack=1)
    assert narrow[1] >= whole[1] and narrow[0].replace(" ", "") == "abcabc"


def test_markup_statistics(spark):
    rows = spark.createDataFrame([(1, "a", 0, 4), (1, "b", 4, 6), (2, "a", 0, 1)], "k int, model string, start_pos int, end_pos int")
    assert sorted(map(tuple, search.markup_statistics(rows).collect())) == [("a", 5, 2, 0), ("b", 2, 1, 1)]


def test_alignment_by_chance():
    assert [m[:4] for m in align.align_by_chance([20, 30, 25], [29, 45, 36])] == [(0, 1, 0, 1), (1, 1, 1, 1), (2, 1, 2, 1)]
    assert [m[1::2][:2] for m in align.align_by_chance([20, 60], [30, 45, 43])] == [(1, 1), (1, 2)]
    assert align.align_by_chance([5], []) == [] and align.counted_length("ab, c。") == 4


def test_tagger_and_chunks():
    tagger = search.Tagger([[("the", "D"), ("dog", "N"), ("runs", "V")], [("a", "D"), ("cat", "N"), ("sees", "V")]])
    assert tagger.tag(["the", "cat", "runs"]) == ["D", "N", "V"] and tagger.tag([]) == []
    assert search.chunk([("the", "D"), ("dog", "N"), ("runs", "V")], [(("D",), "d"), (("D", "N"), "NP")]) == [("the", "D", "NP"), ("dog", "N", "NP"), ("runs", "V", "V")]


def test_alignment():
    assert align.edit_distance("kitten", "sitting") == 5 and align.edit_distance("kitten", "sitting", 1) == 3 and align.edit_distance("", "ab") == 2
    moves = align.align_lengths([20, 30, 25], [21, 55])
    assert [m[:4] for m in moves] == [(0, 1, 0, 1), (1, 2, 1, 1)]
    assert align.align_lengths([], []) == [] and align.align_lengths([5], [])[0][:4] == (0, 1, 0, 0)


def test_alignment_columns(spark):
    rows = spark.createDataFrame([(1, [20, 30, 25], [21, 55]), (2, [], []), (3, None, [1])], "k int, a array<int>, b array<int>")
    got = sorted(map(tuple, align.align_columns(rows, "k", "a", "b").collect()))
    assert got == [(1, *m) for m in align.align_lengths([20, 30, 25], [21, 55])]
    pair = spark.createDataFrame([("kitten", "sitting"), (None, "a")], "a string, b string")
    assert [r.d for r in pair.select(align.edit_distance_column(F.col("a"), F.col("b")).alias("d")).collect()] == [5, None]


def test_evaluation(spark):
    rows = spark.createDataFrame([("ab c d", "a bc d"), ("", ""), ("xy", "xy")], "f string, g string")
    got = evaluate.segmentation(rows, "f", "g").first()
    assert (got["both"], got.found, got.gold, got.recall) == (1, 2, 2, 0.5)
    scored = spark.createDataFrame([(0.1, True), (0.2, False), (0.9, True)], "s double, r boolean")
    at = {r.threshold: (r.recall, r.precision) for r in evaluate.recall_precision(scored, "s", "r", [0.0, 0.2, 1.0]).collect()}
    assert at == {0.0: (0.0, 0.0), 0.2: (0.5, 0.5), 1.0: (1.0, pytest.approx(2 / 3))}
    assert evaluate.break_even(evaluate.recall_precision(scored, "s", "r", [1.0])).first().break_even == pytest.approx(5 / 6)
    matrix = spark.createDataFrame([("r1", "a", 1.0, "a"), ("r2", "a", 2.0, "b"), ("r3", "a", 3.0, "a")], "row string, `column` string, value double, label string")
    assert evaluate.mean_average_precision(matrix).first().average_precision == pytest.approx((1 + 1 / 2 + 2 / 3) / 3)
    curve = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert evaluate.area(curve, "x", "y").first().area == 1.5


def test_sets_and_tuples(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3), ("b", None)], "name string, m int")
    assert tuple(sets.pairwise(sets.collect_sets(rows, "name", "m"), "name", "a", "b").first()) == (3, 1, False)
    people = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, "y", 5)], "id int, c string, n int")
    pairs = sets.as_pairs(people, "id", ["c", "n"])
    assert [r.id for r in sets.query(pairs, "id", ["c=x", "n=5"]).collect()] == [1]
    assert sorted(r.id for r in sets.query(pairs, "id", []).collect()) == [1, 2, 3]
    m = spark.createDataFrame([("r", "c", 1.0)], "row string, `column` string, value double")
    assert sets.merge([m, m]).first().value == 2.0
