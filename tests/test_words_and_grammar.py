import pytest
from pyspark.sql import functions as F

from symstream.operators import counts, grammar, models, words


def test_distribution_sums_to_one(spark):
    rows = spark.createDataFrame([("m", "abab"), ("m", "abc")], "model string, text string")
    model = models.train(rows, "model", "text", 1, alphabet=3)
    got = words.distribution(spark.createDataFrame([("a",), ("",), ("b",)], "ctx string"), model).groupBy("ctx").agg(F.sum("probability").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.ctx: r.n for r in got} == {"a": 3, "": 3, "b": 3} and all(0.7 < r.p <= 1.0 + 1e-9 for r in got)


def test_word_model(spark):
    train = spark.createDataFrame([("the cat. the dog",), (None,)], "t string")
    rows = spark.createDataFrame([(1, "the cat"), (2, "the cow"), (3, None), (4, "")], "k int, t string")
    got = {r.k: r for r in words.word_bits(rows, "k", "t", train, "t").collect()}
    assert set(got) == {1, 2} and got[1].tokens == 4 and got[1].bits < got[2].bits


def test_order_streams(spark):
    """With the order known a symbol costs no more than with escapes, and one that is always found in the same order costs nothing there."""
    rows = spark.createDataFrame([(1, "m", "abababab"), (2, "m", "abab"), (3, "m", None), (4, None, "x"), (5, "n", "zzz")], "k int, m string, t string")
    model = models.train(rows, "m", "t", 1)
    got = {r.k: r for r in words.order_codelengths(rows, "k", "m", "t", model).collect()}
    whole = {(r.k, r.model): r.bits for r in models.codelengths(rows, "k", "t", model).collect()}
    assert set(got) == {1, 2, 5} and all(r.symbol_bits < whole[k, r.model] and r.order_bits > 0 for k, r in got.items())
    # a is known at order 0 at the start, then every symbol follows for sure
    weights = {r.sym: r.weight for r in model.sym.where("model = 'm' AND k = 0").collect()}
    import math

    assert got[1].symbol_bits == pytest.approx(-math.log2(weights["a"] / sum(weights.values())))


def test_orders_and_windows(spark):
    rows = spark.createDataFrame([("m", "ababab")], "model string, text string")
    model = models.train(rows, "model", "text", 2)
    grams = counts.gram_counts(spark.createDataFrame([(1, "abz")], "k int, t string"), ["k"], "t", 2)
    found = {r.gram: r.found for r in words.found_orders(grams, model, []).collect()}
    assert found == {"a": 0, "ab": 1, "abz": -1}
    assert {r.found: r.n for r in words.order_stream(words.found_orders(grams, model, []), []).collect()} == {0: 1, 1: 1, -1: 1}
    stream = spark.createDataFrame([(1, i, s) for i, s in enumerate("abab")], "u int, at int, s string")
    got = {tuple(r.prefix): r.n for r in words.windows(stream, ["u"], ["at"], "s", 2).collect()}
    assert got == {("a",): 2, ("b",): 2, ("a", "b"): 2, ("b", "a"): 1}


def test_parse_is_cheapest():
    """Against all derivations of short texts, with chains and cycles of rules of one symbol."""
    import functools

    P = grammar.Production
    rules = [P("S", ("A", "B"), 1.0), P("S", ("B",), 2.0), P("B", ("S",), 0.5), P("A", ("a",), 1.0), P("A", ("B",), 0.25), P("B", ("b",), 1.0), P("B", ("A", "A"), 0.75), P("S", ("a", "B", "b"), 0.1)]

    def best(tokens):
        @functools.cache
        def cost(symbol, i, j, depth):
            if depth == 0:
                return float("inf")
            out = 0.0 if j == i + 1 and tokens[i] == symbol else float("inf")
            for r in rules:
                if r.left == symbol:
                    out = min(out, r.cost + parts(r.right, i, j, depth - 1))
            return out

        @functools.cache
        def parts(right, i, j, depth):
            if len(right) == 1:
                return cost(right[0], i, j, depth)
            return min((cost(right[0], i, k, depth) + parts(right[1:], k, j, depth) for k in range(i + 1, j)), default=float("inf"))

        return cost("S", 0, len(tokens), 9)

    for text in ("b", "a", "ab", "aab", "abb", "aabb", "bab"):
        found = grammar.parse(list(text), rules, "S")
        assert (float("inf") if found is None else found[0]) == pytest.approx(best(tuple(text)))


def test_grammar(spark):
    rules = grammar.from_counts([("S", ("NP", "VP"), 1), ("NP", ("D", "A", "N"), 1), ("NP", ("D", "N"), 3), ("VP", ("V", "NP"), 1), ("VP", ("V",), 1), ("D", ("the",), 1), ("A", ("old",), 1), ("N", ("dog",), 1), ("N", ("cat",), 1), ("V", ("sees",), 1)])
    bits, tree = grammar.parse("the old dog sees the cat".split(), rules, "S")
    assert grammar.show(tree) == "(S (NP (D the) (A old) (N dog)) (VP (V sees) (NP (D the) (N cat))))"
    assert bits == pytest.approx(2 + 1 + 1 + 1 + 0.415037499, abs=1e-6)
    assert grammar.parse(["dog"], rules, "S") is None and grammar.parse([], rules, "S") is None
    assert grammar.generate(rules, "S") == grammar.generate(rules, "S") and grammar.parse(grammar.generate(rules, "S"), rules, "S")
    rows = spark.createDataFrame([(1, ["the", "dog", "sees"]), (2, ["sees"]), (3, None)], "k int, w array<string>")
    got = {r.k: r.tree for r in grammar.parse_texts(rows, "k", "w", rules, "S").collect()}
    assert got == {1: "(S (NP (D the) (N dog)) (VP (V sees)))", 2: None, 3: None}
    with pytest.raises(ValueError):
        grammar.parse(["a"], [grammar.Production("S", ())], "S")
