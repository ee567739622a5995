import pytest

from symstream.llm import mixing


def plans(targets, sizes, wanted):
    return {p.source: p for p in mixing.allocate(targets, sizes, wanted)}


def test_budgets():
    got = plans([("a", 0.5, 1), ("b", 0.3, 10), ("c", 0.2, 2), ("d", 0.0, 2)], {"a": 100, "b": 20, "x": 80}, 200)
    assert got["a"].budget == 100 and got["a"].whole == 1 and got["a"].rest == 0
    assert got["b"].budget == pytest.approx(100) and got["b"].whole == 5 and got["c"].budget == 0 and got["d"].budget == 0
    assert plans([("a", 1.0, 2)], {}, 0)["a"].budget == 0


def test_mixture(spark):
    rows = [(i, s, 1 + i * 7 % 50) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 60 + [None] * 40 + ["other"] * 50)] + [(9000, "mid", 0), (9001, "mid", None)]
    frame = spark.createDataFrame([(k, s, n, "c") for k, s, n in rows], "k int, s string, n int, copies string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.15, 3), ("none", 0.1, 3)], "source_name string, target_share double, max_repeats int")
    out = mixing.mixture(frame, targets, "k", "s", "n")
    got = {r.k: r for r in out.collect()}
    most = {"big": 1, "mid": 3, "small": 3}
    assert all(1 <= r.copies <= most[r.s] for r in got.values())
    total = sum(n or 0 for _, _, n in rows)
    plan = plans([tuple(r) for r in targets.collect()], {s: sum(n or 0 for _, x, n in rows if x == s) for s in most}, total)
    for s in most:
        assert abs(sum(r.copies * (r.n_tokens or 0) for r in got.values() if r.s == s) - plan[s].budget) <= 50, s
        copies = {got[k].copies if k in got else 0 for k, x, n in rows if x == s and n}
        assert len(copies) <= 2  # whole copies, and one more for those drawn
    assert sorted((r.k, r.copies) for r in out.collect()) == sorted((r.k, r.copies) for r in mixing.mixture(frame.repartition(9), targets, "k", "s", "n").collect())
    report = {r.source_name: r for r in mixing.shares(out, targets, "s").collect()}
    assert report["none"].tokens == 0 and report["big"].most_copies == 1 and abs(sum(r.share_reached for r in report.values()) - 1) < 1e-9
    assert mixing.mixture(frame.limit(0), targets, "k", "s", "n").count() == 0 == mixing.mixture(frame, targets.limit(0), "k", "s", "n").count()


def test_draws_are_fair(spark):
    rows = spark.range(20_000).selectExpr("id k", "'a' s", "1 n")
    rows = rows.unionByName(spark.range(20_000, 60_000).selectExpr("id k", "'b' s", "1 n"))
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 1)], "source_name string, target_share double, max_repeats int")
    got = mixing.mixture(rows, targets, "k", "s", "n").where("s = 'a'")
    assert abs(got.count() - 20_000) <= 1  # b can't give its share, a is used up
    few = mixing.mixture(rows.unionByName(spark.range(60_000, 90_000).selectExpr("id k", "'c' s", "1 n")), spark.createDataFrame([("a", 0.1, 1), ("c", 0.2, 1), ("b", 0.7, 2)], targets.schema), "k", "s", "n").where("s = 'a'")
    n = few.count()
    assert abs(n - 9000) <= 1 and abs(few.where("k < 10000").count() / n - 0.5) < 0.03


def test_inclusion_rates(spark):
    """Documents are drawn as often as their probabilities say, over many seeds; those of probability 1 always."""
    sizes = [1, 4, 25, 100]
    rows = spark.range(0, 8000).selectExpr("id k", "'a' s", f"cast(element_at(array({','.join(map(str, sizes))}), int(id % 4) + 1) as bigint) n").cache()
    rows = rows.unionByName(spark.range(8000, 12000).selectExpr("id k", "'b' s", "10L n"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 8)], "source_name string, target_share double, max_repeats int")
    total = 2000 * sum(sizes) + 40_000
    x = mixing.factor([(2000.0 * n, n**0.5) for n in sizes], total / 2)
    got = {n: 0 for n in sizes}
    for seed in (1, 2, 3):
        for r in mixing.mixture(rows, targets, "k", "s", "n", seed).where("s = 'a'").groupBy("n_tokens").count().collect():
            got[r.n_tokens] += r["count"] / 6000
    for n in sizes:
        assert abs(got[n] - min(1.0, x * n**0.5)) < 0.03, (n, got)
    assert got[1] < got[4] < got[25] < got[100]
    assert mixing.factor([(10.0, 1.0)], 0) == 0 and mixing.factor([], 5) == 0 and mixing.factor([(10.0, 2.0)], 10) == 0.5
