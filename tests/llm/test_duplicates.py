import collections
import json
import random

from symstream.llm import bloom, duplicates


def test_fields(spark):
    rows = [(1, "Abc, d", None), (2, "abc D!", None), (3, "abcd", ""), (4, None, None), (5, None, None), (6, "", ""), (7, " .", "-"), (1, "Abc, d", None), (8, "ABCD", "x"), (9, "y" * 200_000, "z")]
    frame = spark.createDataFrame([(k, a, b, "x", "y") for k, a, b in rows], "k int, a string, b string, h string, copies string")
    hashed = duplicates.hash_fields(frame, "k", ["a", "b"])
    assert sorted(map(tuple, duplicates.copies_of(hashed, 17).collect())) == [(1, 2), (4, 5), (6, 7)]
    assert sorted(map(tuple, duplicates.collapse(hashed, 17).collect())) == [(1, 2), (3, 1), (4, 2), (6, 2), (8, 1), (9, 1)]
    empty = duplicates.hash_fields(frame.limit(0), "k", ["a", "b"])
    assert duplicates.copies_of(empty).count() == duplicates.collapse(empty).count() == 0


def test_payloads(spark):
    names = ["a", "b"]
    rows = [
        (1, json.dumps({"a": "X y", "b": "1"})), (2, '{ "b":"1","a" : "x-Y" }'), (3, '{"a": "\\u0058y", "b": "1", "c": 3}'), (4, '{"a": "xy"}'), (5, '{"a": "xy", "b": null}'), (6, '{"a": "xy'),
        (7, None), (8, "[]"), (9, "3"), (10, ""), (11, '{"a": 5, "b": "1"}'), (12, '{"a": "5", "b": "1"}'), (13, '{"a": "\\ud800", "b": "1"}'),
    ]
    frame = spark.createDataFrame(rows, "k int, p string")
    got = sorted(map(tuple, duplicates.copies_of(duplicates.hash_json(frame, "k", "p", names)).collect()))
    assert got == [(1, 2), (1, 3), (4, 5), (11, 12)]


def test_against_brute_force(spark):
    chance = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "".join(chance.choice([w, w.upper(), w + " ", "." + w]) for w in chance.choices(words, k=2))) for i in range(3000)] + [(5000 + i, "HOT!" if i % 2 else "hot") for i in range(1500)]
    frame = spark.createDataFrame(rows, "k int, a string").repartition(7)
    groups = collections.defaultdict(list)
    for k, a in rows:
        groups["".join(c for c in a.lower() if c.isalnum())].append(k)
    want = sorted((min(g), len(g)) for g in groups.values())
    hashed = duplicates.hash_fields(frame, "k", ["a"])
    for most in (13, 29):  # shards and one filter give the same
        assert sorted(map(tuple, duplicates.collapse(hashed, most).collect())) == want
        assert duplicates.copies_of(hashed, most).count() == len(rows) - len(groups)
    rows_of = duplicates.possible_repeats(hashed.cache(), 10)  # so does a crowded filter
    assert rows_of(True).count() + rows_of(False).count() == len(rows) and rows_of(False).count() < len([g for g in groups.values() if len(g) == 1])


def test_few_singletons_pass(spark):
    """A filter of 2 ** 16 bits and sixty times the records that it serves: shards keep the share of singletons that pass."""
    n = 60 * (1 << 16) // bloom.BITS_PER_KEY
    rows = spark.range(0, n, 1, 6).selectExpr("id k", "unhex(md5(cast(id % " + str(n - 1000) + " as string))) h")
    parts = duplicates.shards_of(rows, 16)
    assert len(parts) == 60 and all(size == 16 for _, size in parts)
    passed = sum(duplicates.possible_repeats(*x)(True).count() for x in parts[:4]) / sum(x.count() for x, _ in parts[:4])
    assert passed < 0.05
    assert bloom.size_for(10**9) == (29, 19) and bloom.size_for(450_000) == (23, 1) and bloom.size_for(0) == (16, 1)


def test_filter_never_misses(spark):
    rows = spark.createDataFrame([(i % 700,) for i in range(1000)], "k long").selectExpr("k", "unhex(md5(cast(k as string))) h").repartition(5)
    shared = bloom.load(bloom.merged(rows.select("h"), 14, repeated=True), 14)
    import pyarrow as pa

    found = rows.collect()
    hit = bloom.hits(shared, *bloom.halves(pa.array([bytes(r.h) for r in found], pa.binary())), 14)
    assert all(h for h, r in zip(hit, found, strict=True) if r.k < 300)
    assert hit.mean() < 1
