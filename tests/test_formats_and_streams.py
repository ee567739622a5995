import pytest
from pyspark.sql import functions as F

from symstream.operators.adaptive import Adaptive
from symstream.sources import formats
from symstream.streaming import adaptive_stream as S


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("കഥ\r\nline\n".encode())
    (tmp_path / "b.txt").write_bytes(b"x\xffy")
    (tmp_path / "c.dat").write_bytes(b"no")
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in formats.read_texts(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "കഥ\r\nline\n", "b.txt": "xy"}
    lines = formats.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no")
    assert [r.text for r in lines.collect()] == ["കഥ", "line", ""]


def test_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\nz")
    of = lambda keep: [r.text for r in formats.read_lines(spark, str(tmp_path / "a.txt"), keep).orderBy("line_no").collect()]
    assert of("") == ["x", "y", "z"] and of("\r") == ["x\r", "y", "z"] and of("\r\n") == ["x\r\n", "y\n", "z"]
    with pytest.raises(ValueError):
        of("x")


def test_writers_and_their_readers(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    texts = ["കഥ\nx\\y", "", "a\r\n"]
    formats.write_escaped(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), "t", path("escaped"))
    back = spark.read.text(path("escaped")).select(formats.escaped("value").alias("s")).collect()
    assert sorted("".join(map(chr, r.s)) for r in back) == sorted(texts)
    cells = [("r", "c", 0.5), ("r", "d", -1.25)]
    formats.write_matrix(spark.createDataFrame(cells, "row string, column string, value double"), path("matrix"))
    assert sorted(map(tuple, formats.matrix(spark.read.text(path("matrix"))).collect())) == cells
    pairs = [("a", "x=1"), ("a", "y=2"), ("b", "x=3")]
    formats.write_tuples(spark.createDataFrame(pairs + pairs[:1], "id string, pair string"), "id", path("tuples"))
    assert sorted(map(tuple, formats.tuples(spark.read.text(path("tuples"))).collect())) == pairs
    sets = [("e", []), ("s", [3, 9, 100, 10**12])]
    formats.write_sets(spark.createDataFrame([(n, m[::-1]) for n, m in sets], "name string, members array<bigint>"), path("sets"))
    assert sorted((r.name, r.members) for r in formats.read_sets(spark.read.text(path("sets"))).collect()) == sets
    keys = spark.createDataFrame([("k ",), ("",), ("k",), ("l",)], "value string")
    assert sorted(r.key for r in formats.key_list(keys).collect()) == ["k", "l"]
    rows = formats.tagged(spark.createDataFrame([(1, "a<b & c"), (2, None)], "n int, t string"), ["n", "t"])
    assert [r.value for r in rows.collect()] == ["<n>1</n><t>a&lt;b &amp; c</t>", "<n>2</n>"]
    assert [r.v for r in rows.select(formats.without_tags("value").alias("v")).collect()] == ["1a<b & c", "2"]
    assert spark.createDataFrame([("12345678901234 7 x 99999999999999999999",)], "t string").select(formats.numbers("t").alias("n")).first().n == [12345678901234, 7]


def test_line_formats(spark):
    of = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    assert sorted(map(tuple, formats.judgments(of("d1 a b a", "d2", "")).collect())) == [("d1", "a"), ("d1", "b")]
    assert [tuple(r) for r in formats.matrix(of("0.5 r c", "junk")).collect()] == [("r", "c", 0.5)]
    assert [tuple(r) for r in formats.confusions(of("1 4 a -> b", "0 4 a -> b", "#")).collect()] == [("a", "b", 2.0)]
    assert [tuple(r) for r in formats.model_list(of("en  models/en.model", "")).collect()] == [("en", "models/en.model")]
    assert of("3 x 258", "").select(formats.numbers("value").alias("n")).collect()[0].n == [3, 258]
    symbols = [65, 92, 258, 10]
    assert formats.unescape(formats.escape(symbols)) == symbols
    assert of("a\\258\\b").select(formats.escaped("value").alias("s")).first().s == [97, 258, 98]
    tagged = spark.createDataFrame([(0, "dog"), (1, "N"), (2, "runs"), (3, "V")], "i int, value string")
    assert sorted(map(tuple, formats.alternating(tagged, "i").collect())) == [(0, "dog", "N"), (1, "runs", "V")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", i, (i * i) % 5) for i in range(40)] + [(None, 1, 1), ("k0", 99, None)]
    frame = spark.createDataFrame(rows, "key string, at int, sym int")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, S.score_batch(frame, "key", "at", "sym").collect()))
    twin = Adaptive(2, "D", 256)
    assert [w[3] for w in want if w[0] == "k0"] == pytest.approx([twin.cost([s]) for k, _, s in rows[:40] if k == "k0"])
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = S.score_stream(stream, "key", "at", "sym").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("scored").collect())) == want


def test_order_across_arrow_batches(spark, tmp_path):
    """Events out of order, many for each key, four to an Arrow batch, in two micro-batches."""
    import random

    chance = random.Random(8)
    parts = [[(f"k{i % 3}", base + i, chance.randrange(5)) for i in range(90)] for base in (0, 1000)]
    for i, part in enumerate(parts):
        chance.shuffle(part)
        spark.createDataFrame(part, "key string, at int, sym int").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        frame = spark.createDataFrame(parts[0] + parts[1], "key string, at int, sym int")
        want = sorted(map(tuple, S.score_batch(frame, "key", "at", "sym").collect()))
        for name in ("k0", "k1", "k2"):
            symbols = [s for k, _, s in sorted(parts[0] + parts[1], key=lambda x: x[1]) if k == name]
            assert [w[2] for w in want if w[0] == name] == symbols
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = S.score_stream(stream, "key", "at", "sym").writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(90)
        got = sorted(map(tuple, spark.table("ordered").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 180 and sorted(g[:3] for g in got if g[1] < 30) == sorted(w[:3] for w in want if w[1] < 30)
    assert [round(g[3], 9) for g in got] == [round(w[3], 9) for w in want]


def test_windows_and_static_scores(spark):
    from symstream.operators.search import Static

    rows = spark.createDataFrame([(1, "aa"), (2, None)], "k int, t string")
    got = {r.k: r.bits for r in S.static_scores(rows, ["k"], "t", Static([("", "a", 1)], 0, 4)).collect()}
    assert got == {1: 2.0, 2: None}
    events = spark.sql("SELECT timestamp'2020-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2020-01-01 00:50:00', 'a'")
    assert S.windowed_types(events, "ts", "kind").select(F.sum("n")).first()[0] == 2
