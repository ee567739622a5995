"""The coder in the JVM against the one in Python."""

import random

import pytest
from pyspark.sql import functions as F

from symstream.operators import adaptive, coder
from symstream.plans import catalog


@pytest.mark.parametrize(("order", "method"), [(-1, "C"), (0, "D"), (1, "C"), (3, "D"), (5, "D")])
def test_same_bytes_as_in_python(spark, order, method):
    chance = random.Random(1)
    datas = [b"", b"a", b"abracadabra" * 9, bytes(range(256)) * 2, "കഥ ".encode() * 30, bytes(chance.choices(range(256), k=3000)), b"\0" * 5000, bytes(chance.choices(b"ab", k=900))]
    rows = spark.createDataFrame([*enumerate(map(bytearray, datas)), (99, None)], "k int, t binary")
    coded = rows.select("k", "t", coder.compressed(spark, F.col("t"), order, method).alias("coded"))
    got = {r.k: r for r in coded.select("k", "coded", coder.decompressed(spark, F.col("coded"), order, method).alias("back")).collect()}
    assert got[99].coded is None and got[99].back is None
    for i, data in enumerate(datas):
        assert bytes(got[i].coded) == adaptive.compress(data, order, method) and bytes(got[i].back) == data
    with pytest.raises(ValueError):
        coder.compressed(spark, F.col("t"), order, "E")


def test_decoder_reads_the_code_only(spark):
    """A code that was changed gives another text, or none that is the same."""
    texts = ["the same text, the same model", "കഥ കഥ"]
    rows = spark.createDataFrame([(i, bytearray(adaptive.compress(t.encode()))) for i, t in enumerate(texts)], "k int, coded binary")
    assert [r.text for r in adaptive.decode_texts(rows, "k", "coded").orderBy("k").collect()] == texts
    other = spark.createDataFrame([(0, bytearray(adaptive.compress(b"another")))], "k int, coded binary")
    assert adaptive.decode_texts(other, "k", "coded").first().text == "another"


def test_codec_runs_in_the_jvm(spark, small):
    """No symbol is coded or decoded by a Python worker."""
    plan = catalog.queries()["codec_round_trip"](spark, small)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
