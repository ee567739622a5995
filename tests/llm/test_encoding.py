import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symstream.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.RANKS), reason="no rank file here")

TEXTS = ["", None, "a", " ", "  a  b ", "a\nb \n c", "it's don't", "കഥ ഒന്ന്  രണ്ട്", "x" * 30_000, "ab " * 20_000, " a  b", "a \x1c b", "😀 z", "<|endoftext|>", "tab\t x", "12 345", "end "]


def test_ids_equal_the_library(spark):
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "k int, t string, ids int")
    got = {r.k: list(r.ids) for r in encoding.encode(rows, "k", "t").collect()}
    plain = encoding.encoder().encode_ordinary
    assert got == {i: plain(t) if t else [] for i, t in enumerate(TEXTS)}
    counted = {r.k: r.n_tokens for r in encoding.count_tokens(rows, ["k"], "t").collect()}
    assert counted == {k: len(x) for k, x in got.items()}
    back = {r.k: r.text for r in encoding.decode(encoding.encode(rows, "k", "t"), "k", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoding.encode(rows.limit(0), "k", "t").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1.ക്"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_parts_are_safe(text):
    pack = encoding.packed_encoder()
    assert pack(text) == b"".join(i.to_bytes(4, "little") for i in encoding.encoder().encode_ordinary(text))
    assert "".join(encoding.parts(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"ab's1 \n\t\r\x1c\x85\u3000。，「」…中文字é🙂!-"]), min_size=60, max_size=200))
def test_long_parts_are_safe(text):
    assert encoding.packed_encoder()(text) == b"".join(i.to_bytes(4, "little") for i in encoding.encoder().encode_ordinary(text))


def test_parts_are_short():
    for text in ("line one\n" * 100_000, "他们说好。今天，我们来" * 50_000, "a b\tc\r\nd " * 50_000):
        assert max(map(len, encoding.parts(text))) < 20


def test_cut_character(spark):
    ids = encoding.encoder().encode_ordinary("കഥ")
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.text for r in encoding.decode(rows, "k", "ids").collect()}
    assert got[1].endswith("�") and got[2] is None and got[3] == ""
