import pytest

from symstream.llm import canonical

ALIKE = [
    ("അവന്‍ വന്നു", "അവൻ വന്നു"),
    ("കൊ", "കൊ"),
    ("ഇൗ മഴ", "ഈ മഴ"),
    ("എെക്യം", "ഐക്യം"),
    ("മെെ", "മൈ"),
    ("അവ൪", "അവർ"),
    ("ക​ഥ", "കഥ"),
    ("കഥ ഒന്ന്", "കഥ ഒന്ന്"),
    ("Рrоf. ｄｒ", "Prof. dr"),
    ("１２（３）", "12(3)"),
    ("é", "é"),
]
DIFFERENT = [("കഥ  ഒന്ന്", "കഥ ഒന്ന്"), ("കഥ\tഒന്ന്", "കഥ ഒന്ന്"), ("Abc", "abc"), ("“a”", '"a"'), ("a–b", "a-b"), ("൧൪൩", "൧ർ൩"), ("a.", "a"), ("x²", "x2"), ("①", "1")]


@pytest.fixture(scope="module")
def forms(spark):
    texts = [t for pair in ALIKE + DIFFERENT for t in pair]
    rows = spark.createDataFrame(list(enumerate([*texts, None, "", "  "])), "k int, t string")
    return [r.canonical for r in canonical.canonical_texts(rows, "k", "t").orderBy("k").collect()], len(texts)


def test_forms(forms):
    got, n = forms
    for i in range(0, 2 * len(ALIKE), 2):
        assert got[i] == got[i + 1], ALIKE[i // 2]
    for i in range(2 * len(ALIKE), n, 2):
        assert got[i] != got[i + 1], DIFFERENT[i // 2 - len(ALIKE)]
    assert got[n:] == [None, "", "  "]


def test_pairs(spark):
    rows = [(1, "അവന്‍"), (2, "അവൻ"), (2, "അവൻ"), (3, "അവൻ"), (4, None), (5, ""), (6, " "), (7, " "), (8, "x" * 100_000), (9, "ｘ" + "x" * 99_999)]
    frame = spark.createDataFrame([(k, t, 0, "f") for k, t in rows], "k int, t string, raw int, form string")
    got = sorted(map(tuple, canonical.look_alike_pairs(frame, "k", "t").collect()))
    assert got == [(1, 2), (1, 3), (8, 9)]
    classes = canonical.look_alike_classes(frame, "k", "t").collect()
    assert sorted(r.k for r in classes) == [1, 2, 3, 8, 9] and len({r.form for r in classes}) == 2
    assert canonical.look_alike_pairs(frame.limit(0), "k", "t").count() == 0
    assert canonical.canonical_texts(frame.limit(0), "k", "t").count() == 0


def test_hot_group(spark):
    rows = spark.createDataFrame([(i, "അവൻ") for i in range(400)] + [(400, "അവന്‍")], "k int, t string")
    assert canonical.look_alike_pairs(rows, "k", "t").count() == 400
