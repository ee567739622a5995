import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symstream.functions import text as T


def twin(text):
    """Transliteration by the rules, sign by sign."""
    table, out, i = T.PLAIN | T.LONGER, "", 0
    mark = lambda c: c != "ം" and unicodedata.category(c)[0] == "M"
    while i < len(text):
        if text[i : i + 3] in T.LIGATURES:
            out += T.LIGATURES[text[i : i + 3]][1]
            i += 3
            if i < len(text) and not mark(text[i]):
                out += "a"
        elif text[i : i + 2] in T.TWO_PART:
            out += table[T.TWO_PART[text[i : i + 2]]]
            i += 2
        elif text[i] == T.VIRAMA:
            i += 1
            after = text[i : i + 1]
            if not after or after in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r\v\f‌" or unicodedata.category(after)[0] == "Z":
                out += "ŭ"
        else:
            c = text[i]
            out += table.get(c, c)
            i += 1
            if c in T.HOLDS_A and not (i < len(text) and mark(text[i])):
                out += "a"
    return out


CASES = ["ക", "കാ", "കി", "കൊ", "കൊ", "അവൻ", "എന്റെ", "പറ്റി", "പേര്", "പേര് ഉണ്ട്.", "മരം", "൧൨", "ന്റ", "റ്റ", "എന്റ ", "ക്ഷ", "abc", "", "ആണ്‌", "ഒന്ന്\n"]


def test_transliteration(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", T.transliterate("t").alias("x")).collect()}
    assert got.pop(len(CASES)) is None
    assert got == {i: twin(t) for i, t in enumerate(CASES)}
    assert got[5] == "avan" and got[6] == "enṯe" and got[8] == "pērŭ"


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="കനറര്ാെേൊംൻ .1aഅ", max_size=12), min_size=150, max_size=150))
def test_transliteration_random(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.x for r in rows.select("i", T.transliterate("t").alias("x")).collect()} == {i: twin(t) for i, t in enumerate(texts)}


def variants(text):
    if len(text) > 2000:
        text = text[:2000]
        if text.rfind(".") > 1600:
            text = text[: text.rfind(".") + 1]
    bare = re.sub(r"\s+", "", text)
    out = {"original": text, "no_spaces": bare, "char_spacing": " ".join(bare)}
    if len(bare) > 10:
        out["random_spacing"] = "".join(c + " " * (i > 0 and i % 4 == 0 and i < len(bare) - 1) for i, c in enumerate(bare))
    return out


def test_spacing_variants(spark):
    texts = ["", "   ", "ab", "hello wide world again", "x" * 10, "y" * 11, "w. " * 900, "q" * 1700 + "." + "r" * 500, "q" * 1500 + "." + "r" * 900, "a b c" * 5]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.inline(T.spacing_variants("t", 2000)))
    got = {}
    for r in rows.collect():
        got.setdefault(r.i, {})[r.spacing] = r.variant
    assert got == {i: variants(t) for i, t in enumerate(texts)}


def test_spacing_of_whole_texts(spark):
    text = "ab cd. " * 700 + "end"
    got = {r.spacing: r.variant for r in spark.createDataFrame([(text,)], "t string").select(F.inline(T.spacing_variants("t", longest=None))).collect()}
    bare = text.replace(" ", "")
    assert got["original"] == text and got["no_spaces"] == bare and got["char_spacing"] == " ".join(bare) and got["random_spacing"].replace(" ", "") == bare


def test_spacing_queries_cut_nothing(spark, tmp_path):
    from symstream.plans import model_plans, text_plans

    text = "ab cd " * 700
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s")], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text, text)], "line_id bigint, malayalam_lines string, transliterated_lines string").write.parquet(f"{tmp_path}/evaluation.parquet")
    whole = {r.spacing: r.length for r in text_plans.spacing_variants(spark, str(tmp_path)).collect()}
    assert whole == {"original": 4200, "no_spaces": 2800, "char_spacing": 5599, "random_spacing": 3499}
    assert {r.n_symbols for r in model_plans.spacing_study(spark, str(tmp_path)).where("spacing = 'original'").collect()} == {4200}


def test_cleaning_and_ratios(spark):
    rows = spark.createDataFrame([(1, "കഥ  abc, (12)-ഒന്ന്.\n"), (2, ""), (3, "   "), (4, None), (5, " കഥ ")], "i int, t string")
    got = {r.i: r for r in rows.select("i", T.clean_malayalam("t").alias("a"), T.clean_malayalam("t", wide=True).alias("b"), T.ratio("t", T.MALAYALAM).alias("r")).collect()}
    assert got[1].a == "കഥ , ഒന്ന്." and got[1].b == "കഥ , ( )-ഒന്ന്."
    assert (got[2].a, got[2].r, got[3].a, got[3].r, got[4].a, got[4].r, got[5].a, got[5].r) == ("", 0.0, "", 0.0, None, None, "കഥ", 1.0)


def test_tokens_keys_and_codes(spark):
    rows = spark.createDataFrame([("--ab, c1!! d..",), ("",), (None,), ("കഥ " * 3000,)], "t string")
    got = rows.select(T.alternation("t").alias("p"), T.words("t").alias("w"), T.phone_keys("t").alias("k"), T.word_types("t").alias("y")).collect()
    assert [tuple(x) for x in got[0].p] == [("--", "ab"), (", ", "c1"), ("!! ", "d")]
    assert got[0].k == "   22, 2 3.." and got[0].y == ["ab", "c1", "d"] and got[1].p == [] and got[1].w == [] and got[1].k == "   " and got[2].k is None
    assert len(got[3].w) == 3000 and got[3].p == []
    bits = spark.range(200).select("id", T.sss_bits("id", 1, 2, 9).alias("b")).collect()

    def code(n, start, step, stop):
        low, width, ones = 0, start, 0
        while n >= low + (1 << width) and width < stop:
            low, width, ones = low + (1 << width), width + step, ones + 1
        return ones + (width < stop) + width

    assert [r.b for r in bits] == [code(r.id, 1, 2, 9) for r in bits]


def test_number_streams(spark):
    rows = spark.createDataFrame([(1, [0, 5, 983039]), (2, []), (3, None)], "k int, n array<int>")
    got = {r.k: r for r in rows.select("k", F.length(T.numbers_as_text("n")).alias("l"), T.text_as_numbers(T.numbers_as_text("n")).alias("b"), T.labelled_numbers("n", 2).alias("m")).collect()}
    assert (got[1].l, got[1].b, got[1].m[:2]) == (3, [0, 5, 983039], [512, 517]) and got[2].b == [] and got[3].b is None


def test_start_step_stop_round_trip():
    for start, step, stop in ((1, 2, 9), (0, 1, 5), (3, 3, 9)):
        top = sum(1 << w for w in range(start, stop + 1, step))
        bits = "".join(T.sss_encode(n, start, step, stop) for n in range(top))
        at = 0
        for n in range(top):
            got, used = T.sss_decode(bits[at:], start, step, stop)
            assert got == n
            at += used
        assert at == len(bits)
