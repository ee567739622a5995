"""Queries of text functions, vocabularies and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symstream.functions import text as T
from symstream.operators import counts, sets
from symstream.sources.tables import spread, table

_WS = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_SQL = _WS
#: What \\s is in Java's regular expressions.
JAVA_WS = r"\x{0009}-\x{000D}\x{0020}"
_ML = r"\x{0D00}-\x{0D7F}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once: lines delivered again have the same content, so only ids are compared."""
    rows = table(spark, sf_dir, "evaluation")
    return rows.dropDuplicates(["line_id"])


def symbol_freq(spark, sf_dir):
    return counts.frequencies(docs(spark, sf_dir).where("text IS NOT NULL").select(F.explode(T.symbols("text")).alias("sym")), ["sym"])


def bigram_counts(spark, sf_dir):
    return counts.frequencies(counts.ngrams(docs(spark, sf_dir), [], "text", 2), ["gram"])


def trigram_counts(spark, sf_dir):
    return counts.frequencies(counts.ngrams(docs(spark, sf_dir), [], "text", 3), ["gram"])


def ctx_totals_o2(spark, sf_dir):
    grams = counts.frequencies(counts.ngrams(docs(spark, sf_dir), [], "text", 3), ["gram"])
    by = grams.groupBy(F.left("gram", F.lit(2)).alias("ctx"))
    return by.agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("types"), F.sum(2 * F.col("n") - 1).alias("mass"))


def _tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", F.explode(T.words("text")).alias("word"))


def types_tokens(spark, sf_dir):
    return counts.types_tokens(counts.frequencies(_tokens(spark, sf_dir), ["lang", "word"]), ["lang"])


def rank_frequency(spark, sf_dir):
    counted = counts.frequencies(_tokens(spark, sf_dir), ["word"])
    return counts.dense_ids(counted, [F.desc("n"), F.asc("word")], "rank", 1)


def vocab_ids(spark, sf_dir):
    """Words numbered from 0 in the order of their first place."""
    placed = docs(spark, sf_dir).select("doc_id", F.posexplode(T.words("text")).alias("pos", "word"))
    first = placed.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    return counts.dense_ids(first, [F.asc("first.doc_id"), F.asc("first.pos")], "id").select("word", "id", "n")


def word_nonword(spark, sf_dir):
    pairs = docs(spark, sf_dir).select(F.explode(T.alternation("text")).alias("p")).select("p.non_word", "p.word")
    return counts.frequencies(pairs, ["non_word", "word"])


def char_class_profile(spark, sf_dir):
    names = ["alpha", "digit", "punct", "space", "upper", "vowel", "consonant", "ascii"]
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.length("text").alias("length"), F.octet_length("text").alias("n_bytes"), *[T.count_class("text", T.CLASSES[c]).alias(c) for c in names])


def script_ratio(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.round(T.ratio("text", T.MALAYALAM), 6).alias("malayalam"), F.round(T.ratio("text", T.LATIN), 6).alias("latin"))


def doc_filter_stats(spark, sf_dir):
    """The corpus builder's counters: short texts, those kept as Malayalam, mixed ones."""
    rows = docs(spark, sf_dir).where("text IS NOT NULL")
    stripped = F.regexp_replace("text", f"^[{T.WS}]+|[{T.WS}]+$", "")
    ml, latin = T.ratio("text", T.MALAYALAM), T.ratio("text", T.LATIN)
    flags = rows.select("source", (F.length(stripped) < 100).alias("short"), (ml >= 0.3).alias("native"), (F.length(T.clean_malayalam("text", wide=True)) > 50).alias("long"), ((ml > 0.1) & (latin > 0.1)).alias("both"))
    return flags.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("short").alias("skipped"), F.count_if(~F.col("short") & F.col("native") & F.col("long")).alias("processed"), F.count_if(~F.col("short") & F.col("both")).alias("mixed")
    )


def clean_text(spark, sf_dir):
    return lines(spark, sf_dir).where("malayalam_lines IS NOT NULL").select("line_id", T.clean_malayalam("malayalam_lines").alias("narrow"), T.clean_malayalam("malayalam_lines", wide=True).alias("wide"))


def transliterate(spark, sf_dir):
    return lines(spark, sf_dir).select("line_id", T.transliterate("malayalam_lines").alias("latin"))


def spacing_variants(spark, sf_dir):
    """The four spacings of the whole texts."""
    rows = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.inline(T.spacing_variants("text")))
    w = T.words("variant")
    return rows.select(
        "doc_id", "spacing", F.length("variant").alias("length"), F.size(w).alias("word_count"), F.round(F.coalesce(F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), F.size(w)), F.lit(0.0)), 6).alias("avg_word_length"),
        T.count_class("variant", " ").alias("spaces"), F.md5(F.col("variant").cast("binary")).alias("digest"),
    )


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the native and the romanised corpus: line_id, corpus, text."""
    rows = lines(spark, sf_dir).select("line_id", F.inline(F.array(F.struct(F.lit("native").alias("corpus"), F.col("malayalam_lines").alias("text")), F.struct(F.lit("romanised").alias("corpus"), F.col("transliterated_lines").alias("text")))))
    return rows.where("text IS NOT NULL")


def train_test_split(spark, sf_dir):
    """Lines of both corpora, a fifth of each as test set by a seeded shuffle."""
    return counts.seeded_split(corpora(spark, sf_dir), "corpus", "line_id").select("line_id", "corpus", "split")


def segmentation_sample(spark, sf_dir):
    """The first thousand signs of each corpus without their spaces: a sample of fixed size, the feature of the reference."""
    out = None
    for name in ("native", "romanised"):
        # a line and its break have at least one sign, so a thousand lines are enough
        first = corpora(spark, sf_dir).where(F.col("corpus") == name).orderBy("line_id").limit(1000)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "")
        one = first.agg(text.alias("text")).select(F.lit(name).alias("corpus"), F.replace(F.left("text", F.lit(1000)), F.lit(" "), F.lit("")).alias("sample"))
        out = one if out is None else out.unionByName(one)
    return out


def phone_keys(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.md5(T.phone_keys("text").cast("binary")).alias("digest"), F.length(T.phone_keys("text")).alias("length"))


def text_edits(spark, sf_dir):
    """Places, order and edits of the documents' texts: those that keep all other signs where they are, and those that don't."""
    t = F.col("text")
    digest = lambda c: F.md5(c.cast("binary"))
    return docs(spark, sf_dir).where("text IS NOT NULL").select(
        "doc_id", (F.instr("text", "a") - 1).alias("first_a"), T.last_place("text", "a").alias("last_a"), (F.instr("text", "the ") - 1).alias("first_the"), T.compared(F.left(t, F.lit(1)), F.lit("m")).alias("to_m"), T.compared(F.lit(T.SENTINEL), t).alias("sentinel_to_text"),
        digest(T.replace_alike(t, "the")).alias("nulls"), digest(T.replace_alike(t, "the", "THE")).alias("alike"), digest(T.overwrite(t, 20, F.lit("xyz"), "_")).alias("overwritten"), digest(F.substr(t, F.lit(3), F.lit(7))).alias("part"), F.format_string("%05d|%s", F.length(t), F.left(t, F.lit(3))).alias("formatted"),
        F.regexp_extract("text", "([0-9]+)", 1).try_cast("bigint").alias("first_number"), digest(T.to_upper_ascii(t)).alias("upper"), digest(T.to_lower_ascii(t)).alias("lower"),
    )


def word_id_stream(spark, sf_dir):
    """Each document as the stream of its words' ids, which are those of vocab_ids; from every id its word is found again."""
    known = vocab_ids(spark, sf_dir).select("word", "id")
    placed = docs(spark, sf_dir).select("doc_id", F.posexplode(T.words("text")).alias("pos", "word")).join(known, "word")
    back = placed.select("doc_id", "pos", "id").join(known, "id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "word"))), lambda x: F.concat_ws(":", x["id"].cast("string"), x["word"])), " ")  # a document's words
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.md5(listed.cast("binary")).alias("digest"))


def zipped_words(spark, sf_dir):
    """Words of both fields of a line side by side, up to the end of the shorter one: how many are the transliteration of their partner."""
    rows = lines(spark, sf_dir).select(T.words(T.transliterate("malayalam_lines")).alias("a"), T.words("transliterated_lines").alias("b"), "malayalam_lang")
    n = F.least(F.size("a"), F.size("b"))
    pairs = F.arrays_zip(F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(1), n).alias("b"))
    each = rows.where("a IS NOT NULL AND b IS NOT NULL").select("malayalam_lang", F.inline(pairs))
    return each.groupBy("malayalam_lang").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("accuracy"))


def words_and_tags(spark, sf_dir):
    """Romanised lines as ASCII words with the sign behind them as a tag: how often each tag stands behind how long a word."""
    pairs = lines(spark, sf_dir).select(F.explode(T.words_and_tags("transliterated_lines")).alias("p"))
    return pairs.groupBy("p.tag", F.least(F.length("p.word"), F.lit(20)).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def word_types(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.size(T.word_types("text")).alias("types"), F.md5(F.array_join(T.word_types("text"), " ").cast("binary")).alias("digest"))


def combined_corpus(spark, sf_dir):
    """Lines of the native, the romanised and the mixed corpora, by source; mixed are those with more than a tenth of either script."""
    rows = lines(spark, sf_dir)
    one = lambda c, name: rows.where(f"{c} IS NOT NULL").select("source_name", F.lit(name).alias("corpus"), F.col(c).alias("line"))
    both = one("malayalam_lines", "native").unionByName(one("transliterated_lines", "romanised"))
    mixed = (T.ratio("line", T.MALAYALAM) > 0.1) & (T.ratio("line", T.LATIN) > 0.1)
    all_ = both.select("source_name", "line", F.explode(F.when(mixed, F.array("corpus", F.lit("mixed"))).otherwise(F.array("corpus"))).alias("corpus"))
    return all_.groupBy("source_name", "corpus").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_symbols"))


def set_measures(spark, sf_dir):
    """Nations of customers and of suppliers as sets."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("name"), F.col("c_nationkey").alias("member"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("name"), F.col("s_nationkey").alias("member"))
    return sets.pairwise(sets.collect_sets(a.unionByName(b), "name", "member"), "name", "customer", "supplier")


def tuple_query(spark, sf_dir):
    pairs = sets.as_pairs(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"])
    return sets.query(pairs, "c_custkey", ["c_mktsegment=BUILDING", "c_nationkey=7"])


def cumulative_freq(spark, sf_dir):
    counted = counts.frequencies(table(spark, sf_dir, "part").select(F.col("p_size").alias("sym")), ["sym"])
    return counts.cumulative(counted.withColumn("g", F.lit(1)), ["g"], "sym").drop("g")


def sss_codelength(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.max(T.sss_bits("p_size", 1, 2, 9)).alias("bits"))


#: Longest runs of the measures of shared substrings.
LONGEST = 9


def shared_ngrams(spark, sf_dir):
    """For each script and length: types of the test split, how many of them the train split has, and the running measures."""
    rows = table(spark, sf_dir, "test_sets").where("text IS NOT NULL").select(F.split_part("split_name", F.lit("_"), F.lit(1)).alias("script"), F.col("split_name").endswith("_test").alias("test"), "text")
    return counts.shared_runs(spread(rows), "script", "test", "text", LONGEST)


_WORDS = f"list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '')"
_CHARS = "SELECT doc_id, substr(text, i::INT, {n}) AS gram FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - {m})) AS i FROM documents WHERE text IS NOT NULL)"


def _count(column: str, chars: str) -> str:
    return f"(length({column}) - length(regexp_replace({column}, '[{chars}]', '', 'g')))"


def _ratio(chars: str) -> str:
    return f"coalesce({_count('text', chars)}::DOUBLE / nullif(length(text) - {_count('text', _WS)}, 0), 0.0)"


def _clean(column: str, wide: bool) -> str:
    out = f"regexp_replace({column}, '[^{_ML}{_WS}.,!?;:{'()-' if wide else ''}]', ' ', 'g')"
    if wide:
        return f"regexp_replace(regexp_replace({out}, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '[{_WS}]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[{_WS}]+', ' ', 'g'))"


_LINES = "(SELECT line_id, any_value(malayalam_lines) AS malayalam_lines, any_value(transliterated_lines) AS transliterated_lines, any_value(source_name) AS source_name FROM evaluation GROUP BY line_id)"
_CORPORA = "(SELECT line_id, 'native' AS corpus, malayalam_lines AS text FROM " + _LINES + " WHERE malayalam_lines IS NOT NULL UNION ALL SELECT line_id, 'romanised', transliterated_lines FROM " + _LINES + " WHERE transliterated_lines IS NOT NULL)"


def _transliterated(column: str) -> str:
    """T.transliterate without looking ahead: signs of their own stand for the vowel that may follow, and go before a mark."""
    vowel, after, kept = "\ue010", "\ue012", "\ue011"
    sure = lambda t: "'" + t.replace("'", "''") + "'"
    out = column
    for pair, one in {**{p: m for p, (m, _) in T.LIGATURES.items()}, **T.TWO_PART, "ം": kept}.items():
        out = f"replace({out}, {sure(pair)}, {sure(one)})"
    out = f"regexp_replace({out}, '([{T.HOLDS_A}])', '\\1{vowel}', 'g')"
    out = f"regexp_replace({out}, '([\ue000\ue001])', '\\1{after}', 'g')"
    out = f"regexp_replace({out}, '[{vowel}{after}](\\p{{M}})', '\\1', 'g')"
    out = f"regexp_replace({out}, '{after}$', '')"
    out = f"regexp_replace({out}, '[{vowel}{after}]', 'a', 'g')"
    out = f"replace({out}, '{kept}', 'ം')"
    out = f"regexp_replace({out}, {sure(T.VIRAMA + '([' + T.WORD_ENDS + ']|$)')}, 'ŭ\\1', 'g')"
    for old, new in {T.VIRAMA: "", **dict(T.LIGATURES.values()), **T.LONGER}.items():
        out = f"replace({out}, {sure(old)}, {sure(new)})"
    return f"translate({out}, {sure(''.join(T.PLAIN))}, {sure(''.join(T.PLAIN.values()))})"


_SSS = "CASE WHEN p_size < 2 THEN 2.0 WHEN p_size < 10 THEN 5.0 WHEN p_size < 42 THEN 8.0 WHEN p_size < 170 THEN 11.0 ELSE 13.0 END"

SQL = {
    "symbol_freq": f"SELECT gram AS sym, count(*) AS n FROM ({_CHARS.format(n=1, m=0)}) GROUP BY 1",
    "bigram_counts": f"SELECT gram, count(*) AS n FROM ({_CHARS.format(n=2, m=1)}) GROUP BY 1",
    "trigram_counts": f"SELECT gram, count(*) AS n FROM ({_CHARS.format(n=3, m=2)}) GROUP BY 1",
    "ctx_totals_o2": f"SELECT substr(gram, 1, 2) AS ctx, sum(n)::BIGINT AS occurrences, count(*) AS types, sum(2 * n - 1)::BIGINT AS mass FROM (SELECT gram, count(*) AS n FROM ({_CHARS.format(n=3, m=2)}) GROUP BY 1) GROUP BY 1",
    "types_tokens": f"SELECT lang, count(DISTINCT word) AS types, count(*) AS tokens FROM (SELECT lang, unnest({_WORDS}) AS word FROM documents) GROUP BY 1",
    "rank_frequency": f"SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY 1)",
    "vocab_ids": f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t), f AS (SELECT word, count(*) AS n, min((doc_id, pos)) AS first FROM p GROUP BY 1) SELECT word, row_number() OVER (ORDER BY first) - 1 AS id, n FROM f",
    "word_nonword": "SELECT non_word, word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([^A-Za-z0-9]*)([A-Za-z0-9]+)', 1)) AS non_word, unnest(regexp_extract_all(text, '([^A-Za-z0-9]*)([A-Za-z0-9]+)', 2)) AS word FROM documents) GROUP BY 1, 2",
    "char_class_profile": "SELECT doc_id, length(text) AS length, strlen(text) AS n_bytes, " + ", ".join(f"{_count('text', T.CLASSES[c])} AS {c}" for c in ["alpha", "digit", "punct", "space", "upper", "vowel", "consonant", "ascii"]).replace("AS ascii", 'AS "ascii"') + " FROM documents WHERE text IS NOT NULL",
    "script_ratio": f"SELECT doc_id, round({_ratio(_ML)}, 6) AS malayalam, round({_ratio('A-Za-z')}, 6) AS latin FROM documents WHERE text IS NOT NULL",
    "doc_filter_stats": f"WITH f AS (SELECT source, length(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) < 100 AS short, {_ratio(_ML)} AS ml, {_ratio('A-Za-z')} AS lat, length({_clean('text', True)}) > 50 AS long FROM documents WHERE text IS NOT NULL) "
    "SELECT source, count(*) AS total, count(*) FILTER (WHERE short) AS skipped, count(*) FILTER (WHERE NOT short AND ml >= 0.3 AND long) AS processed, count(*) FILTER (WHERE NOT short AND ml > 0.1 AND lat > 0.1) AS mixed FROM f GROUP BY 1",
    "clean_text": f"SELECT line_id, {_clean('malayalam_lines', False)} AS narrow, {_clean('malayalam_lines', True)} AS wide FROM {_LINES} WHERE malayalam_lines IS NOT NULL",
    "train_test_split": f"SELECT line_id, corpus, CASE WHEN row_number() OVER (PARTITION BY corpus ORDER BY md5('7:' || line_id), line_id) <= floor(count(*) OVER (PARTITION BY corpus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM {_CORPORA}",
    "segmentation_sample": f"SELECT corpus, replace(left(string_agg(text || chr(10), '' ORDER BY line_id), 1000), ' ', '') AS sample FROM {_CORPORA} GROUP BY 1",
    "phone_keys": r"WITH k AS (SELECT doc_id, '   ' || translate(regexp_replace(text, '[^A-Za-z .,\n]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(10), '2223334445556667777888999922233344455566677778889999 ') AS t FROM documents WHERE lang = 'en') SELECT doc_id, md5(t) AS digest, length(t) AS length FROM k",
    "text_edits": "SELECT doc_id, instr(text, 'a') - 1 AS first_a, CASE WHEN instr(text, 'a') > 0 THEN length(text) - instr(reverse(text), 'a') END AS last_a, instr(text, 'the ') - 1 AS first_the, CASE WHEN left(text, 1) < 'm' THEN -1 WHEN left(text, 1) > 'm' THEN 1 ELSE 0 END AS to_m, CASE WHEN length(text) > 0 AND ord(text) = 65535 AND length(text) = 1 THEN 0 WHEN length(text) = 0 THEN 1 ELSE -1 END AS sentinel_to_text, "
    "md5(replace(text, 'the', chr(0) || chr(0) || chr(0))) AS nulls, md5(replace(text, 'the', 'THE')) AS alike, md5(left(CASE WHEN length(text) < 20 THEN rpad(text, 20, '_') ELSE text END, 20) || 'xyz' || substr(text, 24)) AS overwritten, md5(substr(text, 3, 7)) AS part, "
    "lpad(length(text)::VARCHAR, greatest(5, length(length(text)::VARCHAR))::INT, '0') || '|' || left(text, 3) AS formatted, try_cast(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS first_number, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS upper, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower FROM documents WHERE text IS NOT NULL",
    "word_id_stream": f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t), v AS (SELECT word, row_number() OVER (ORDER BY min((doc_id, pos))) - 1 AS id FROM p GROUP BY 1) SELECT doc_id, count(*) AS n_words, md5(string_agg(id || ':' || word, ' ' ORDER BY pos)) AS digest FROM p JOIN v USING (word) GROUP BY 1",
    "zipped_words": f"WITH w AS (SELECT malayalam_lang, {_WORDS.replace('text', 'x')} AS a, {_WORDS.replace('text', 'y')} AS b FROM (SELECT malayalam_lang, {_transliterated('malayalam_lines')} AS x, transliterated_lines AS y FROM (SELECT line_id, any_value(malayalam_lines) AS malayalam_lines, any_value(transliterated_lines) AS transliterated_lines, any_value(malayalam_lang) AS malayalam_lang FROM evaluation GROUP BY line_id)) WHERE x IS NOT NULL AND y IS NOT NULL), "
    "z AS (SELECT malayalam_lang, unnest(a[1:least(len(a), len(b))]) AS a, unnest(b[1:least(len(a), len(b))]) AS b FROM w) SELECT malayalam_lang, count(*) AS pairs, count(*) FILTER (WHERE a = b) AS same, round(avg((a = b)::INT), 6) AS accuracy FROM z GROUP BY 1",
    "words_and_tags": f"SELECT tag, least(length(word), 20)::INT AS length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(transliterated_lines, '([\\x{{0}}-\\x{{7F}}]+)([^\\x{{0}}-\\x{{7F}}])', 1)) AS word, unnest(regexp_extract_all(transliterated_lines, '([\\x{{0}}-\\x{{7F}}]+)([^\\x{{0}}-\\x{{7F}}])', 2)) AS tag FROM {_LINES}) GROUP BY 1, 2",
    "word_types": f"WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[{T.CLASSES['punct']}]', '', 'g'), '[{_WS}]+'), lambda w: w <> ''))) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(t) AS types, md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM w",
    "combined_corpus": f"WITH b AS (SELECT source_name, corpus, line AS text FROM (SELECT source_name, 'native' AS corpus, malayalam_lines AS line FROM {_LINES} UNION ALL SELECT source_name, 'romanised', transliterated_lines FROM {_LINES}) WHERE line IS NOT NULL) "
    f"SELECT source_name, corpus, count(*) AS n_lines, sum(length(text))::BIGINT AS n_symbols FROM (FROM b UNION ALL SELECT source_name, 'mixed', text FROM b WHERE {_ratio(_ML)} > 0.1 AND {_ratio('A-Za-z')} > 0.1) GROUP BY 1, 2",
    "set_measures": "WITH a AS (SELECT DISTINCT c_nationkey AS m FROM customer), b AS (SELECT DISTINCT s_nationkey AS m FROM supplier) SELECT (SELECT count(*) FROM (SELECT m FROM a UNION SELECT m FROM b)) AS n_union, (SELECT count(*) FROM (SELECT m FROM a INTERSECT SELECT m FROM b)) AS n_both, (SELECT list_sort(list(m)) FROM a) = (SELECT list_sort(list(m)) FROM b) AS equal",
    "tuple_query": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    "cumulative_freq": "SELECT sym, n, (sum(n) OVER (ORDER BY sym))::BIGINT AS upper, (sum(n) OVER (ORDER BY sym) - n)::BIGINT AS lower FROM (SELECT p_size AS sym, count(*) AS n FROM part GROUP BY 1)",
    "sss_codelength": f"SELECT p_size, count(*) AS n, max({_SSS})::DOUBLE AS bits FROM part GROUP BY 1",
    "shared_ngrams": "WITH t AS (SELECT split_part(split_name, '_', 1) AS script, split_name LIKE '%\\_test' ESCAPE '\\' AS test, text FROM test_sets WHERE text IS NOT NULL), z AS ("
    + " UNION ALL ".join(
        f"SELECT script, {n} AS size, count(*) AS types, count(*) FILTER (WHERE m > 0) AS shared_types, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (WHERE m > 0), 0)::BIGINT AS shared_tokens FROM (SELECT script, gram, count(*) FILTER (WHERE test) AS n, count(*) FILTER (WHERE NOT test) AS m FROM "
        f"(SELECT script, test, substr(text, i::INT, {n}) AS gram FROM (SELECT *, unnest(generate_series(1, length(text) - {n - 1})) AS i FROM t)) GROUP BY 1, 2) WHERE n > 0 GROUP BY 1"
        for n in range(1, LONGEST + 1)
    )
    + ") SELECT *, (sum(shared_tokens) OVER (PARTITION BY script ORDER BY size DESC))::BIGINT AS r, (sum(shared_tokens) OVER (PARTITION BY script ORDER BY size))::BIGINT AS r1 FROM z",
    "transliterate": f"SELECT line_id, {_transliterated('malayalam_lines')} AS latin FROM {_LINES}",
}
QUERIES = [
    symbol_freq, bigram_counts, trigram_counts, ctx_totals_o2, types_tokens, rank_frequency, vocab_ids, word_nonword, char_class_profile, script_ratio, doc_filter_stats, clean_text, transliterate, spacing_variants, train_test_split, segmentation_sample, text_edits, word_id_stream, zipped_words, words_and_tags, phone_keys,
    word_types, combined_corpus, set_measures, tuple_query, cumulative_freq, sss_codelength, shared_ngrams,
]
_BARE = "regexp_replace(text, '[" + _WS + "]+', '', 'g')"
SQL["spacing_variants"] = (
    f"WITH b AS (SELECT doc_id, text AS cut, {_BARE} AS bare FROM documents WHERE text IS NOT NULL), "
    "v AS (SELECT doc_id, 'original' AS spacing, cut AS variant FROM b UNION ALL SELECT doc_id, 'no_spaces', bare FROM b "
    "UNION ALL SELECT doc_id, 'char_spacing', rtrim(regexp_replace(bare, '(?s)(.)', '\\1 ', 'g'), ' ') FROM b "
    "UNION ALL SELECT doc_id, 'random_spacing', left(bare, 5) || ' ' || rtrim(regexp_replace(substr(bare, 6), '(?s)(.{4})', '\\1 ', 'g'), ' ') FROM b WHERE length(bare) > 10), "
    f"w AS (SELECT *, list_filter(regexp_split_to_array(variant, '[{_WS}]+'), lambda w: w <> '') AS words FROM v) "
    "SELECT doc_id, spacing, length(variant) AS length, len(words) AS word_count, round(coalesce(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / nullif(len(words), 0), 0.0), 6) AS avg_word_length, "
    f"{_count('variant', ' ')} AS spaces, md5(variant) AS digest FROM w"
)
