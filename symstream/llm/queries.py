"""The queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symstream.sources.tables import table

from . import abusive, canonical, duplicates, encoding, garbled, langid, mixing, overlap, sentences

FIELDS = ("malayalam_lines", "transliterated_lines")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore(table(spark, sf_dir, "evaluation"), "line_id", list(FIELDS)).select("line_id", "field_name").distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore(table(spark, sf_dir, "evaluation"), "line_id", list(FIELDS)).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, sf_dir, "evaluation"), "line_id", "malayalam_lines")


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, sf_dir, "evaluation"), "line_id", "malayalam_lines")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line that others read like: its class, with the numbers of lines and of spellings in it."""
    found = canonical.look_alike_classes(table(spark, sf_dir, "evaluation"), "line_id", "malayalam_lines")
    held = found.groupBy("form").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("spelling").alias("spellings"), F.min("line_id").alias("class_id"))
    return found.join(held, "form").select("line_id", "class_id", "lines", "spellings")


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_sets")
    return rows.withColumn("script", F.regexp_extract("split_name", "^(.*)_(test|train)$", 1)).withColumn("is_test", F.col("split_name").endswith("_test"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_records(_split_records(spark, sf_dir), "rec_id", "text", "script", "is_test")
    return pairs.select(F.least("k_e", "k_t").alias("rec_id_a"), F.greatest("k_e", "k_t").alias("rec_id_b")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and source: its records, and how many of them overlap, exactly or nearly, with the other split."""
    rows = _split_records(spark, sf_dir)
    pairs, members = overlap.overlaps(rows, "rec_id", "text", "script", "is_test")
    sides = pairs.select("grp", F.col("cls_e").alias("cls"), F.lit(True).alias("evaluation"), "distance").unionByName(
        pairs.select("grp", F.col("cls_t").alias("cls"), F.lit(False).alias("evaluation"), "distance")
    )
    least = sides.groupBy("grp", "cls", "evaluation").agg(F.min("distance").alias("distance"))
    hit = members.join(least, ["grp", "cls", "evaluation"]).select(F.col("k").alias("rec_id"), "distance")
    return (
        rows.select("rec_id", "split_name", "source_name")
        .join(hit, "rec_id", "left")
        .groupBy("split_name", "source_name")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("distance") == 0).alias("exact"), F.count_if(F.col("distance") > 0).alias("near"))
    )


PAYLOAD = ("malayalam_lines", "transliterated_lines", "file_path", "lang")


def _hashed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "evaluation": duplicates.hash_fields(table(spark, sf_dir, "evaluation"), "line_id", FIELDS),
        "raw_records": duplicates.hash_json(table(spark, sf_dir, "raw_records"), "raw_id", "payload", PAYLOAD),
    }


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [duplicates.copies_of(h).select(F.lit(name).alias("table_name"), "keep_id", "copy_id") for name, h in _hashed(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [duplicates.collapse(h).select(F.lit(name).alias("table_name"), "keep_id", "copies") for name, h in _hashed(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


LABEL_OF = {"malayalam_lines": "malayalam_lang", "transliterated_lines": "transliterated_lang"}
#: Labels of the native field know no romanised languages.
ALLOWED_OF = {"malayalam_lines": ("ml", "en", "hi", "ta", "zh"), "transliterated_lines": ("ml-latn", *(x for x in langid.LANGS if x != "ml-latn"))}


def _languages(spark: SparkSession, sf_dir: str, stretches: bool = False) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "evaluation"), "line_id", LABEL_OF, ALLOWED_OF, stretches)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_labels(_languages(spark, sf_dir)).select("line_id", "field_name", "lang").distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).distinct()


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, stretches=True).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "evaluation"), "line_id", "malayalam_lines", corpus_cols=FIELDS).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text isn't what their ids decode to: none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encoding.decode(encoding.encode(rows, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "back")
    return rows.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = encoding.count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mixing.mixture(counted, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "source")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive.score_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "abusive", table(spark, sf_dir, "flag_terms"), "term"
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where(F.col("score") >= abusive.LEAST).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its documents, those with abusive content, and their share."""
    scored = table(spark, sf_dir, "documents").select("doc_id", "source").join(_scores(spark, sf_dir), "doc_id")
    found = F.count_if(F.col("score") >= abusive.LEAST)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), found.alias("abusive"), (found / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_canonical, p2_classes, p3_found, p3_report, p4_found, p4_collapsed, p5_found, p5_languages, p5_stretches, p6_found, p7_ids, p7_round_trip, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates)}


_FORM = "regexp_replace(lower({c}), '[\\p{{P}}\\p{{Z}}\\p{{C}}\\p{{S}}]+', '', 'g')"
_KEY = " || chr(31) || ".join(["coalesce('1' || {}, '0')"] * 2)
_SAME = {
    "evaluation": "SELECT line_id AS k, " + _KEY.format(*(_FORM.format(c=c) for c in FIELDS)) + " AS h FROM evaluation",
    "raw_records": "SELECT raw_id AS k, " + " || chr(31) || ".join(f"coalesce('1' || {_FORM.format(c=f'(j ->> {chr(39)}$.{c}{chr(39)})')}, '0')" for c in PAYLOAD) + " AS h FROM (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_records WHERE payload IS NOT NULL) WHERE json_type(j) = 'OBJECT'",
}
_RECORDS = " UNION ALL ".join(f"SELECT '{name}' AS table_name, k, h FROM (SELECT DISTINCT k, h FROM ({sql}))" for name, sql in _SAME.items())


def oracle_sql() -> dict[str, str]:
    form = canonical.canonical_sql("malayalam_lines")
    forms = f"WITH f AS (SELECT DISTINCT line_id, malayalam_lines AS t, {form} AS c FROM evaluation WHERE malayalam_lines IS NOT NULL), g AS (SELECT * FROM f WHERE regexp_matches(c, '[^\\s\\x01-\\x20\\x{{0085}}\\x{{2028}}\\x{{2029}}]'))".replace("{{", "{").replace("}}", "}")
    return {
        "p2_found": f"{forms} SELECT a.line_id AS line_id_a, b.line_id AS line_id_b FROM g a JOIN g b ON a.c = b.c AND a.t <> b.t AND a.line_id < b.line_id",
        "p2_canonical": f"SELECT line_id, malayalam_lines, {form} AS canonical FROM evaluation",
        "p2_classes": f"{forms}, h AS (SELECT c, min(line_id) AS class_id, count(*) AS lines, count(DISTINCT t) AS spellings FROM g GROUP BY 1) SELECT line_id, class_id, lines, spellings FROM g JOIN h USING (c) WHERE spellings > 1",
        "p4_found": f"WITH r AS ({_RECORDS}) SELECT * FROM (SELECT table_name, min(k) OVER (PARTITION BY table_name, h) AS keep_id, k AS copy_id FROM r) WHERE keep_id <> copy_id",
        "p4_collapsed": f"WITH r AS ({_RECORDS}) SELECT table_name, min(k) AS keep_id, count(*) AS copies FROM r GROUP BY table_name, h",
    }
