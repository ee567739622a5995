"""Visually identical text with different characters (problem 2).

Lines are brought to one form by SQL that DuckDB runs inside the Arrow batches of each partition: compatibility forms,
invisible characters and look-alikes are mapped by ``translate``, ``regexp_replace`` and ``nfc_normalize``. Only a hash of
the form and one of the stored text are shuffled to find lines that read alike. One pass of DuckDB makes both; they are kept before
they are used twice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut

# --- fixed values: characters that look like others -------------------------------------------------------------------
#: Cyrillic and Greek letters drawn like Latin ones, and the Latin letters.
LOOK_ALIKE = (
    ("аеорсухіѕјһԁԛԝѵӏ", "aeopcyxisjhdqwvl"),
    ("АВЕКМНОРСТУХІЅЈԌԚԜ", "ABEKMHOPCTYXISJGQW"),
    ("οανικρυ", "oavikpu"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
)
#: Spaces of any width, each the same single gap.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters that are not drawn.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
#: A Malayalam consonant, the virama and a zero-width joiner are the older spelling of the chillu.
CHILLU = (("ണ", "ൺ"), ("ന", "ൻ"), ("ര", "ർ"), ("ല", "ൽ"), ("ള", "ൾ"), ("ക", "ൿ"))
#: Malayalam sequences drawn like one letter or sign; those of the Unicode standard are composed by NFC.
DRAWN_ALIKE = (("ഇൗ", "ഈ"), ("ഉൗ", "ഊ"), ("എെ", "ഐ"), ("ഒാ", "ഓ"), ("ഒൗ", "ഔ"), ("െെ", "ൈ"), ("ൻ്റ", "ന്റ"))
#: The figure four and the chillu of ra are drawn alike.
FOUR, CHILLU_RA, MALAYALAM_DIGITS = "൪", "ർ", "൦൧൨൩൪൫൬൭൮൯"
#: Blocks of narrow and wide forms, of ligatures of Latin letters, and of Roman figures, which are drawn like the signs they stand for.
FORMS = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0x2160, 0x217F))
# ----------------------------------------------------------------------------------------------------------------------


def _forms() -> dict[str, str]:
    """The signs of FORMS and what they stand for."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in FORMS for c in range(a, b + 1)}
    return {a: b for a, b in pairs.items() if a != b and a not in "\u3164\uffa0"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """A DuckDB expression of the one form of a text column."""
    single = {a: b for a, b in _forms().items() if len(b) == 1}
    several = {a: b for a, b in _forms().items() if len(b) > 1}
    of = [SPACES, *(a for a, _ in LOOK_ALIKE), *single]
    to = [" " * len(SPACES), *(b for _, b in LOOK_ALIKE), *single.values()]
    out = column
    for consonant, chillu in CHILLU:  # an invisible character may stand before the joiner
        out = f"replace({out}, {_quoted(consonant + chr(0xD4D) + chr(0x200D))}, {_quoted(chillu)})"
    out = f"regexp_replace({out}, {_quoted(INVISIBLE)}, '', 'g')"
    out = f"translate({out}, {_quoted(''.join(of))}, {_quoted(''.join(to))})"
    whole = "x"
    for form, letters in several.items():
        whole = f"replace({whole}, {_quoted(form)}, {_quoted(letters)})"
    held = _quoted("[" + "".join(several) + "]")
    out = f"list_transform([{out}], lambda x: CASE WHEN regexp_matches(x, {held}) THEN {whole} ELSE x END)[1]"
    out = f"nfc_normalize({out})"
    for drawn, one in DRAWN_ALIKE:
        out = f"replace({out}, {_quoted(drawn)}, {_quoted(one)})"
    # next to other Malayalam digits it is a figure, elsewhere the letter
    digits = MALAYALAM_DIGITS.replace(FOUR, "")
    out = f"regexp_replace({out}, {_quoted(f'([{digits}]){FOUR}')}, {_quoted(chr(92) + '1' + chr(1))}, 'g')"
    out = f"regexp_replace({out}, {_quoted(f'{FOUR}([{digits}])')}, {_quoted(chr(1) + chr(92) + '1')}, 'g')"
    return f"translate({out}, {_quoted(FOUR + chr(1))}, {_quoted(CHILLU_RA + FOUR)})"


def _run(sql: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            con.register("rows_in", rows)
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("rows_in")
    con.close()


def canonical_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and its one form, ``canonical``; null for a null text, blank texts keep their (mapped) blanks.

    Other columns are left out, whatever their names. Repeated rows stay. A narrow map: nothing is shuffled.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    sql = f"SELECT k, t, {canonical_sql('t')} AS c FROM rows_in"
    out = rows.mapInArrow(lambda batches: _run(sql, batches), f"k {kind}, t string, c string")
    return out.select(F.col("k").alias(id_col), F.col("t").alias(text_col), F.col("c").alias("canonical"))


def _hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    kind = rows.schema["k"].dataType.simpleString()
    sql = (
        f"SELECT k, unhex(md5(t)) AS raw, unhex(md5(c)) AS form FROM (SELECT k, t, {canonical_sql('t')} AS c FROM rows_in) "
        r"WHERE regexp_matches(c, '[^\s\x01-\x20\x{0085}\x{2028}\x{2029}]')"
    )
    return rows.mapInArrow(lambda batches: _run(sql, batches), f"k {kind}, raw binary, form binary")


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, form, spelling: a row for each text that another one reads like in other characters; those that read alike share the form.

    Null and blank texts are no case; repeated rows of an id count once. Forms and spellings are hashes of 16 bytes. Which forms have two
    spellings is found on the map side first; a form that very many rows share is split by the adaptive skew join.
    """
    rows = cut(_hashes(df, id_col, text_col))
    mixed = rows.groupBy("form").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most").select("form")
    return rows.join(mixed, "form", "left_semi").distinct().select(F.col("k").alias(id_col), "form", F.col("raw").alias("spelling"))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs a < b of ids whose texts read the same but are stored in different characters: look_alike_classes, expanded at last.

    Texts that are the same characters are no pair.
    """
    kept = look_alike_classes(df, id_col, text_col).select(F.col(id_col).alias("k"), "form", "spelling")
    a = kept.select("form", F.col("k").alias("a"), F.col("spelling").alias("as_a"))
    b = kept.select("form", F.col("k").alias("b"), F.col("spelling").alias("as_b"))
    pairs = a.join(b, "form").where("as_a <> as_b AND a < b")
    return pairs.select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
