"""Readers and writers of the text formats: whole texts, lines, number streams, escaped symbols, judgments, matrices, rules, lists, tuples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", lenient: bool = True) -> DataFrame:
    """(path, text): whole files as UTF-8; lenient drops bytes that are no UTF-8, else such a file fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    decode = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore" if lenient else "strict")), "string")
    return files.select("path", decode("content").alias("text"))


def read_lines(spark: SparkSession, path: str, keep: str = "") -> DataFrame:
    """(path, line_no, text): the lines of files, in order within a file. keep: what stays of a line's end, '' nothing, '\r' a carriage
    return, '\r\n' all of it.
    """
    if keep not in ("", "\r", "\r\n"):
        raise ValueError("nothing, the carriage return or all of the end is kept")
    rows = read_texts(spark, path, "*", True).select("path", F.posexplode(F.split("text", "(?<=\n)" if keep == "\r\n" else "\n")).alias("line_no", "text"))
    return rows if keep else rows.withColumn("text", F.regexp_replace("text", "\r$", ""))


def numbers(text: Column | str) -> Column:
    """Unsigned numbers of up to 63 bits between white space as an array; what is no such number is left out."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, r"\s+"), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))), lambda x: x.isNotNull())


def unescape(text: str) -> list[int]:
    """Symbols of an escaped text: \\\\258\\\\ is symbol 258, two backslashes are one."""
    return [ord("\\") if m.group() == "\\\\" else int(m.group(1)) if m.group(1) else ord(m.group()) for m in re.finditer(r"\\\\|\\(\d+)\\|[\s\S]", text)]


def escape(symbols: list[int]) -> str:
    return "".join("\\\\" if s == 92 else chr(s) if s < 128 else f"\\{s}\\" for s in symbols)


def escaped(text: Column | str) -> Column:
    """unescape of a column."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unescape(t)), "array<int>")(text)


def judgments(lines: DataFrame, column: str = "value") -> DataFrame:
    """(doc, topic) of lines ``doc topic topic ...``."""
    parts = F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")
    return lines.select(parts.alias("p")).where(F.size("p") > 1).select(F.element_at("p", 1).alias("doc"), F.explode(F.slice("p", 2, F.size("p") - 1)).alias("topic")).distinct()


def matrix(lines: DataFrame, column: str = "value") -> DataFrame:
    """(row, column, value) of lines ``value row column``; other lines are left out."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.select(F.get(parts, 1).alias("row"), F.get(parts, 2).alias("column"), F.get(parts, 0).try_cast("double").alias("value"))
    return rows.where("value IS NOT NULL AND `column` IS NOT NULL")


def confusions(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, target, cost) of lines ``freq total source -> target``; the cost is that of the share, in bits."""
    at = lambda i: F.regexp_extract(column, r"^\s*(\d+)\s+(\d+)\s+(.*?)\s*->\s*(.*?)\s*$", i)
    rows = lines.select(at(1).try_cast("double").alias("f"), at(2).try_cast("double").alias("n"), at(3).alias("source"), at(4).alias("target"))
    return rows.where("f > 0 AND n > 0").select("source", "target", (-F.log(2.0, F.col("f") / F.col("n"))).alias("cost"))


def model_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(tag, path) of lines ``tag path``; also of labelled test files."""
    at = lambda i: F.regexp_extract(column, r"^\s*(\S+)\s+(\S.*?)\s*$", i)
    return lines.select(at(1).alias("tag"), at(2).alias("path")).where("tag <> ''")


def alternating(lines: DataFrame, order_col: str, column: str = "value", word_first: bool = True) -> DataFrame:
    """(pos, word, tag) of lines that alternate between words and tags, numbered from 0 without gaps."""
    a, b = ("word", "tag") if word_first else ("tag", "word")
    rows = lines.select((F.floor(F.col(order_col) / 2)).cast("bigint").alias("pos"), (F.col(order_col) % 2).alias("side"), F.col(column).alias("v"))
    return rows.groupBy("pos").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias(a), F.max(F.when(F.col("side") == 1, F.col("v"))).alias(b)).select("pos", "word", "tag")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line for each row; line breaks within a text become blanks."""
    df.where(F.col(column).isNotNull()).select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_escaped(df: DataFrame, column: str, path: str) -> None:
    """One line for each row, with all but ASCII signs and line breaks escaped, so that ``escaped`` gives every text back."""
    line = F.pandas_udf(lambda s: s.map(lambda t: "".join(escape([ord(c)]) if c not in "\n\r" else f"\\{ord(c)}\\" for c in t)), "string")
    df.where(F.col(column).isNotNull()).select(line(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """Lines ``value row column`` of a long matrix, which ``matrix`` reads."""
    df.select(F.concat_ws(" ", F.col("value").cast("string"), F.col("row").cast("string"), F.col("column").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_tuples(pairs: DataFrame, id_col: str, path: str) -> None:
    """A line for each id: the id and its key=attribute pairs, of which there are few."""
    lines = pairs.groupBy(id_col).agg(F.array_sort(F.collect_set("pair")).alias("p"))
    lines.select(F.concat_ws(" ", F.col(id_col).cast("string"), F.array_join("p", " ")).alias("value")).write.mode("overwrite").text(path)


def tuples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, pair) of such lines; pairs without = are left out."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.select(F.get(parts, 0).alias("id"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pair"))
    return rows.where(F.contains("pair", F.lit("=")))


def write_sets(sets: DataFrame, path: str) -> None:
    """(name, members) as lines ``name first step step ...`` of sorted numbers, each as its distance from the one before."""
    steps = F.transform(F.array_sort("members"), lambda x, i: x - F.when(i > 0, F.array_sort("members")[i - 1]).otherwise(0))
    sets.select(F.concat_ws(" ", "name", F.array_join(F.transform(steps, lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def read_sets(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, members) of such lines."""
    parts = F.split(F.trim(column), r"\s+")
    steps = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("bigint"))
    members = F.aggregate(steps, F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))
    return lines.select(F.get(parts, 0).alias("name"), members.alias("members")).where("name <> ''")


def key_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key) of lines of one key each, each once; blank lines are left out."""
    return lines.select(F.trim(column).alias("key")).where("key <> ''").distinct()


def tagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): the columns of each row between tags of their names; null ones are left out, and &, < and > are written as entities."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat_ws("", *[F.concat(F.lit(f"<{c}>"), safe(c), F.lit(f"</{c}>")) for c in columns]).alias("value"))


def without_tags(text: Column | str) -> Column:
    """A text without its tags, entities written out."""
    c = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "<[^<>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c
