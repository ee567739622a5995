"""Frequency tables, dense ids, n-grams and context counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symstream.functions import text as T
from symstream.session import cut


def frequencies(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """How often each key occurs; partial counts before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def dense_ids(df: DataFrame, order: list[Column], name: str = "id", first: int = 0) -> DataFrame:
    """df with a number without gaps by the order, which must be total.

    Rows are range-partitioned and numbered within partitions; only the partitions' sizes are gathered. No task sees all rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    kept = cut(ranged)  # the partition of a row must not change between the two passes
    sizes = sorted((r["__part"], r["count"]) for r in kept.groupBy("__part").count().collect())
    offsets, at = [], first
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    table = kept.sparkSession.createDataFrame(offsets, "__part int, __offset bigint")  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return kept.join(F.broadcast(table), "__part").withColumn(name, inside + F.col("__offset")).drop("__part", "__offset")


def tokens(df: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """One row for each token: the kept columns, pos from 0, token."""
    return df.select(*keep, F.posexplode(words).alias("pos", "token"))


def ngrams(df: DataFrame, keep: list[str], text: str, size: int) -> DataFrame:
    """Every run of ``size`` code points with its position; texts that are shorter give none."""
    chars = T.symbols(text)
    runs = F.transform(F.sequence(F.lit(1), F.size("__c") - size + 1), lambda i: F.array_join(F.slice("__c", i, size), ""))
    return df.withColumn("__c", chars).where(F.size("__c") >= size).select(*keep, F.posexplode(runs).alias("pos", "gram"))


def grams(df: DataFrame, keep: list[str], text: str, order: int, pos: bool = False) -> DataFrame:
    """(keep, gram): each symbol of each text with the up to ``order`` symbols before it; the last sign is the symbol. pos: also its place."""
    runs = F.transform("__c", lambda x, i: F.array_join(F.slice("__c", F.greatest(i - order, F.lit(0)) + 1, F.least(i, F.lit(order)) + 1), ""))
    each = F.posexplode(runs).alias("pos", "gram") if pos else F.explode(runs).alias("gram")
    return df.withColumn("__c", T.symbols(text)).select(*keep, each)


def gram_counts(df: DataFrame, keep: list[str], text: str, order: int) -> DataFrame:
    """(keep, gram, n): each symbol with the up to ``order`` symbols before it in its text, counted; the last sign is the symbol."""
    return frequencies(grams(df, keep, text, order), [*keep, "gram"])


def runs_of(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct grams of some texts, each symbol with the up to ``order`` (at most 3) symbols before it, and how often each occurs."""
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(whole):
        return [], np.zeros(0, np.int64)
    place = np.zeros(0x110000, np.uint64)
    place[whole] = 1
    signs = np.flatnonzero(place)
    if len(signs) > 0xFFFF:  # more signs than 16 bits tell apart: texts are halved, and one alone is counted as it is
        if len(texts) > 1:
            half = len(texts) // 2
            parts = [runs_of(texts[:half], order), runs_of(texts[half:], order)]
            return parts[0][0] + parts[1][0], np.concatenate([n for _, n in parts])
        each = [texts[0][max(0, i - order) : i + 1] for i in range(len(texts[0]))]
        return each, np.ones(len(each), np.int64)
    place[signs] = np.arange(1, len(signs) + 1, dtype=np.uint64)  # 0 is no sign
    ids = place[whole]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = ids.copy()
    for k in range(1, order + 1):
        keys[k:] |= np.where(at[k:] >= k, ids[:-k], np.uint64(0)) << np.uint64(16 * k)
    keys, n = np.unique(keys, return_counts=True)
    parts = (keys[:, None] >> np.array([16 * k for k in range(order, -1, -1)], np.uint64)) & np.uint64(0xFFFF)
    sizes = (parts > 0).sum(axis=1)
    named = signs[parts[parts > 0].astype(np.int64) - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return [named[a:b] for a, b in zip([0, *ends], ends)], n  # noqa: B905


def text_gram_counts(df: DataFrame, key: str, text: str, order: int) -> DataFrame:
    """gram_counts by one string column for orders up to 3: grams are counted by batch before they are rows. Null texts have none."""
    if not 0 <= order <= 3:
        raise ValueError("orders from 0 to 3")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str | None, list[str]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                found, n = runs_of(texts, order)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["key", "gram", "n"])

    counted = rows.mapInArrow(run, "key string, gram string, n bigint")
    return counted.groupBy(F.col("key").alias(key), "gram").agg(F.sum("n").alias("n"))


def gram_length(gram: str, sep: str = "") -> Column:
    """Symbols of a gram. sep: what stands between them where they are words, else each sign is a symbol."""
    return F.size(F.split(F.col(gram), sep)) if sep else F.length(gram)


def gram_context(gram: str, k: str, sep: str = "") -> Column:
    """The k symbols before the last one."""
    if not sep:
        return F.expr(f"substring({gram}, length({gram}) - {k}, {k})")
    parts = F.split(F.col(gram), sep)
    return F.array_join(F.slice(parts, F.size(parts) - F.col(k), F.col(k)), sep)


def gram_symbol(gram: str, sep: str = "") -> Column:
    """The last symbol."""
    return F.element_at(F.split(F.col(gram), sep), -1) if sep else F.right(gram, F.lit(1))


def context_counts(grams: DataFrame, keep: list[str], order: int, sep: str = "") -> DataFrame:
    """(keep, k, ctx, sym, n) for contexts of every length up to ``order``, from gram_counts: one more pass over the counted grams."""
    each = grams.select(*keep, "gram", "n", F.explode(F.sequence(F.lit(0), F.least(gram_length("gram", sep) - 1, F.lit(order)))).alias("k"))
    parts = each.select(*keep, "k", gram_context("gram", "k", sep).alias("ctx"), gram_symbol("gram", sep).alias("sym"), "n")
    return parts.groupBy(*keep, "k", "ctx", "sym").agg(F.sum("n").alias("n"))


def types_tokens(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))


def cumulative(counted: DataFrame, by: list[str], symbol: str) -> DataFrame:
    """Lower and upper bounds of the symbols' ranges in the order of the symbols, within each group."""
    upper = F.sum("n").over(Window.partitionBy(*by).orderBy(symbol).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("n"))


def symbol_at(ranges: DataFrame, target: Column, symbol: str) -> Column:
    """The symbol in whose range a target falls."""
    return F.min(F.when((F.col("lower") <= target) & (target < F.col("upper")), F.col(symbol)))


def seeded_order(id_col: str, seed: int) -> Column:
    """A shuffle that is the same whenever it is made: by a digest of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def seeded_split(df: DataFrame, by: str, id_col: str, ratio: float = 0.2, seed: int = 7) -> DataFrame:
    """df with ``split``: 'test' for the whole part of ratio of each value of by, in a seeded shuffle of the ids, else 'train'.

    Ids are unique within a value. Rows are numbered by ranges, so no task sees all rows of a value.
    """
    from .evaluate import running

    ranked = running(df.withColumn("__order", seeded_order(id_col, seed)), by, ["__order", id_col], F.lit(True))
    sizes = df.groupBy(F.col(by).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(sizes, F.col(by).eqNullSafe(F.col("__k")))
    return joined.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("__n") * F.lit(ratio)), "test").otherwise("train")).drop("__order", "__k", "__n", "rank", "hits")


def shared_runs(df: DataFrame, by: str, side: str, text: str, longest: int) -> DataFrame:
    """(by, size, types, shared_types, tokens, shared_tokens, r, r1): runs of up to ``longest`` symbols of the texts of one side (side true)
    that the other side's texts have too. r adds up shared_tokens over this size and all longer ones, r1 over this and all shorter ones.

    Runs of the full length (shorter at the ends) are counted first; all others are their beginnings, so texts are read once, and only
    distinct runs are cut into beginnings.
    """
    runs = F.transform("__c", lambda x, i: F.array_join(F.slice("__c", i + 1, F.lit(longest)), ""))
    rows = df.where(F.col(text).isNotNull()).withColumn("__c", T.symbols(text)).select(F.col(by).alias("by"), F.col(side).alias("side"), F.explode(runs).alias("run"))
    whole = rows.groupBy("by", "run").agg(F.count_if("side").alias("n"), F.count_if(~F.col("side")).alias("m"))
    parts = whole.select("by", "n", "m", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("size")).select("by", "size", F.left("run", F.col("size")).alias("run"), "n", "m")
    counted = parts.groupBy("by", "size", "run").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0")
    out = counted.groupBy("by", "size").agg(F.count(F.lit(1)).alias("types"), F.count_if(F.col("m") > 0).alias("shared_types"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("m") > 0, F.col("n")).otherwise(0)).alias("shared_tokens"))
    w = Window.partitionBy("by").orderBy("size")  # a row for each size
    every = Window.partitionBy("by").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("r", F.sum("shared_tokens").over(every)).withColumn("r1", F.sum("shared_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("by", by)
