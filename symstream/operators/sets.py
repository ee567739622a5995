"""Sets of numbers, and tuples of key=attribute pairs with conjunctive queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_sets(df: DataFrame, name: str, member: str) -> DataFrame:
    """(name, members): sorted distinct members; for sets of bounded size. Larger ones stay as rows."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(member)).alias("members"))


def pairwise(sets: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Cardinalities of the union and the intersection of two sets, and whether they are equal; a set that isn't there is empty.

    Members are counted by which sets hold them, so the sets may be of any size, as arrays (members) or in pieces of them.
    """
    rows = sets.where(F.col(name).isin(a, b)).select(F.col(name).alias("s"), F.explode("members").alias("m"))
    held = rows.groupBy("m").agg(F.bool_or(F.col("s") == a).alias("x"), F.bool_or(F.col("s") == b).alias("y"))
    both = F.count_if(F.col("x") & F.col("y"))
    return held.agg(F.count(F.lit(1)).alias("n_union"), both.alias("n_both"), (F.count(F.lit(1)) == both).alias("equal"))


def as_pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, pair): key=attribute for each non-null column."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])
    return df.select(id_col, F.explode(F.array_compact(pairs)).alias("pair"))


def query(pairs: DataFrame, id_col: str, wanted: list[str]) -> DataFrame:
    """Ids that have all wanted pairs. One pass: a row is kept if its pair is wanted, ids by the number of distinct ones."""
    if not wanted:
        return pairs.select(id_col).distinct()
    return pairs.where(F.col("pair").isin(wanted)).groupBy(id_col).agg(F.count_distinct("pair").alias("n")).where(F.col("n") == len(set(wanted))).select(id_col)


def merge(matrices: list[DataFrame], how=F.sum) -> DataFrame:  # noqa: ANN001
    """Long matrices (row, column, value) added up, or joined by another aggregate."""
    return reduce(DataFrame.unionByName, matrices).groupBy("row", "column").agg(how("value").alias("value"))
