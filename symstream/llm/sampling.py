"""Bounded samples on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(*cols: str, seed: int = 29) -> Column:
    """A number from 0 to 1 by a hash of the columns: the same rows are drawn whenever a task runs again."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def least(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """The size rows that a hash of the id draws (all if there are fewer), the same however the rows are spread over tasks."""
    return rows.orderBy(chance(id_col, seed=31), id_col).limit(size)


def texts(rows: DataFrame, id_col: str, text_col: str, size: int) -> list[str]:
    """About size texts (never over twice as many), or all if there are fewer."""
    total = rows.count()
    drawn = rows.where(chance(id_col) < size / total) if total > size else rows
    return [r[0] for r in drawn.select(text_col).limit(2 * size).collect()]


def by_label(rows: DataFrame, id_col: str, label_col: str, text_col: str, labels: list[str], size: int) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(text, label) of about size rows of each of the labels (never over twice as many in all), and how many rows have each."""
    rows = rows.where(F.col(label_col).isin(labels) & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}  # a row for each known label
    if not counts:
        return [], {}
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, size / n))])
    drawn = rows.where(chance(id_col) < share[F.col(label_col)])
    return [(r[0], r[1]) for r in drawn.select(text_col, label_col).limit(2 * size * len(labels)).collect()], counts
