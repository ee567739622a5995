"""Edit distances, sentence alignment by length, and measures of parallel lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of alignment by length: ratio of lengths and its variance, penalties of the moves in hundredths of nats, the greatest cost of a match
RATIO, VARIANCE = 1.0, 6.8
PENALTY = {(1, 1): 0, (1, 0): 450, (0, 1): 450, (2, 1): 230, (1, 2): 230, (2, 2): 440}
GREATEST = 2500
#: The other published set: ratio, variance, and the moves' probabilities; punctuation that isn't counted.
RATIO_2, VARIANCE_2 = 1.467, 6.315
CHANCE_2 = {(1, 2): 0.023114355231143552, (1, 3): 0.0012165450121654502, (2, 2): 0.006082725060827251, (3, 1): 0.0006082725060827251, (1, 1): 0.9422141119221411, (2, 1): 0.0267639902676399}
UNCOUNTED = ",.!?:;~，。！？：；～”“《》"
# ----------------------------------------------------------------------------------------------------------------------------


def edit_distance(a: str, b: str, substitute: int = 2) -> int:
    """Fewest insertions and deletions, or substitutions at their cost, that turn one string into the other."""
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    places = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        step = np.empty(len(b) + 1, np.int64)
        step[0] = i
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + np.where(codes == ord(c), 0, substitute))
        row = np.minimum.accumulate(step - places) + places
    return int(row[-1])


def edit_distance_column(a: Column, b: Column, substitute: int = 2) -> Column:
    """edit_distance of two columns; with unit substitutions Spark's own function. Null with null."""
    if substitute == 1:
        return F.levenshtein(a, b)
    distance = F.pandas_udf(lambda x, y: x.combine(y, lambda p, q: None if p is None or q is None else edit_distance(p, q, substitute)).astype("Int64"), "bigint")
    return distance(a, b)


_TAIL = np.frompyfunc(lambda z: math.erfc(z / math.sqrt(2)), 1, 1)


def match_costs(a: np.ndarray, b: np.ndarray, ratio: float = RATIO, variance: float = VARIANCE, mean: bool = True) -> np.ndarray:
    """What it costs, for each pair of lengths, that the texts are translations of one another: how unlikely so great a difference is.

    mean: the variance is of the mean of both lengths, else of the first.
    """
    spread = np.sqrt(variance * ((a + b / ratio) / 2 if mean else a))
    chance = _TAIL(np.abs(ratio * a - b) / np.maximum(spread, 1e-300)).astype(np.float64)
    costs = np.trunc(-100 * np.log(np.maximum(chance, 1e-300)))
    return np.where((a == 0) & (b == 0), 0, np.where(chance > 0, costs, GREATEST)).astype(np.int64)


def counted_length(sentence: str) -> int:
    """Signs of a sentence but for punctuation, for the second set of values."""
    return sum(c not in UNCOUNTED for c in sentence)


def align_by_chance(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """align_lengths with the second set of values, whose moves leave no sentence out; empty if no such alignment is there."""
    penalty = {move: round(-100 * math.log(p)) for move, p in CHANCE_2.items()}
    return align_lengths(a, b, penalty, lambda x, y: match_costs(x, y, RATIO_2, VARIANCE_2, mean=False))


def align_lengths(a: Sequence[int], b: Sequence[int], penalty: dict[tuple[int, int], int] = PENALTY, match=match_costs) -> list[tuple[int, int, int, int, int]]:  # noqa: ANN001
    """(start_a, n_a, start_b, n_b, cost) of the cheapest alignment of two sequences of sentence lengths.

    The table is filled by its diagonals, each at once: a move of m and n sentences comes from the diagonal m + n before. Costs of four
    diagonals and the number of the chosen move of every cell are held. Of equally cheap moves the one of fewest sentences of a is taken.
    """
    rows, columns = len(a), len(b)
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in (a, b))
    far = np.iinfo(np.int64).max // 4
    moves = np.zeros((rows + 1, columns + 1), np.uint8)
    costs = np.zeros((rows + 1, columns + 1), np.int32)
    diagonals = {0: np.where(np.arange(rows + 1) == 0, 0, far)}  # by the row
    order = sorted(penalty)
    for d in range(1, rows + columns + 1):
        i = np.arange(max(0, d - columns), min(d, rows) + 1)
        j = d - i
        best, price, chosen = np.full(len(i), far), np.zeros(len(i), np.int64), np.zeros(len(i), np.uint8)
        for number, (m, n) in enumerate(order):
            at = np.flatnonzero((i >= m) & (j >= n))
            if len(at):
                p, q = i[at], j[at]
                cost = match(upto_a[p] - upto_a[p - m], upto_b[q] - upto_b[q - n]) + penalty[m, n]
                whole = diagonals[d - m - n][p - m] + cost
                better = (whole < best[at]) & (whole < far)
                at = at[better]
                best[at], price[at], chosen[at] = whole[better], cost[better], number
        diagonals[d] = np.full(rows + 1, far)
        diagonals[d][i] = best
        moves[i, j], costs[i, j] = chosen, price
        diagonals.pop(d - 4, None)
    if diagonals[rows + columns][rows] >= far:
        return []
    out, i, j = [], rows, columns
    while i or j:
        m, n = order[moves[i, j]]
        out.append((i - m, m, j - n, n, int(costs[i, j])))
        i, j = i - m, j - n
    return out[::-1]


def align_columns(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, start_a, n_a, start_b, n_b, cost): the moves that align two array columns of sentence lengths; null arrays give none."""
    kind = "array<struct<start_a:int,n_a:int,start_b:int,n_b:int,cost:int>>"
    names = ("start_a", "n_a", "start_b", "n_b", "cost")

    def moves(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[] if p is None or q is None else [dict(zip(names, m, strict=True)) for m in align_lengths(list(map(int, p)), list(map(int, q)))] for p, q in zip(x, y, strict=True)])

    found = F.pandas_udf(moves, kind)
    return df.select(id_col, F.explode(found(F.col(a), F.col(b))).alias("m")).select(id_col, "m.*")


def parallel_ratio(a: str, b: str) -> Column:
    """The larger of two codelengths over the smaller one; null if either isn't positive."""
    x, y = F.col(a), F.col(b)
    return F.when((x > 0) & (y > 0), F.greatest(x / y, y / x))


def alignment_measures(df: DataFrame, ratio: str, threshold: float) -> DataFrame:
    """Number of pairs, mean ratio, mean binary logarithm, share above the threshold, greatest ratio, and area. One aggregation.

    area: the shares at or above 1.00, 1.01 ... 2.00, added up, and half of the percentage between 2 and 300.
    """
    r = F.col(ratio)
    steps = F.least(F.lit(101), F.greatest(F.lit(0), F.floor(F.round(r * 100, 6)) - 99))
    area = F.avg(steps) + 50 * (F.avg((r >= 2).cast("double")) - F.avg((r >= 300).cast("double")))
    return df.where(r.isNotNull()).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(ratio).alias("mean_ratio"), F.avg(F.log(2.0, ratio)).alias("mean_log2"), F.avg((r > threshold).cast("double")).alias("share_above"), F.max(ratio).alias("greatest"), area.alias("area")
    )


def above(df: DataFrame, ratio: str, grid: list[float]) -> DataFrame:
    """(k, share): share of the pairs whose ratio is above each value of a grid; one aggregation for all."""
    one = df.where(F.col(ratio).isNotNull()).agg(*[F.avg((F.col(ratio) > k).cast("double")).alias(f"a{i}") for i, k in enumerate(grid)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"a{i}").alias("share")) for i, k in enumerate(grid)])))


def realign(df: DataFrame, ratio: str, threshold: int) -> DataFrame:
    """Pairs whose ratio, cut to a whole number, is under the threshold."""
    return df.where(F.floor(ratio) < threshold)
