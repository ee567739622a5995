"""Context-free grammars with costs: parsing, the cheapest derivation, and generation."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Production:
    """A rule ``left -> right`` with a cost in bits; symbols that are no left side of any rule are terminals."""

    left: str
    right: tuple[str, ...]
    cost: float = 0.0


def from_counts(rules: Sequence[tuple[str, tuple[str, ...], int]]) -> list[Production]:
    """Productions whose cost is that of their share among the rules of the same left side."""
    total: dict[str, int] = {}
    for left, _, n in rules:
        total[left] = total.get(left, 0) + n
    return [Production(left, tuple(right), -math.log2(n / total[left])) for left, right, n in rules if n > 0]


def _binary(rules: Sequence[Production]) -> list[Production]:
    """Rules of at most two symbols: longer ones are split, the first part takes the cost."""
    out = []
    for i, r in enumerate(rules):
        left, right, cost = r.left, r.right, r.cost
        while len(right) > 2:
            rest = f"{r.left}#{i}#{len(right)}"
            out.append(Production(left, (right[0], rest), cost))
            left, right, cost = rest, right[1:], 0.0
        out.append(Production(left, right, cost))
    return out


def parse(tokens: Sequence[str], rules: Sequence[Production], start: str) -> tuple[float, tuple] | None:
    """Bits and tree of the cheapest derivation of the tokens, or None. Rules with an empty right side are refused."""
    if any(not r.right for r in rules):
        raise ValueError("a rule derives at least one symbol")
    alone: dict[str, list[Production]] = {}  # rules by their only symbol, and by the first of two
    pairs: dict[str, dict[str, list[Production]]] = {}
    for r in _binary(rules):
        if len(r.right) == 1:
            alone.setdefault(r.right[0], []).append(r)
        else:
            pairs.setdefault(r.right[0], {}).setdefault(r.right[1], []).append(r)
    n = len(tokens)
    chart: list[list[dict[str, tuple[float, tuple]]]] = [[{} for _ in range(n + 1)] for _ in range(n + 1)]

    def close(cell: dict[str, tuple[float, tuple]]) -> None:
        """Rules of one symbol, the cheapest symbol first, so that each is done once."""
        waiting = [(cost, s) for s, (cost, _) in cell.items() if s in alone]
        heapq.heapify(waiting)
        while waiting:
            cost, s = heapq.heappop(waiting)
            if cost > cell[s][0]:
                continue
            for r in alone.get(s, ()):
                if r.left not in cell or cost + r.cost < cell[r.left][0]:
                    cell[r.left] = (cost + r.cost, (r.left, cell[s][1]))
                    heapq.heappush(waiting, (cost + r.cost, r.left))

    for i, t in enumerate(tokens):
        chart[i][i + 1][t] = (0.0, (t,))
        close(chart[i][i + 1])
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            cell = chart[i][i + width]
            for k in range(i + 1, i + width):
                right = chart[k][i + width]
                if not right:
                    continue
                for first, (cost_a, tree_a) in chart[i][k].items():
                    for second, made in pairs.get(first, {}).items():
                        if second in right:
                            cost_b, tree_b = right[second]
                            for r in made:
                                cost = r.cost + cost_a + cost_b
                                if r.left not in cell or cost < cell[r.left][0]:
                                    cell[r.left] = (cost, (r.left, tree_a, tree_b))
            close(cell)
    found = chart[0][n].get(start) if n else None
    return None if found is None else (found[0], _merged(found[1]))


def _merged(tree: tuple) -> tuple:
    """The tree without the helpers of split rules."""
    children = []
    for child in tree[1:]:
        below = _merged(child)
        children += below[1:] if "#" in below[0] and len(below) > 1 else [below]
    return (tree[0], *children)


def generate(rules: Sequence[Production], start: str, seed: int = 123457, longest: int = 200) -> list[str]:
    """A random derivation, rules drawn by their probability; the same for the same seed."""
    chance, by = random.Random(seed), {}
    for r in rules:
        by.setdefault(r.left, []).append(r)
    stack, out = [start], []
    while stack and len(out) < longest:
        s = stack.pop()
        if s in by:
            r = chance.choices(by[s], [2.0**-x.cost for x in by[s]])[0]
            stack += reversed(r.right)
        else:
            out.append(s)
    return out


def show(tree: tuple) -> str:
    return tree[0] if len(tree) == 1 else f"({tree[0]} {' '.join(map(show, tree[1:]))})"


def parse_texts(df: DataFrame, id_col: str, tokens_col: str, rules: Sequence[Production], start: str) -> DataFrame:
    """(id, tree, bits) for an array column of tokens; null where nothing derives it."""

    def one(tokens: object) -> tuple[str | None, float | None]:
        found = None if tokens is None else parse(list(tokens), rules, start)
        return (None, None) if found is None else (show(found[1]), found[0])

    import pandas as pd

    parsed = F.pandas_udf(lambda s: pd.DataFrame([one(t) for t in s], columns=["tree", "bits"]), "tree string, bits double")
    return df.select(id_col, parsed(F.col(tokens_col)).alias("p")).select(id_col, "p.tree", "p.bits")
