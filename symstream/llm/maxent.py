"""A binary maximum-entropy classifier over sparse features, fitted on the driver on a bounded sample."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np


class MaxEnt:
    """Weights by feature; the probability of a set of features."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, features: Iterable[str]) -> float:
        known = self.weights
        return known.get("", 0.0) + sum([known.get(f, 0.0) for f in features])

    def probability(self, features: Iterable[str]) -> float:
        x = self.score(features)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    @classmethod
    def fit(cls, rows: Sequence[Sequence[str]], labels: Sequence[float], rounds: int = 60, rate: float = 0.5, shrink: float = 1e-4, least: int = 2) -> MaxEnt:
        """Gradient steps scaled by feature (AdaGrad) on the whole sample; features seen less than least times are left out."""
        counts: dict[str, int] = {}
        for r in rows:
            for f in r:
                counts[f] = counts.get(f, 0) + 1
        index = {"": 0} | {f: i + 1 for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
        where = [[0, *[index[f] for f in r if f in index]] for r in rows]
        sizes = np.array([len(r) for r in where], np.int64)
        columns = np.array([c for r in where for c in r], np.int64)
        of = np.repeat(np.arange(len(where)), sizes)
        y, w, seen = np.asarray(labels, float), np.zeros(len(index)), np.full(len(index), 1e-8)
        for _ in range(rounds if len(where) else 0):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[columns], len(where)), -30, 30)))
            g = np.bincount(columns, (p - y)[of], len(index)) / len(where) + shrink * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
        return cls({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6})
