"""The words of a dictionary as a tree of letters, in arrays."""

from __future__ import annotations

import numpy as np

LETTER = 21
_MASK = (1 << LETTER) - 1


class Lexicon:
    """Node 0 is the beginning of all words. Edges are sorted by node and letter; edge i leads to node i + 1."""

    def __init__(self, words: list[str], weights: np.ndarray) -> None:
        """words: in order, each once, none empty. weights: what each counts, by which the best is found."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        at, levels, made = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 1
        for depth in range(int(sizes.max(initial=0))):
            longer = np.flatnonzero(sizes > depth)
            keys, inverse = np.unique(at[longer] << LETTER | codes[first[longer] + depth], return_inverse=True)
            at[longer] = made + inverse
            made += len(keys)
            levels.append(keys)
        self.edges = np.concatenate(levels)
        #: What the word that ends at a node counts, and the most that any word behind it does.
        self.ends = np.full(made, -np.inf)
        self.ends[at] = weights
        self.most = self.ends.copy()
        for keys in reversed(levels[1:]):
            np.maximum.at(self.most, keys >> LETTER, self.most[made - len(keys) : made])
            made -= len(keys)

    def step(self, nodes: np.ndarray, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have the letter behind them, the nodes it leads to)."""
        keys = nodes << LETTER | letter
        found = np.searchsorted(self.edges, keys)
        found[found == len(self.edges)] = 0
        at = np.flatnonzero(self.edges[found] == keys) if len(self.edges) else found[:0]
        return at, found[at] + 1

    def branch(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the node it leaves, its letter, the node it leads to) of each edge behind the nodes."""
        low, high = np.searchsorted(self.edges, nodes << LETTER), np.searchsorted(self.edges, (nodes + 1) << LETTER)
        counts = high - low
        of = np.repeat(np.arange(len(nodes)), counts)
        edge = np.arange(len(of)) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        return of, self.edges[edge] & _MASK, edge + 1

    def spelling(self, node: int) -> str:
        out = []
        while node:
            key = int(self.edges[node - 1])
            out.append(chr(key & _MASK))
            node = key >> LETTER
        return "".join(reversed(out))
