"""Word and letter frequencies of a corpus.

Every partition counts its words. The counts of a word are summed over the partitions, exactly; words that make at least ``SHARE`` of
the corpus are its dictionary, which by that share alone has at most ``1 / SHARE`` words, however large the corpus is. All other words
are told by their letters: runs of two and three letters, counted over all words in a hashed table of ``2 ** SIZE`` counters, and a
plain table of letters. What is broadcast is 4 MB of counters and at most ``1 / SHARE`` words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut

SIZE = 20
#: The part of the corpus from which a word is in its dictionary.
SHARE = 2.0**-18
#: What words besides the dictionary are taken to make of the corpus, in nats; what a sign costs that stands for a lost letter.
SPELLED, LOST_COST = math.log(0.02), -8.0
BLOCK = 1 << 15
_SPLIT = str.maketrans(dict.fromkeys(".,!?;:()[]\"'“”‘’«»…।。！？，、-–—/", " "))
_A, _B, _C, _M = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, (1 << 32) - 1
START, END, LOST = 2, 3, 0xFFFD


def words_of(text: str) -> list[str]:
    return text.translate(_SPLIT).split()


def _slot(a: int, b: int, c: int, probe: int) -> int:
    x = (a * _A + b * _B + c * _C + probe * 0x27D4EB2F) & _M
    x = (x ^ x >> 15) * _A & _M
    return ((x ^ x >> 13) * _B & _M) >> (32 - SIZE)


def _slots(a: np.ndarray, b: np.ndarray, c: np.ndarray, probe: int) -> np.ndarray:
    x = (a * np.uint64(_A) + b * np.uint64(_B) + c * np.uint64(_C) + np.uint64(probe * 0x27D4EB2F)) & np.uint64(_M)
    x = (x ^ x >> np.uint64(15)) * np.uint64(_A) & np.uint64(_M)
    return (((x ^ x >> np.uint64(13)) * np.uint64(_B) & np.uint64(_M)) >> np.uint64(32 - SIZE)).astype(np.int64)


#: Counters of runs of letters, and of each letter of the basic plane.
TOTAL = (1 << SIZE) + (1 << 16)


def tables_of(counted: Counter) -> np.ndarray:
    """The tables of counters, one after another. Runs are counted at two places, of which the smaller one tells."""
    out = np.zeros(TOTAL, np.int64)
    if counted:
        wide = 1 << SIZE
        weights = np.fromiter(counted.values(), np.int64, len(counted))
        codes = np.frombuffer("".join(f"\x02\x02{w}\x03" for w in counted).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 3 for w in counted])
        of = np.repeat(weights, sizes)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(inside >= 2)
        none = np.zeros(len(at), np.uint64)
        for k in (0, 1):
            out[:wide] += np.bincount(_slots(codes[at - 2], codes[at - 1], codes[at], k), of[at], wide).astype(np.int64)
            out[:wide] += np.bincount(_slots(codes[at - 2], codes[at - 1], none, k), of[at], wide).astype(np.int64)
        out[wide:] += np.bincount(np.minimum(codes[at], np.uint64(0xFFFF)).astype(np.int64), of[at], 1 << 16).astype(np.int64)
    return out


class Tables(NamedTuple):
    """What is broadcast: the counters, the words of the dictionary in order, and how often each occurs."""

    counters: np.ndarray
    words: list[str]
    counts: np.ndarray


class Frequencies:
    """Look-ups in the tables."""

    def __init__(self, tables: Tables) -> None:
        self.runs, self.letters = np.split(tables.counters, (1 << SIZE,))
        self.total = float(self.letters.sum()) + 1.0
        self.n_words = float(self.letters[END]) + 1.0
        self.words, self.counts = tables.words, tables.counts
        self._count = dict(zip(tables.words, tables.counts.tolist(), strict=True))
        self._cost: dict[tuple[str, str, str], float] = {}
        self._word: dict[str, float] = {}

    @classmethod
    def of(cls, texts: Iterable[str]) -> Frequencies:
        counted: Counter = Counter()
        for t in texts:
            counted.update(words_of(t))
        least = SHARE * sum(counted.values())
        words = sorted(w for w, n in counted.items() if n >= least)
        return cls(Tables(tables_of(counted).astype(np.float32), words, np.array([counted[w] for w in words], np.int64)))

    def count(self, word: str) -> int:
        """How often the corpus has a word of the dictionary; 0 for others."""
        return self._count.get(word, 0)

    def share(self, letter: str) -> float:
        """How much of the corpus a letter makes."""
        return float(self.letters[min(ord(letter), 0xFFFF)]) / self.total

    def _run(self, a: int, b: int, c: int) -> float:
        return float(min(self.runs[_slot(a, b, c, 0)], self.runs[_slot(a, b, c, 1)]))

    def letter(self, a: str, b: str, c: str) -> float:
        """Log probability of a letter after two others; \\x02 stands before a word and \\x03 behind it."""
        key = (a, b, c)
        out = self._cost.get(key)
        if out is None:
            if len(self._cost) > 500_000:
                self._cost.clear()
            x, y, z = ord(a), ord(b), ord(c)
            out = self._cost[key] = min(0.0, math.log((self._run(x, y, z) + 3 * self.share(c) + 1e-9) / (self._run(x, y, 0) + 3.0))) if z != LOST else LOST_COST
        return out

    def letters_after(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same for arrays of code points, which are broadcast."""
        a, b, c = (np.asarray(x, np.uint64) for x in (a, b, c))
        none = np.zeros(1, np.uint64)
        run, all_ = (np.minimum(self.runs[_slots(a, b, x, 0)], self.runs[_slots(a, b, x, 1)]).astype(np.float64) for x in (c, none))
        share = self.letters[np.minimum(c, np.uint64(0xFFFF)).astype(np.int64)] / self.total
        return np.where(c == LOST, LOST_COST, np.minimum(np.log((run + 3 * share + 1e-9) / (all_ + 3.0)), 0.0))

    def word(self, text: str) -> float:
        """Log likelihood of a word: by the dictionary, or by its letters, whichever is more."""
        out = self._word.get(text)
        if out is None:
            if len(self._word) > 200_000:
                self._word.clear()
            a, b, out = "\x02", "\x02", SPELLED
            for c in text + "\x03":
                out += self.letter(a, b, c)
                a, b = b, c
            if n := self._count.get(text):
                out = max(out, math.log(n / self.n_words))
            self._word[text] = out
        return out


def count_corpus(df: DataFrame, text_cols: list[str], but: str | None = None) -> DataFrame:
    """(part, packed, word, n): of all texts of the columns, blocks of the counters, and words with their counts; several rows may have
    the same block or word. Texts that match the expression ``but`` are left out. Nothing is shuffled.
    """
    import zstandard

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        total = np.zeros(TOTAL, np.int64)

        def told() -> pa.RecordBatch:
            n = len(counted)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["part", "packed", "word", "n"])

        for b in batches:
            for column in b.columns:
                texts = column.drop_null()
                if but is not None:
                    texts = texts.filter(pc.invert(pc.match_substring_regex(texts, but)))
                for t in texts.to_pylist():
                    counted.update(words_of(t))
            if len(counted) > 300_000:  # bounds the memory of a task
                total += tables_of(counted)
                yield told()
                counted.clear()
        total += tables_of(counted)
        yield told()
        packer = zstandard.ZstdCompressor(level=1)
        rows = [(part, packer.compress(block.tobytes())) for part in range(-(-TOTAL // BLOCK)) if (block := total[part * BLOCK : (part + 1) * BLOCK]).any()]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], ["part", "packed", "word", "n"])

    return df.select(*text_cols).mapInArrow(local, "part int, packed binary, word string, n bigint")


def _merged(blocks: DataFrame) -> DataFrame:
    """(part, packed): each block once, summed."""
    import zstandard

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, unpacker = None, None, zstandard.ZstdDecompressor()

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], ["part", "packed"])

        for b in batches:
            for part, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = np.frombuffer(unpacker.decompress(packed), np.int64)
                if part != now:
                    yield from done()
                    now, total = part, np.zeros(len(row), np.int64)
                total += row
        yield from done()

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, packed binary")


def load(counted: DataFrame) -> Broadcast:
    """The tables of count_corpus, broadcast: of a size that the constants of this module bound."""
    import zstandard

    counted = cut(counted)
    flat = np.zeros(TOTAL, np.float32)
    for row in _merged(counted.where("part IS NOT NULL").select("part", "packed")).collect():  # blocks of the tables, whatever the input
        block = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.packed)), np.int64)
        flat[row.part * BLOCK : row.part * BLOCK + len(block)] = block
    summed = counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    # at most 1 / SHARE rows
    words = sorted((r.word, r.n) for r in summed.where(F.col("n") >= SHARE * float(flat[(1 << SIZE) + END])).collect())
    tables = Tables(flat, [w for w, _ in words], np.array([n for _, n in words], np.int64))
    return counted.sparkSession.sparkContext.broadcast(tables)
