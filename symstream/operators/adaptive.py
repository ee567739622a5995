"""Order-dependent models: adaptive scoring, arithmetic coding, sampling. One text, or one key's stream, is one unit of work.

``Adaptive`` learns while it scores. The relational models of ``models`` are used where counts are frozen; what depends on the order of
symbols runs here, as Arrow functions over rows that hold whole units.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut

from . import coder

SENTINEL = -1


class Adaptive:
    """A finite-context model with escapes C or D and full exclusions; symbols are integers, the sentinel is SENTINEL."""

    def __init__(self, order: int = 3, method: str = "D", alphabet: int = 256, update_exclusions: bool = True) -> None:
        if method not in ("C", "D") or order < -1:
            raise ValueError("method is C or D, order -1 or more")
        self.order, self.step, self.alphabet, self.narrow = order, 2 if method == "D" else 1, alphabet, update_exclusions
        self.counts: dict[tuple[int, ...], dict[int, int]] = {}
        self.mass: dict[tuple[int, ...], int] = {}
        self.past: tuple[int, ...] = ()

    def _contexts(self) -> Iterator[tuple[int, ...]]:
        for k in range(min(self.order, len(self.past)), -1, -1):
            yield self.past[len(self.past) - k :]

    def ranges(self, symbol: int) -> list[tuple[int, int, int]]:
        """(low, high, total) of each choice that codes the symbol: escapes, then the symbol."""
        out, excluded = [], set()
        for ctx in self._contexts():
            seen = self.counts.get(ctx)
            if not seen:
                continue
            own, mass = None, 0
            for s, n in seen.items():
                if s not in excluded:
                    if s == symbol:
                        own = (mass, mass + n)
                    mass += n
            if mass == 0:
                continue  # nothing is left to escape from
            total = mass + len(seen)
            if own:
                out.append((*own, total))
                return out
            out.append((mass, total, total))
            excluded |= seen.keys()
        gone = [s for s in excluded if s != SENTINEL]
        total = self.alphabet - len(gone) + 1
        at = total - 1 if symbol == SENTINEL else symbol - sum(s < symbol for s in gone)
        out.append((at, at + 1, total))
        return out

    def choose(self, pick: Callable[[int], int], take: Callable[[int, int, int], None] | None = None) -> int:
        """The symbol that targets picked from the totals lead to: decoding, or sampling. take hears of each range on the way."""
        take = take or (lambda low, high, total: None)
        excluded: set[int] = set()
        for ctx in self._contexts():
            seen = self.counts.get(ctx)
            if not seen:
                continue
            left = [(s, n) for s, n in seen.items() if s not in excluded]
            mass = sum(n for _, n in left)
            if mass == 0:
                continue
            total = mass + len(seen)
            target, low = pick(total), 0
            if target < mass:
                for s, n in left:
                    if target < low + n:
                        take(low, low + n, total)
                        return s
                    low += n
            take(mass, total, total)
            excluded |= seen.keys()
        gone = sorted(s for s in excluded if s != SENTINEL)
        total = self.alphabet - len(gone) + 1
        at = pick(total)
        take(at, at + 1, total)
        if at == total - 1:
            return SENTINEL
        for s in gone:  # the at-th of those that are left
            if s > at:
                break
            at += 1
        return at

    def bits(self, symbol: int) -> float:
        """What ``ranges`` costs. What was excluded by a longer context is known to the shorter one, so its mass is taken from the whole."""
        out, excluded = 0.0, ()
        for ctx in self._contexts():
            seen = self.counts.get(ctx)
            if not seen:
                continue
            mass = self.mass[ctx] - sum([seen[s] for s in excluded])
            if mass == 0:
                continue
            total = mass + len(seen)
            if symbol in seen and symbol not in excluded:
                return out - math.log2(seen[symbol] / total)
            out -= math.log2(len(seen) / total)
            excluded = seen
        return out + math.log2(self.alphabet - sum([s != SENTINEL for s in excluded]) + 1)

    def update(self, symbol: int) -> None:
        """Learns a symbol: with update exclusions only the longest context that knows it is counted up, shorter ones stay."""
        known = False
        for ctx in self._contexts():
            seen = self.counts.setdefault(ctx, {})
            if symbol in seen:
                if not (self.narrow and known):
                    seen[symbol] += self.step
                    self.mass[ctx] += self.step
                known = True
            else:
                seen[symbol] = 1
                self.mass[ctx] = self.mass.get(ctx, 0) + 1
        self.past = () if symbol == SENTINEL or self.order < 1 else (*self.past, symbol)[-self.order :]

    def learn(self, symbols: Iterable[int]) -> Adaptive:
        for s in symbols:
            self.update(s)
        return self

    def cost(self, symbols: Iterable[int]) -> float:
        """Bits of the symbols, each learned after it is scored."""
        out = 0.0
        for s in symbols:
            out += self.bits(s)
            self.update(s)
        return out


class _Encoder:
    """Arithmetic coder of 32-bit ranges."""

    def __init__(self) -> None:
        self.low, self.high, self.pending, self.out = 0, (1 << 32) - 1, 0, []

    def code(self, low: int, high: int, total: int) -> None:
        span = self.high - self.low + 1
        self.low, self.high = self.low + span * low // total, self.low + span * high // total - 1
        while True:
            if self.high < 1 << 31:
                self._bit(0)
            elif self.low >= 1 << 31:
                self._bit(1)
                self.low -= 1 << 31
                self.high -= 1 << 31
            elif self.low >= 1 << 30 and self.high < 3 << 30:
                self.pending += 1
                self.low -= 1 << 30
                self.high -= 1 << 30
            else:
                return
            self.low, self.high = self.low * 2, self.high * 2 + 1

    def _bit(self, bit: int) -> None:
        self.out += [bit] + [1 - bit] * self.pending
        self.pending = 0

    def finish(self) -> bytes:
        self.pending += 1
        self._bit(int(self.low >= 1 << 30))
        self.out += [0] * (-len(self.out) % 8)
        return bytes(int("".join(map(str, self.out[i : i + 8])), 2) for i in range(0, len(self.out), 8))


class _Decoder:
    def __init__(self, data: bytes) -> None:
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at, self.low, self.high = 32, 0, (1 << 32) - 1
        self.value = int(self.bits[:32].ljust(32, "0"), 2)

    def target(self, total: int) -> int:
        return ((self.value - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def take(self, low: int, high: int, total: int) -> None:
        span = self.high - self.low + 1
        self.low, self.high = self.low + span * low // total, self.low + span * high // total - 1
        while True:
            if self.high < 1 << 31:
                drop = 0
            elif self.low >= 1 << 31:
                drop = 1 << 31
            elif self.low >= 1 << 30 and self.high < 3 << 30:
                drop = 1 << 30
            else:
                return
            bit = int(self.bits[self.at]) if self.at < len(self.bits) else 0
            self.at += 1
            self.low, self.high, self.value = (self.low - drop) * 2, (self.high - drop) * 2 + 1, (self.value - drop) * 2 + bit


def compress(data: bytes, order: int = 3, method: str = "D") -> bytes:
    """Bytes coded by an adaptive model, a sentinel at their end."""
    model, coder = Adaptive(order, method), _Encoder()
    for s in (*data, SENTINEL):
        for r in model.ranges(s):
            coder.code(*r)
        model.update(s)
    return coder.finish()


def decompress(coded: bytes, order: int = 3, method: str = "D") -> bytes:
    """What compress coded."""
    model, coder, out = Adaptive(order, method), _Decoder(coded), bytearray()
    while True:
        s = model.choose(coder.target, coder.take)
        if s == SENTINEL:
            return bytes(out)
        out.append(s)
        model.update(s)


def units(text: str | None, unit: str) -> list[int]:
    return [] if text is None else list(text.encode()) if unit == "byte" else [ord(c) for c in text]


def adaptive_bits(df: DataFrame, id_col: str, text_col: str, order: int = 3, method: str = "D", unit: str = "byte", update_exclusions: bool = True, prime: list[str] | None = None) -> DataFrame:
    """(id, symbols, bits): each text scored by a model that learns it from the start, with a sentinel at its end.

    prime: texts that the model has learned before. A null text has no symbols but the sentinel.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    alphabet = 256 if unit == "byte" else 0x110000  # all code points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bits = [], []
            for t in b.column(1).to_pylist():
                model = Adaptive(order, method, alphabet, update_exclusions)
                for p in prime or ():
                    model.learn([*units(p, unit), SENTINEL])
                found = units(t, unit)
                n.append(len(found))
                bits.append(model.cost([*found, SENTINEL]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.float64())], ["k", "symbols", "bits"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, symbols bigint, bits double").withColumnRenamed("k", id_col)


def code_texts(df: DataFrame, id_col: str, text_col: str, order: int = 3, method: str = "D") -> DataFrame:
    """(id, coded): each text's UTF-8 bytes compressed as by ``compress``; null stays null."""
    return df.select(id_col, coder.compressed(df.sparkSession, F.col(text_col).cast("binary"), order, method).alias("coded"))


def decode_texts(df: DataFrame, id_col: str, coded_col: str, order: int = 3, method: str = "D") -> DataFrame:
    """(id, text): what ``code_texts`` coded."""
    return df.select(id_col, coder.decompressed(df.sparkSession, F.col(coded_col), order, method).cast("string").alias("text"))


def held_out(df: DataFrame, id_col: str, label_col: str, text_col: str, order: int = 2, folds: int = 5) -> DataFrame:
    """(id, label, best, bits): each text scored under models of all labels that were trained without its fold.

    Texts are put into folds by a digest of their ids. With as many folds as texts this leaves out one at a time; a few folds keep the
    number of models bounded on large tables.
    """
    from .counts import context_counts, gram_counts
    from .models import gram_bits, tables

    rows = df.select(F.col(id_col).alias("doc"), F.col(label_col).cast("string").alias("model"), F.col(text_col).alias("t")).where("t IS NOT NULL AND model IS NOT NULL")
    fold = F.pmod(F.conv(F.left(F.md5(F.col("doc").cast("string").cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(folds))
    grams = cut(gram_counts(rows, ["doc", "model"], "t", order).withColumn("fold", fold))
    out = None
    for f in range(folds):
        model = tables(context_counts(grams.where(F.col("fold") != f), ["model"], order), order)
        mine = grams.where(F.col("fold") == f).select("doc", F.col("model").alias("label"), "gram", "n")
        part = mine.join(gram_bits(mine, model), "gram").groupBy("doc", "label", "model").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc", "label").agg(F.min(F.struct("bits", "model")).alias("b"))
    return best.select(F.col("doc").alias(id_col), "label", F.col("b.model").alias("best"), F.col("b.bits").alias("bits"))


def generate(texts: list[str], length: int, order: int = 3, seed: int = 123457) -> str:
    """A random text by a model of some texts: the same for the same seed."""
    model = Adaptive(order, alphabet=128)
    for t in texts:
        model.learn([*(min(ord(c), 127) for c in t), SENTINEL])
    chance, out = random.Random(seed), []
    while len(out) < length:
        s = model.choose(chance.randrange)
        if s == SENTINEL:
            model.past = ()
            continue
        out.append(chr(s))
        model.past = (*model.past, s)[-order:] if order > 0 else ()
    return "".join(out)


def cheapest_word(candidates: DataFrame, word_col: str, scored: DataFrame) -> DataFrame:
    """The candidate with the least codelength, then the first by name."""
    return candidates.join(scored, word_col).agg(F.min(F.struct("bits", word_col)).alias("b")).select(F.col(f"b.{word_col}").alias(word_col), F.col("b.bits").alias("bits"))
