"""Minimum-codelength search: segmentation, correction, keypad decoding, mark-up and tagging.

A transformation turns pieces of the input into pieces of output at a cost; Viterbi search over the positions of the input keeps, for
each context of the model, the cheapest output. The model is a bounded table of context counts that every task holds; ``static_model``
refuses to gather a larger one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Model

#: Counters of a model that tasks may hold.
LARGEST = 2_000_000


class Static:
    """Frozen counts of one model: cost of a symbol after a context, with escapes and full exclusions."""

    def __init__(self, rows: Sequence[tuple[str, str, int]], order: int, alphabet: int = 65536) -> None:
        self.order, self.alphabet, self.counts = order, alphabet, {}
        for ctx, sym, weight in rows:
            self.counts.setdefault(ctx, {})[sym] = weight
        self._known: dict[tuple[str, str], float] = {}

    def usable(self, ctx: str) -> bool:
        seen = self.counts.get(ctx)
        return bool(seen) and (not ctx or len(seen) > 1 or next(iter(seen.values())) > 1)

    def context(self, past: str) -> str:
        """The longest usable context, on which all that follows depends."""
        past = past[-self.order :] if self.order else ""
        while past and not self.usable(past):
            past = past[1:]
        return past

    def bits(self, past: str, symbol: str) -> float:
        key = (past[-self.order :] if self.order else "", symbol)
        if key not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[key] = self._bits(*key)
        return self._known[key]

    def _bits(self, past: str, symbol: str) -> float:
        out, excluded = 0.0, set()
        for k in range(len(past), -1, -1):
            ctx = past[len(past) - k :]
            if not self.usable(ctx):
                continue
            seen = self.counts[ctx]
            mass = sum(n for s, n in seen.items() if s not in excluded)
            if mass == 0:
                continue
            total = mass + len(seen)
            if symbol in seen and symbol not in excluded:
                return out - math.log2(seen[symbol] / total)
            out -= math.log2(len(seen) / total)
            excluded |= seen.keys()
        return out + math.log2(max(1, self.alphabet - len(self.counts.get("", {})) + 1))

    def cost(self, text: str) -> float:
        return sum(self.bits(text[max(0, i - self.order) : i], c) for i, c in enumerate(text))


class Dense:
    """The costs of a Static model of order 3 or less as arrays, for batches of texts.

    rows are the counters of a model of texts: a usable context's shorter ones are usable and know what it knows, so that what is excluded
    is known by contexts alone.
    """

    def __init__(self, rows: Sequence[tuple[str, str, int]], order: int, alphabet: int = 65536) -> None:
        if not 0 <= order <= 3:
            raise ValueError("orders from 0 to 3")
        counts: dict[str, dict[str, int]] = {}
        for ctx, sym, weight in rows:
            counts.setdefault(ctx, {})[sym] = weight
        self.order, self.alphabet = order, alphabet
        usable = {ctx: seen for ctx, seen in counts.items() if not ctx or len(seen) > 1 or next(iter(seen.values())) > 1}
        self.signs = np.unique(np.array([ord(c) for ctx, seen in usable.items() for c in (*ctx, *seen)], np.int64))
        if len(self.signs) >= 0xFFFF:
            raise ValueError("more signs than 16 bits tell apart")
        number = {chr(c): i + 1 for i, c in enumerate(self.signs.tolist())}  # 0: any other sign, and what stands before a text
        mass = {ctx: sum(seen.values()) for ctx, seen in usable.items()}
        below = {}
        for ctx, seen in usable.items():
            if ctx:
                lower = usable.get(ctx[1:], {})
                if not seen.keys() <= lower.keys():
                    raise ValueError("a context knows what a shorter one doesn't")
                below[ctx] = sum(map(lower.__getitem__, seen))
        self.rest = math.log2(max(1, alphabet - len(usable.get("", {})) + 1))
        self.steps, self.found = [], []  # by length: contexts, bits of escapes paid before each length, totals; grams, weights
        for k in range(order + 1):
            at = sorted((_key(number, ctx), ctx) for ctx in usable if len(ctx) == k)
            paid, totals = np.zeros((len(at), k + 2)), np.ones((len(at), k + 1))
            for i, (_, ctx) in enumerate(at):
                out = 0.0
                for j in range(k, -1, -1):
                    paid[i, j + 1] = out
                    suffix = ctx[k - j :]
                    left = mass[suffix] - (below[ctx[k - j - 1 :]] if j < k else 0)
                    if left:
                        totals[i, j] = left + len(usable[suffix])
                        out -= math.log2(len(usable[suffix]) / totals[i, j])
                paid[i, 0] = out
            grams = sorted((_key(number, ctx) << 16 | number[c], n) for _, ctx in at for c, n in usable[ctx].items())
            self.steps.append((np.array([x for x, _ in at], np.uint64), paid, totals))
            self.found.append((np.array([x for x, _ in grams], np.uint64), np.array([n for _, n in grams], np.float64)))
        self._known: dict[tuple[str, str], float] = {}

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of signs."""
        place = np.zeros(0x110000, np.uint64)
        place[self.signs] = np.arange(1, len(self.signs) + 1, dtype=np.uint64)
        return place[codes]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of grams: four numbers of 16 bits each, the last of the symbol, those before it of its context."""
        codes, distinct = pd.factorize(keys)
        return self._costs(distinct)[codes]

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.order, -1, -1):
            contexts, paid, totals = self.steps[k]
            at, there = _places(contexts, (keys[open_] >> np.uint64(16)) & np.uint64((1 << 16 * k) - 1))
            mine, node = open_[there], at[there]
            open_ = open_[~there]
            out[mine] = paid[node, 0] + self.rest
            for j in range(k, -1, -1):
                grams, weights = self.found[j]
                at, there = _places(grams, keys[mine] & np.uint64((1 << 16 * (j + 1)) - 1))
                share = weights[at[there]] / totals[node[there], j]
                out[mine[there]] = paid[node[there], j + 1] - np.fromiter(map(math.log2, share.tolist()), np.float64, len(share))
                mine, node = mine[~there], node[~there]
        out[open_] = self.rest  # of an empty model
        return out

    def usable(self, ctx: str) -> bool:
        ids = self.ids(np.array([ord(c) for c in ctx], np.int64)).tolist()
        return not ctx or all(ids) and bool(_places(self.steps[len(ctx)][0], np.array([sum(x << 16 * i for i, x in enumerate(reversed(ids)))], np.uint64))[1][0])

    def context(self, past: str) -> str:
        past = past[-self.order :] if self.order else ""
        while past and not self.usable(past):
            past = past[1:]
        return past

    def bits(self, past: str, symbol: str) -> float:
        key = (past[-self.order :] if self.order else "", symbol)
        if key not in self._known:
            ids = self.ids(np.array([ord(c) for c in "".join(key)], np.int64)).tolist()
            self._known[key] = float(self._costs(np.array([sum(x << 16 * i for i, x in enumerate(reversed(ids)))], np.uint64))[0])
        return self._known[key]


def _key(number: dict[str, int], text: str) -> int:
    out = 0
    for c in text:
        out = out << 16 | number[c]
    return out


def _places(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where asked keys stand among sorted ones, and whether they do."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def dense_model(model: Model, largest: int = LARGEST) -> Dense:
    """The only model of some tables as arrays, if it has few enough counters to be held by every task."""
    size = model.sym.count()
    if size > largest:
        raise ValueError(f"{size} counters; only models of up to {largest} are held in tasks")
    rows = model.sym.select("ctx", "sym", F.col("weight").cast("bigint").alias("weight")).toArrow()
    return Dense(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), model.order, model.alphabet)


class _Columns:
    """Texts side by side: all first symbols, then all second ones, and so on."""

    def __init__(self, texts: list[str]) -> None:
        """texts: by falling length, none empty."""
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.size = int(self.lengths.sum())
        begins = np.cumsum(self.lengths) - self.lengths
        line = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(self.size) - np.repeat(begins, self.lengths)
        self.live = np.searchsorted(-self.lengths, -np.arange(1, self.lengths[0] + 1), side="right")  # texts that reach each place
        self.begin = np.cumsum(self.live) - self.live
        self.at = self.begin[place] + line  # of each symbol in the order of the texts
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.place = place

    def before(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value k places before each symbol, 0 before the text; in the order of the texts."""
        out = np.zeros_like(values)
        out[k:] = np.where(self.place[k:] >= k, values[:-k], 0) if k else values
        return out

    def columns(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.at] = values
        return out


def _chunks(texts: Sequence[str], most: int) -> Iterator[list[int]]:
    """Places of the texts that aren't empty, by falling length, in chunks of some ``most`` symbols."""
    order, size = [], 0
    for i in sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i])):
        order.append(i)
        size += len(texts[i])
        if size >= most:
            yield order
            order, size = [], 0
    if order:
        yield order


#: Before a symbol: which of the last places hold a space. 0 none, 1 the third but last, 2 the second but last, 3 the last, 4 the last and the third but last.
#: The state before, by state and by three choices: of 0 from 1, of 3 and 4 from 4, of 3 by way of 1.
_CAME = np.array([[c & 1, 2, 3 + (c >> 1 & 1), 2 if c & 4 else c & 1, 3 + (c >> 1 & 1)][s] for s in range(5) for c in range(8)], np.uint8)


def segment_texts(texts: Sequence[str], model: Dense) -> list[tuple[str, float]]:
    """``segment`` for each of the texts."""
    out: list[tuple[str, float]] = [("", 0.0)] * len(texts)
    alnum = np.zeros(0x110000, bool)
    signs = list(set("".join(texts)))
    alnum[[ord(c) for c in signs]] = [c.isalnum() for c in signs]
    for chunk in _chunks(texts, 400_000):
        part = [texts[i] for i in chunk]
        for i, found in zip(chunk, _segment(part, model, alnum), strict=True):
            out[i] = found
    return out


def _segment(texts: list[str], model: Dense, alnum: np.ndarray) -> list[tuple[str, float]]:
    c = _Columns(texts)
    d = model.ids(c.codes)
    c1, c2, c3 = (c.before(d, k) for k in (1, 2, 3))
    space = model.ids(np.array([32]))[0]
    gram = lambda *x: c.columns(model.costs(x[0] << np.uint64(48) | x[1] << np.uint64(32) | x[2] << np.uint64(16) | x[3]))
    k0, k1, k2, k3, k4 = gram(c3, c2, c1, d), gram(space, c2, c1, d), gram(c2, space, c1, d), gram(c2, c1, space, d), gram(space, c1, space, d)
    never = c.columns(~alnum[c.codes])
    s0, s1, s2 = gram(c2, c1, d, space), gram(space, c1, d, space), gram(c1, space, d, space)
    for x in (s0, s1, s2):
        x[never] = math.inf
    n = len(texts)
    states = np.full((5, n), math.inf)
    states[0] = 0.0
    choice, tied = np.empty((3, c.size), bool), np.empty((3, c.size), bool)
    ends = np.empty((5, n))
    for t, live in enumerate(c.live.tolist()):
        here = slice(int(c.begin[t]), int(c.begin[t]) + live)
        ends[:, live : states.shape[1]] = states[:, live:]
        old = states[:, :live]
        states = np.empty((5, live))
        a, b, e, f = old[0] + k0[here], old[1] + k1[here], old[3] + k3[here], old[4] + k4[here]
        np.minimum(a, b, out=states[0])
        np.add(old[2], k2[here], out=states[1])
        np.minimum(e, f, out=states[2])
        g, h = states[0] + s0[here], states[1] + s1[here]
        np.minimum(g, h, out=states[3])
        np.add(states[2], s2[here], out=states[4])
        for i, (x, y) in enumerate(((a, b), (e, f), (g, h))):
            np.less(y, x, out=choice[i, here])
            np.equal(x, y, out=tied[i, here])
    ends[:, : states.shape[1]] = states
    bits, last = ends.min(axis=0), ends.argmin(axis=0).astype(np.uint8)
    chosen = (choice[0] + choice[1].view(np.uint8) * 2 + choice[2].view(np.uint8) * 4).astype(np.uint8)
    path, state = np.empty(c.size, np.uint8), last.copy()
    for t in range(len(c.live) - 1, -1, -1):
        here = slice(int(c.begin[t]), int(c.begin[t]) + int(c.live[t]))
        path[here] = state[: c.live[t]]
        state[: c.live[t]] = _CAME[path[here] * 8 + chosen[here]]
    doubt = np.where((path == 0) | (path == 3) & ~choice[2], tied[0], False) | (((path == 2) | (path == 4)) & tied[1]) | ((path == 3) & tied[2])
    begins = np.cumsum(c.lengths) - c.lengths
    doubtful = np.logical_or.reduceat(doubt[c.at], begins) | ((ends == bits).sum(axis=0) > 1)
    spaced = path[c.at] >= 3
    codes = np.repeat(c.codes, 1 + spaced)
    codes[np.cumsum(1 + spaced)[spaced] - 1] = 32
    whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    stops = np.cumsum(np.add.reduceat(1 + spaced.astype(np.int64), begins)).tolist()
    found = [(whole[x:y], z) for x, y, z in zip([0, *stops[:-1]], stops, bits.tolist(), strict=True)]
    for i in np.flatnonzero(doubtful).tolist():  # equally cheap ones are told apart by their texts
        found[i] = segment(texts[i], model)
    return found


def static_models(model: Model, largest: int = LARGEST) -> dict[str, Static]:
    """The models as look-up tables, if they have few enough counters to be held by every task."""
    size = model.sym.count()
    if size > largest:
        raise ValueError(f"{size} counters; only models of up to {largest} are held in tasks")
    rows: dict[str, list] = {}
    for r in model.sym.select("model", "ctx", "sym", "weight").toLocalIterator():
        rows.setdefault(r.model, []).append((r.ctx, r.sym, r.weight))
    return {m: Static(x, model.order, model.alphabet) for m, x in rows.items()}


@dataclass(frozen=True)
class Rule:
    """Where the input goes on with ``source``, the output may go on with ``target`` at a cost in bits. An empty source, with a target, inserts."""

    source: str
    target: str
    cost: float = 0.0


def copies(text: str) -> list[Rule]:
    return [Rule(c, c) for c in dict.fromkeys(text)]


def viterbi(text: str, model: Static, rules: Sequence[Rule], copy: bool = True, stack: int = 0) -> tuple[str, float]:
    """The cheapest output for the whole input and its bits; ties go to the output that sorts first.

    stack: the feature of a stack search, which follows the so many cheapest paths only and may miss the cheapest of all; 0 follows all.
    """
    by: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.source:
            raise ValueError("a rule consumes input")
        by.setdefault(r.source[0], []).append(r)
    states: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(text) + 1)]
    states[0][""] = (0.0, "")
    for i, here in enumerate(states[:-1]):
        moves = [r for r in by.get(text[i], ()) if text.startswith(r.source, i)]
        if copy:
            moves.append(Rule(text[i], text[i]))
        for past, (bits, out) in here.items():
            for r in moves:
                total, context = bits + r.cost, past
                for c in r.target:
                    total += model.bits(context, c)
                    context = model.context(context + c)
                at, entry = i + len(r.source), (total, out + r.target)
                if context not in states[at] or entry < states[at][context]:
                    states[at][context] = entry
        states[i] = {}
        if stack:
            leaves = sorted((entry, at, context) for at in range(i + 1, len(states)) for context, entry in states[at].items())
            for _, at, context in leaves[stack:]:
                del states[at][context]
    if not states[-1]:
        return text, math.inf
    bits, out = min(states[-1].values())
    return out, bits


def segment(text: str, model: Static) -> tuple[str, float]:
    """Spaces put in where they make the text cheaper."""
    return viterbi(text, model, [Rule(c, c + " ") for c in dict.fromkeys(text) if c.isalnum()])


def correct(text: str, model: Static, confusions: Sequence[Rule]) -> tuple[str, float]:
    return viterbi(text, model, confusions)


#: The letters of a telephone's keys.
KEYS = {"2": "abc", "3": "def", "4": "ghi", "5": "jkl", "6": "mno", "7": "pqrs", "8": "tuv", "9": "wxyz"}


def keypad(text: str, model: Static) -> tuple[str, float]:
    """Letters for the digits of a telephone's keys."""
    rules = [Rule(d, c) for d, letters in KEYS.items() for c in letters]
    return viterbi(text, model, rules + [Rule(c, c) for c in dict.fromkeys(text) if c not in KEYS], copy=False)


def mark_up(text: str, models: dict[str, Static], switch: float = 8.0) -> list[tuple[str, int, int]]:
    """(model, start, end) of the stretches that make the text cheapest, a change of model costing ``switch`` bits."""
    names = sorted(models)
    if not text or not names:
        return []
    best, back = {m: 0.0 if m == names[0] else 0.0 for m in names}, []
    for i, c in enumerate(text):
        low = min(names, key=lambda m: (best[m], m))
        came, new = {}, {}
        for m in names:
            stay, move = best[m], best[low] + (switch if i else 0.0)
            came[m] = low if move < stay else m
            new[m] = min(stay, move) + models[m].bits(text[max(0, i - models[m].order) : i], c)
        back.append(came)
        best = new
    at = min(names, key=lambda m: (best[m], m))
    labels = [at]
    for came in reversed(back[1:]):
        at = came[at]
        labels.append(at)
    labels.reverse()
    out = []
    for i, m in enumerate(labels):
        if out and out[-1][0] == m:
            out[-1] = (m, out[-1][1], i + 1)
        else:
            out.append((m, i, i + 1))
    return out


#: A symbol that no text holds: its cost is what a model's end costs.
SENTINEL = "\uffff"


def mark_up_by_sentinel(text: str, models: dict[str, Static]) -> list[tuple[str, int, int]]:
    """(model, start, end) as mark_up, where a change costs the sentinel in the model that is left, and the next one begins without a context."""
    names = sorted(models)
    if not text or not names:
        return []
    best = {(m, 0): 0.0 for m in names}  # by model and symbols of context since its beginning
    back: list[dict[tuple[str, int], tuple[str, int]]] = []
    for i, c in enumerate(text):
        came: dict[tuple[str, int], tuple[str, int]] = {}
        here = dict(best)
        if i:
            ended = [(cost + models[m].bits(text[i - r : i], SENTINEL), m, r) for (m, r), cost in best.items()]
            for m in names:
                others = [x for x in ended if x[1] != m]
                if others:
                    cost, n, r = min(others)
                    here[m, 0], came[m, 0] = cost, (n, r)
        best, step = {}, {}
        for (m, r), cost in here.items():
            total, to = cost + models[m].bits(text[i - r : i], c), (m, min(r + 1, models[m].order))
            if to not in best or total < best[to]:
                best[to], step[to] = total, came.get((m, r), (m, r)) if r == 0 and i else (m, r)
        back.append(step)
    at = min(best, key=lambda k: (best[k], k))
    labels = []
    for step in reversed(back):
        labels.append(at[0])
        at = step[at]
    out: list[tuple[str, int, int]] = []
    for i, m in enumerate(reversed(labels)):
        if out and out[-1][0] == m:
            out[-1] = (m, out[-1][1], i + 1)
        else:
            out.append((m, i, i + 1))
    return out


def markup_statistics(stretches: DataFrame) -> DataFrame:
    """(model, symbols, stretches, switches) of stretches (model, start_pos, end_pos): switches are stretches that don't begin a text."""
    length = F.col("end_pos") - F.col("start_pos")
    return stretches.groupBy("model").agg(F.sum(length).alias("symbols"), F.count(F.lit(1)).alias("stretches"), F.count_if(F.col("start_pos") > 0).alias("switches"))


def parse_confusions(line: str) -> Rule | None:
    """A rule from a line ``freq total source -> target``; its cost is that of the share. None for other lines."""
    head, arrow, target = line.partition("->")
    parts = head.split()
    if not arrow or len(parts) < 3 or not (parts[0].isdigit() and parts[1].isdigit()) or int(parts[0]) == 0 or int(parts[1]) == 0:
        return None
    return Rule(" ".join(parts[2:]), target.strip(), -math.log2(int(parts[0]) / int(parts[1])))


class Keypad:
    """``keypad`` for many texts: costs of all letters of four keys lie side by side, for the searches of a batch to go on by whole columns."""

    def __init__(self, model: Dense, others: str = " .,") -> None:
        """others: signs besides the keys that are looked for by columns; texts with more of them are searched one by one."""
        self.model, self.letters = model, ["", *KEYS.values(), *others]  # the first: before a text
        self.number = np.full(0x110000, -1, np.int64)
        self.number[[ord(c) for c in (*KEYS, *others)]] = np.arange(1, len(self.letters))
        n = len(self.letters)
        self.codes = np.zeros((n, 4), np.int64)
        there = np.zeros((n, 4), bool)
        for i, x in enumerate(self.letters):
            self.codes[i, : len(x)] = [ord(c) for c in x]
            there[i, : max(1, len(x))] = True
        ids = model.ids(self.codes)
        ids[0] = 0
        #: By keys of three symbols before and of this one: bits by this one's letter and the letters of those before, from the last to the first.
        self.costs = np.full((n**4, 256), math.inf)
        grid = np.indices((n, n, n, n)).reshape(4, -1)
        spot = np.indices((4, 4, 4, 4)).reshape(4, -1)
        for at in range(0, n**4, 4096):
            keys = grid[:, at : at + 4096, None]
            real = there[keys[3], spot[0]] & there[keys[2], spot[1]] & there[keys[1], spot[2]] & there[keys[0], spot[3]]
            gram = ids[keys[0], spot[3]] << np.uint64(48) | ids[keys[1], spot[2]] << np.uint64(32) | ids[keys[2], spot[1]] << np.uint64(16) | ids[keys[3], spot[0]]
            self.costs[at : at + 4096][real] = model.costs(gram[real])

    def __call__(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("", 0.0)] * len(texts)
        for chunk in _chunks(texts, 60_000):
            whole = [i for i in chunk if (self.number[[ord(c) for c in set(texts[i])]] > 0).all()]
            for i in set(chunk) - set(whole):
                out[i] = keypad(texts[i], self.model)
            if whole:
                for i, found in zip(whole, self._search([texts[i] for i in whole]), strict=True):
                    out[i] = found
        return out

    def _search(self, texts: list[str]) -> list[tuple[str, float]]:
        c, n = _Columns(texts), len(self.letters)
        key = self.number[c.codes]
        k1, k2, k3 = (c.before(key, k) for k in (1, 2, 3))
        four = c.columns(((k3 * n + k2) * n + k1) * n + key)
        best = np.empty((c.size + len(texts), 64))  # by column: states are the letters of the last three keys, from the last to the first
        best[c.size :] = math.inf
        best[c.size :, 0] = 0.0  # before the texts
        room = np.empty((len(texts), 256))
        begin, live = c.begin.tolist(), c.live.tolist()
        for t, m in enumerate(live):
            here, old = slice(begin[t], begin[t] + m), begin[t - 1] if t else c.size
            block = room[:m]
            np.take(self.costs, four[here], axis=0, out=block, mode="clip")
            by_new = block.reshape(m, 4, 64)
            by_new += best[old : old + m, None, :]
            by_old = block.reshape(m, 64, 4)
            np.minimum(np.minimum(by_old[..., 0], by_old[..., 1]), np.minimum(by_old[..., 2], by_old[..., 3]), out=best[here])
        last = c.begin[c.lengths - 1] + np.arange(len(texts))
        ends = best[last]
        bits, state = ends.min(axis=1), ends.argmin(axis=1)
        doubtful = (ends == bits[:, None]).sum(axis=1) > 1
        path = np.empty(c.size, np.int64)
        before, rows = best.reshape(-1, 4), self.costs.reshape(-1, 4)
        for t in range(len(live) - 1, -1, -1):
            m, old = live[t], begin[t - 1] if t else c.size
            here, now = slice(begin[t], begin[t] + m), state[:m]
            path[here] = now
            totals = before[(old + np.arange(m)) * 16 + (now & 15)] + rows[four[here] * 64 + now]
            came = totals.argmin(axis=1)
            doubtful[:m] |= (totals == totals[np.arange(m), came][:, None]).sum(axis=1) > 1
            state[:m] = (now & 15) * 4 + came
        codes = self.codes[key, path[c.at] >> 4]
        whole = codes.astype("<u4").tobytes().decode("utf-32-le")
        stops = np.cumsum(c.lengths).tolist()
        found = [(whole[x:y], z) for x, y, z in zip([0, *stops[:-1]], stops, bits.tolist(), strict=True)]
        for i in np.flatnonzero(doubtful).tolist():
            at = c.begin[: c.lengths[i]] + i
            found[i] = (self._first(best[at], four[at], ends[i], bits[i]), found[i][1])
        return found

    def _first(self, best: np.ndarray, four: np.ndarray, ends: np.ndarray, bits: float) -> str:
        """Of equally cheap letters for a text those that sort first."""
        start = np.full(64, math.inf)
        start[0] = 0.0
        tight: list[dict[int, list[int]]] = []  # by place: states after it that follow each state before it
        states = np.flatnonzero(ends == bits).tolist()
        for t in range(len(four) - 1, -1, -1):
            old = best[t - 1] if t else start
            follow: dict[int, list[int]] = {}
            for s in states:
                total = old[(s & 15) * 4 : (s & 15) * 4 + 4] + self.costs[four[t], s * 4 : s * 4 + 4]
                for a in np.flatnonzero(total == best[t][s]).tolist():
                    follow.setdefault((s & 15) * 4 + a, []).append(s)
            tight.append(follow)
            states = list(follow)
        out, state = [], {0}
        for t, follow in enumerate(reversed(tight)):
            nexts = {s for x in state for s in follow.get(x, ())}
            least = min(s >> 4 for s in nexts)
            out.append(self.letters[four[t] % len(self.letters)][least])
            state = {s for s in nexts if s >> 4 == least}
        return "".join(out)


def apply_batches(df: DataFrame, id_col: str, text_col: str, shared, function) -> DataFrame:  # noqa: ANN001
    """(id, out, bits): as ``apply``, with a function of many texts and of what is shared."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    held = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = iter(function([t for t in texts if t is not None], held.value))
            each = [(None, None) if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in each], pa.string()), pa.array([x for _, x in each], pa.float64())], ["k", "out", "bits"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, out string, bits double").withColumnRenamed("k", id_col)


def apply(df: DataFrame, id_col: str, text_col: str, static, function) -> DataFrame:  # noqa: ANN001
    """(id, out, bits): a search function over every text; null texts give null."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    shared = rows.sparkSession.sparkContext.broadcast(static)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, None) if t is None else function(t, shared.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["k", "out", "bits"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, out string, bits double").withColumnRenamed("k", id_col)


def mark_texts(df: DataFrame, id_col: str, text_col: str, models: dict[str, Static], switch: float = 8.0) -> DataFrame:
    """(id, model, start_pos, end_pos): the stretches of every text; null and empty texts give none."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in mark_up(t, shared.value, switch)]
            if found:
                at, m, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(m), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["k", "model", "start_pos", "end_pos"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, model string, start_pos int, end_pos int").withColumnRenamed("k", id_col)


class Tagger:
    """Tags of words by counts of tag runs and of words by tag; unknown words by their letters."""

    def __init__(self, sentences: Sequence[Sequence[tuple[str, str]]], least: float = 0.01) -> None:
        self.steps, self.words, self.letters, self.tags, self.least = {}, {}, {}, {}, least
        for sentence in sentences:
            before = ""
            for word, tag in [*sentence, ("", "")]:
                self.steps.setdefault(before, {})[tag] = self.steps.get(before, {}).get(tag, 0) + 1
                if tag:
                    self.words.setdefault(word, {})[tag] = self.words.get(word, {}).get(tag, 0) + 1
                    self.tags[tag] = self.tags.get(tag, 0) + 1
                    self.letters.setdefault(word[-2:], {})[tag] = self.letters.get(word[-2:], {}).get(tag, 0) + 1
                before = tag

    def candidates(self, word: str) -> dict[str, float]:
        """Tags of a word with their shares; shares at or below ``least`` are left out."""
        seen = self.words.get(word) or self.letters.get(word[-2:]) or self.tags
        total = sum(seen.values())
        kept = {t: n / total for t, n in seen.items() if n / total > self.least}
        return kept or {max(sorted(seen), key=seen.get): 1.0}

    def tag(self, words: Sequence[str]) -> list[str]:
        states = {"": (0.0, ())}
        size = len(self.tags) + 1
        for w in words:
            new: dict[str, tuple[float, tuple]] = {}
            for tag, p in self.candidates(w).items():
                for before, (bits, path) in states.items():
                    seen = self.steps.get(before, {})
                    step = (seen.get(tag, 0) + 0.5) / (sum(seen.values()) + 0.5 * size)
                    entry = (bits - math.log2(step) - math.log2(p), (*path, tag))
                    if tag not in new or entry < new[tag]:
                        new[tag] = entry
            states = new
        return list(min(states.values())[1]) if words else []


def chunk(pairs: Sequence[tuple[str, str]], rules: Sequence[tuple[tuple[str, ...], str]]) -> list[tuple[str, str, str]]:
    """(word, tag, chunk): the longest rule whose tags follow here names the chunk, the first of equally long ones; else the tag does."""
    out, i = [], 0
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][0]), x[0]))
    while i < len(pairs):
        for _, (tags, name) in ordered:
            if tags and tuple(t for _, t in pairs[i : i + len(tags)]) == tuple(tags):
                out += [(w, t, name) for w, t in pairs[i : i + len(tags)]]
                i += len(tags)
                break
        else:
            out.append((*pairs[i], pairs[i][1]))
            i += 1
    return out
