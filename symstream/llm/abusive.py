"""Abusive, hateful or sexual content (problem 9).

A linear-chain conditional random field with the states harmless and offending tags the tokens of each sentence. Features are the
skeletons of a token and its neighbours (one spelling for native, romanised and disguised forms), whether a listed term is among them,
whether it stands in quotation marks and whether it is disguised. Token labels come from the reviewers' verdicts on documents: in a
document judged abusive the likeliest sentence holds offending tokens, in one judged harmless none does; labels and model are refined
in turn, and verdicts that the model contradicts strongly are left out as mistaken. Marginals by the forward-backward algorithm, run
for all sentences of a batch at once, give the offending spans, and the surest sentence gives the document's score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut

from . import canonical, sampling

#: Documents judged abusive, and harmless, in the training sample, and harmless ones that a first fit mistakes for abusive ones.
SAMPLE = (2500, 3000, 3000)
#: Score from which a first fit mistakes a document.
HARD = 0.25
#: Score from which a document counts as abusive.
LEAST = 0.5
# --- fixed values: disguises, and letters by sound ------------------------------------------------------------------------
DISGUISE = str.maketrans("013457@$!|€*", "oieastasiiea")
SOUND = {
    "ക": "k", "ഖ": "k", "ഗ": "k", "ഘ": "k", "ങ": "n", "ച": "c", "ഛ": "c", "ജ": "c", "ഝ": "c", "ഞ": "n", "ട": "t", "ഠ": "t", "ഡ": "t", "ഢ": "t", "ണ": "n", "ത": "t", "ഥ": "t", "ദ": "t", "ധ": "t", "ന": "n",
    "പ": "p", "ഫ": "p", "ബ": "p", "ഭ": "p", "മ": "m", "യ": "y", "ര": "r", "ല": "l", "വ": "v", "ശ": "s", "ഷ": "s", "സ": "s", "ഹ": "h", "ള": "l", "ഴ": "l", "റ": "r",
    "ൺ": "n", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "l", "ൿ": "k", "ം": "m", "ഃ": "h",
    "അ": "a", "ആ": "a", "ഇ": "i", "ഈ": "i", "ഉ": "u", "ഊ": "u", "ഋ": "ri", "എ": "e", "ഏ": "e", "ഐ": "ai", "ഒ": "o", "ഓ": "o", "ഔ": "au",
    "ാ": "a", "ി": "i", "ീ": "i", "ു": "u", "ൂ": "u", "ൃ": "ri", "െ": "e", "േ": "e", "ൈ": "ai", "ൊ": "o", "ോ": "o", "ൌ": "au", "ൗ": "au",
}
ROMAN = (("r̥", "ri"), ("ḻ", "l"), ("ñ", "n"), ("zh", "l"), ("kh", "k"), ("gh", "k"), ("ch", "c"), ("jh", "c"), ("th", "t"), ("dh", "t"), ("ph", "p"), ("bh", "p"), ("sh", "s"), ("ng", "n"), ("nj", "n"))
LETTER = str.maketrans("gjdbfwqz", "kctppvks")
VOWELS = (("aa", "a"), ("ee", "i"), ("oo", "u"), ("ii", "i"), ("uu", "u"))
# --------------------------------------------------------------------------------------------------------------------------
_CONSONANT = re.compile("[ക-ഹ]")
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, 0x34F, 0x180E])
_ALIKE = str.maketrans("".join(a for a, _ in canonical.LOOK_ALIKE), "".join(b for _, b in canonical.LOOK_ALIKE))
_BETWEEN = re.compile(r"[^\w\u0d00-\u0d7f]+(?=[ാ-്ൗംഃ])")
_LONG = re.compile(r"([^\W\d_aeiou])\1{2,}")
_EDGE = ".,!?;:()[]{}\"'“”‘’«»…।-–—*_~"
_OPENING, _ENDING = "\"'“‘«", ".!?।…"


def _spoken(word: str) -> str:
    """Malayalam letters by sound, with the vowel that a consonant holds unless a sign or virama follows."""
    out = []
    for i, c in enumerate(word):
        if c == "്":
            if i == len(word) - 1:
                out.append("u")
            continue
        out.append(SOUND.get(c, c))
        if "ക" <= c <= "ഹ" and not (i + 1 < len(word) and ("ാ" <= word[i + 1] <= "്" or word[i + 1] == "ൗ")):
            out.append("a")
    return "".join(out)


@lru_cache(maxsize=200_000)
def skeleton(token: str) -> str:
    """One spelling for the native, romanised, disguised and marked forms of a word; empty without letters."""
    word = unicodedata.normalize("NFKC", token.translate(_INVISIBLE)).translate(_ALIKE).lower().strip(_EDGE)
    if not word:
        return ""
    if _CONSONANT.search(word):
        word = _spoken(unicodedata.normalize("NFC", _BETWEEN.sub("", word)))  # a sign belongs to its letter whatever was put between
    elif any(c.isalpha() for c in word) and not re.fullmatch(r"\d[\d.,:/-]*[^\W\d_]{0,4}", word):
        word = word.translate(DISGUISE)
    word = _LONG.sub(r"\1", word)
    for a, b in ROMAN:
        word = word.replace(a, b)
    word = "".join(c for c in unicodedata.normalize("NFD", word) if c.isalnum())
    for a, b in VOWELS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word.translate(LETTER))


def _disguised(token: str) -> bool:
    core = token.strip(_EDGE)
    letters = sum(c.isalpha() for c in core)
    return letters > 1 and any(c in "013457@$*" for c in core[1:]) and not core[0].isdigit() or any(c in _INVISIBLE for c in map(ord, core)) or letters > 2 and core.count(".") + core.count("-") + core.count("*") >= letters - 1


class Lexicon:
    """Numbers of tokens as they stand, and for each what the features need."""

    def __init__(self, index: dict[str, int], listed: frozenset[str]) -> None:
        self.index, self.listed = index, listed
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple[int, int, bool, bool]] = []

    def __call__(self, token: str) -> int:
        found = self.ids.get(token)
        if found is None:
            s = skeleton(token)
            flags = (s in self.listed) + 2 * (token[0] in _OPENING) + 4 * _disguised(token)
            found = self.ids[token] = len(self.rows)
            self.rows.append((self.index.get(s, 0), self.index.get(s[:4] + "~", 0) if len(s) > 3 else 0, flags, token.rstrip("\"'”’»)")[-1:] in _ENDING))
        return found


#: Positions of the neighbours whose skeletons are features.
AROUND = (-3, -2, -1, 0, 1, 2, 3)


class Field:
    """The conditional random field: weights of skeletons by position, of beginnings, of flags by position, and of changes of state."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, flags: np.ndarray, change: np.ndarray, bias: float) -> None:
        self.words, self.begins, self.flags, self.change, self.bias = words, begins, flags, change, bias

    @staticmethod
    def near(values: np.ndarray, starts: np.ndarray, shift: int, nothing: int = 0) -> np.ndarray:
        """The values shifted within sentences; nothing beyond their ends. starts: the sentence's number of each token."""
        out = np.full_like(values, nothing)
        if shift == 0:
            return values
        a, b = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
        same = starts[a] == starts[b]
        out[a] = np.where(same, values[b], nothing)
        return out

    def unary(self, sk: np.ndarray, begin: np.ndarray, flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.full(len(sk), self.bias) + self.begins[begin]
        for k, shift in enumerate(AROUND):
            out += self.words[k, self.near(sk, of, shift)]
            if -1 <= shift <= 1:
                out += self.flags[shift + 1, self.near(flags, of, shift)]
        return out


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, lengths: np.ndarray, change: np.ndarray, pairs: bool = False, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of the offending state of each token of sentences that stand one after another; sums of pair marginals, each weighed
    by its second token, if asked.

    change[i, j] is the score of state j after state i. Sentences go side by side, sorted by length, token by token; messages
    are log odds.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    top = int(sizes[0]) if len(sizes) else 0
    ahead, back = np.empty(len(unary)), np.zeros(len(unary))
    active = np.searchsorted(-sizes, -np.arange(top), side="left")  # sentences longer than t
    step = lambda r, a, b, c, d: _log_add(a, r + b) - _log_add(c, r + d)
    c = change
    for t in range(top):
        at = starts[: active[t]] + t
        ahead[at] = unary[at] if t == 0 else unary[at] + step(ahead[at - 1], c[0, 1], c[1, 1], c[0, 0], c[1, 0])
    for t in range(top - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        back[at] = step(back[at + 1] + unary[at + 1], c[1, 0], c[1, 1], c[0, 0], c[0, 1])
    total = ahead + back
    p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
    if not pairs:
        return p, None
    first = np.ones(len(unary), bool)
    if len(unary):
        first[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(first)
    out = np.zeros((2, 2))
    if len(at):
        left, right = ahead[at - 1], unary[at] + back[at]
        logs = np.stack([np.full(len(at), c[0, 0]), c[0, 1] + right, c[1, 0] + left, c[1, 1] + left + right])
        logs -= logs.max(axis=0)
        shares = np.exp(logs)
        shares /= shares.sum(axis=0)
        out = (shares.sum(axis=1) if weight is None else shares @ weight[at]).reshape(2, 2)
    return p, out


class Tokens:
    """Token arrays of documents: skeleton, beginning, flags, sentence of each token, and sentences of each document."""

    def __init__(self, texts: list[str], lexicon: Lexicon) -> None:
        ids, sizes = [], []
        number = lexicon.__call__
        known = lexicon.ids
        for t in texts:
            words = t.split()
            try:
                ids += [known[w] for w in words]
            except KeyError:
                ids += [number(w) for w in words][: len(words)]
            sizes.append(len(words))
        rows = np.array(lexicon.rows, np.int64).reshape(-1, 4)
        raw = np.array(ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.sk, self.begin, self.flags, ends = (rows[raw, i] for i in range(4)) if len(raw) else (raw, raw, raw, raw)
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        cut = np.ones(len(raw), bool)
        if len(raw):
            cut[1:] = (ends[:-1] == 1) | (doc[1:] != doc[:-1])
        self.of = np.cumsum(cut) - 1
        self.lengths = np.bincount(self.of) if len(raw) else np.zeros(0, np.int64)
        self.doc_of_sentence = doc[cut]
        self.doc = doc


def _gradient_fit(tokens: Tokens, truth: np.ndarray, counted: np.ndarray, vocabulary: int, rounds: int, field: Field | None = None, shrink: float = 2e-5) -> Field:
    """Maximum likelihood by scaled gradient steps on all sentences, whose tokens count as often as counted says."""
    f = field or Field(np.zeros((len(AROUND), vocabulary)), np.zeros(vocabulary), np.zeros((3, 8)), np.zeros((2, 2)), -2.0)
    near = [f.near(tokens.sk, tokens.of, s) for s in AROUND]
    flags = [f.near(tokens.flags, tokens.of, s) for s in (-1, 0, 1)]
    first = np.ones(len(truth), bool)
    first[np.cumsum(tokens.lengths) - tokens.lengths] = False
    at = np.flatnonzero(first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[at - 1].astype(int), truth[at].astype(int)), counted[at])
    seen = [np.full_like(x, 1e-8) for x in (f.words, f.begins, f.flags, f.change)] + [np.full(1, 1e-8)]
    scale = max(1.0, counted @ truth)
    for _ in range(rounds):
        p, pairs = marginals(f.unary(tokens.sk, tokens.begin, tokens.flags, tokens.of), tokens.lengths, f.change, pairs=True, weight=counted)
        d = counted * (p - truth) / scale
        grads = [
            np.stack([np.bincount(n, d, vocabulary) for n in near]),
            np.bincount(tokens.begin, d, vocabulary),
            np.stack([np.bincount(x, d, 8) for x in flags]),
            (pairs - seen_pairs) / scale,
            np.array([d.sum()]),
        ]
        grads[0][:, 0] = 0
        grads[1][0] = 0
        for i, (g, name) in enumerate(zip(grads, ("words", "begins", "flags", "change", "bias"), strict=True)):
            value = np.atleast_1d(getattr(f, name))
            g = g + shrink * value
            seen[i] += g * g
            new = value - 0.25 * g / np.sqrt(seen[i])
            setattr(f, name, float(new[0]) if name == "bias" else new)
    return f


def _documents(p: np.ndarray, tokens: Tokens, count: int) -> np.ndarray:
    """A score for each document: the greatest marginal, or 0."""
    out = np.zeros(count)
    if len(p):
        np.maximum.at(out, tokens.doc, p)
    return out


def train(rows: list[tuple[str, float] | tuple[str, float, float]], terms: list[str]) -> tuple[dict[str, int], frozenset[str], Field]:
    """Vocabulary, listed skeletons and field, from documents with their mean verdicts (1 abusive, 0 harmless), and for how many documents
    each stands (1 if not given)."""
    stands = np.array([r[2] if len(r) > 2 else 1.0 for r in rows if r[0] and r[1] in (0.0, 1.0)])
    rows = [(r[0], r[1]) for r in rows if r[0] and r[1] in (0.0, 1.0)]
    listed = frozenset(filter(None, map(skeleton, terms)))
    held: list[set[str]] = [{skeleton(w) for w in t.split()} for t, _ in rows]
    y = np.array([v for _, v in rows])
    counts: dict[str, list[float]] = {}  # harmless and abusive documents for which those with the word stand, and those with it
    for words, v, n in zip(held, y, stands, strict=True):
        for w in words:
            c = counts.setdefault(w, [0, 0, 0])
            c[int(v)] += n
            c[2] += 1
    kept = sorted(w for w, (_, _, n) in counts.items() if w and n >= 2)
    begins = sorted({w[:4] + "~" for w in kept if len(w) > 3})
    index = {w: i + 1 for i, w in enumerate([*kept, *begins])}
    n1, n0 = max(1, stands @ y), max(1, stands @ (1 - y))
    odds = np.zeros(len(index) + 1)
    for w in kept:
        a, b, n = counts[w]
        odds[index[w]] = math.log((b + 0.3) / (n1 + 1)) - math.log((a + 0.3) / (n0 + 1)) if n >= 3 else 0.0
    tokens = Tokens([t for t, _ in rows], Lexicon(index, listed))
    weight = np.clip(odds[tokens.sk], 0, 3) * (np.clip(odds[tokens.sk], 0, 3) > 1.0) + 1.5 * (tokens.flags & 1) * (odds[tokens.sk] > 0)
    usable = np.ones(len(rows), bool)
    p = np.zeros(len(tokens.sk))
    half = np.array([xxhash.xxh3_64_intdigest(t) & 1 for t, _ in rows], np.int64)  # copies stay together
    counted = stands[tokens.doc] if len(rows) else np.zeros(0)
    abusive = y[tokens.doc] == 1 if len(rows) else np.zeros(0, bool)
    for turn in range(4):
        evidence = weight if turn == 0 else p
        heads = np.cumsum(tokens.lengths) - tokens.lengths
        by_sentence = (np.add if turn == 0 else np.maximum).reduceat(evidence, heads) if len(heads) else np.zeros(0)
        best = np.full(len(rows), -1)
        order = np.argsort(by_sentence, kind="stable")
        best[tokens.doc_of_sentence[order]] = order  # the last, the greatest, stays
        chosen = abusive & (best[tokens.doc] == tokens.of)
        cue = weight > 0 if turn == 0 else p >= np.minimum(0.5, 0.7 * by_sentence[tokens.of])
        # a stretch from the first to the last cue of the likeliest sentence, and of others that are likely by themselves
        cue &= chosen & (by_sentence[tokens.of] > (1.5 if turn == 0 else 0.2)) | abusive & (by_sentence[tokens.of] > (4.0 if turn == 0 else 0.5))
        truth = _filled(cue, tokens).astype(float)
        if turn:
            score = _documents(p, tokens, len(rows))
            usable = ~((y == 0) & (score > 0.95)) & ~((y == 1) & (score < (0.12 if turn == 3 else 0.04)))
        if turn == 3:
            break
        # each half is judged by what the other half teaches, so that no document vouches for its own verdict
        for side in (0, 1):
            mine = half[tokens.doc] == side
            learn = mine & usable[tokens.doc]
            field = _gradient_fit(_subset(tokens, learn), truth[learn], counted[learn], len(index) + 1, 30)
            rest = _subset(tokens, ~mine)
            p[~mine], _ = marginals(field.unary(rest.sk, rest.begin, rest.flags, rest.of), rest.lengths, field.change)
    use = usable[tokens.doc] if len(rows) else np.zeros(0, bool)
    return index, listed, _gradient_fit(_subset(tokens, use), truth[use], counted[use], len(index) + 1, 60)


def _filled(cue: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Cues, and what stands between the first and the last one of a sentence."""
    place = np.arange(len(cue))
    first, last = np.full(len(tokens.lengths), len(cue)), np.full(len(tokens.lengths), -1)
    np.minimum.at(first, tokens.of[cue], place[cue])
    np.maximum.at(last, tokens.of[cue], place[cue])
    return (place >= first[tokens.of]) & (place <= last[tokens.of])


def _subset(tokens: Tokens, use: np.ndarray) -> Tokens:
    out = Tokens.__new__(Tokens)
    out.sk, out.begin, out.flags, out.doc = tokens.sk[use], tokens.begin[use], tokens.flags[use], tokens.doc[use]
    _, out.of = np.unique(tokens.of[use], return_inverse=True)
    out.lengths = np.bincount(out.of) if len(out.of) else np.zeros(0, np.int64)
    return out


_SPACED = re.compile(r"\S+")


def _scored(rows: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(k, score, n_spans, spans) of rows (k, t, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, field = shared.value
        lexicon = Lexicon(index, known)
        kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                if len(lexicon.rows) > 500_000:
                    lexicon.clear()
                tokens = Tokens(texts, lexicon)
                p, _ = marginals(field.unary(tokens.sk, tokens.begin, tokens.flags, tokens.of), tokens.lengths, field.change)
                score = _documents(p, tokens, len(texts))
                spans = _spans(texts, tokens, p, score)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)], ["k", "score", "n_spans", "spans"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.select("k", "t").mapInArrow(run, f"k {kind}, score double, n_spans int, spans array<struct<start_pos:int,end_pos:int,score:double>>")


def _spans(texts: list[str], tokens: Tokens, p: np.ndarray, score: np.ndarray) -> list[list[dict]]:
    """Runs of offending tokens of the documents that reach the least score, as places in the text."""
    starts = np.cumsum(tokens.sizes) - tokens.sizes
    spans: list[list[dict]] = [[] for _ in texts]
    for d in np.flatnonzero(score >= LEAST):
        mine, of = (x[starts[d] : starts[d] + tokens.sizes[d]] for x in (p, tokens.of))
        last = -2
        for i, m in enumerate(_SPACED.finditer(texts[d])):
            if mine[i] >= LEAST:
                if last == i - 1 and of[i] == of[i - 1]:
                    spans[d][-1] |= {"end_pos": m.end(), "score": max(spans[d][-1]["score"], float(mine[i]))}
                else:
                    spans[d].append({"start_pos": m.start(), "end_pos": m.end(), "score": float(mine[i])})
                last = i
    return spans


def score_documents(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, verdict_col: str, terms: DataFrame, term_col: str, sample: tuple[int, int, int] = SAMPLE) -> DataFrame:
    """id, score (0 to 1), n_spans and spans (start_pos, end_pos, score): the offending stretches, for each document.

    Null and blank texts score 0. Several verdicts on a document count by their mean, and train only where they agree. The field is
    fitted on about ``sample`` documents judged abusive and harmless, and again with harmless ones that the first fit mistakes, which
    weigh against the abusive ones as in the whole table, whatever its size; without any it finds nothing. terms is a small fixed list.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    verdicts = labels.groupBy(F.col(label_id).alias("k")).agg(F.avg(verdict_col).alias("v")).where("v = 0 OR v = 1")
    counts = {int(r[0]): r[1] for r in verdicts.groupBy("v").count().collect()}
    share = F.when(F.col("v") == 1, min(1.0, sample[0] / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample[1] / max(1, counts.get(0, 0))))
    # at most twice the sample: ids and verdicts that every task may hold
    drawn = verdicts.where(sampling.chance("k") < share).limit(2 * sum(sample[:2]))
    labelled = [(r.t, r.v) for r in rows.join(F.broadcast(drawn), "k").select("t", "v").collect()]
    listed = [r[0] for r in terms.select(term_col).collect() if r[0]]
    context = rows.sparkSession.sparkContext
    model = train(labelled, listed)
    if counts.get(0, 0) > sample[1]:
        first = context.broadcast(model)
        others = verdicts.where((F.col("v") == 0) & (sampling.chance("k") >= share)).select("k")
        # scores of all documents, few of which are over the bound, meet the verdicts: no text is shuffled
        mistaken = cut(_scored(rows, first).where(F.col("score") > HARD).select("k").join(others, "k", "left_semi"))
        hard = sampling.least(mistaken, "k", sample[2])
        texts = [r.t for r in rows.join(F.broadcast(hard), "k", "left_semi").select("t").collect()]
        # all mistaken documents count against as many abusive ones as the whole table has: else the larger the table, the less is found
        stands = min(1.0, sample[0] / max(1, counts.get(1, 0))) * mistaken.count() / max(1, len(texts))
        labelled += [(t, 0.0, stands) for t in texts]
        model = train(labelled, listed)
    return _scored(rows, context.broadcast(model)).withColumnRenamed("k", id_col)
