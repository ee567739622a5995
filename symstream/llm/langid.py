"""Missing or wrong language labels (problem 5).

Hierarchical discrimination. Words are scored by linear support vector machines over their letter n-grams and their script: machines of
the families (Dravidian, Indo-European, Sinitic) first, then one machine for each pair of languages within a family. Scores add up over a
clause; clauses in a row are labelled together by Viterbi search, so that a short one follows its neighbours. Machines are trained on
labelled rows of all fields, whose wrong labels are found by a first fit and left out of a second. Damaged text is repaired first.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import canonical, frequencies, mojibake, sampling

# --- fixed values: languages by script and family -----------------------------------------------------------------------
#: Scripts besides the Latin one, by the code of the language that is written in it.
SCRIPT_OF = {"ml": "\u0d00-\u0d7f", "hi": "\u0900-\u0963\u0966-\u097f", "ta": "\u0b80-\u0bff", "zh": "\u3400-\u9fff"}
#: Languages by family.
FAMILIES = {"dravidian": ("ml", "ta", "ml-latn", "ta-latn"), "indo-european": ("en", "hi", "hi-latn"), "sinitic": ("zh", "zh-latn")}
#: A language belongs to a text that has at least this part of its words.
PART = 1 / 6
NO_WORDS = "zxx"
# ------------------------------------------------------------------------------------------------------------------------
LANGS = tuple(x for langs in FAMILIES.values() for x in langs)
NATIVE = tuple(x for x in LANGS if x in SCRIPT_OF)
LATIN = tuple(x for x in LANGS if x not in SCRIPT_OF)
_IS_LATIN = np.array([x not in SCRIPT_OF for x in LANGS])
PAIRS = tuple(pair for langs in FAMILIES.values() for pair in itertools.combinations(langs, 2))
#: Rows of each label in the training sample.
SAMPLE = 700
#: What a change of language from clause to clause costs, in units of the scores.
SWITCH = 3.0
#: What a word's script speaks for the language that it is named for, in units of the scores, before the machines are asked.
PRIOR = 1.0
#: Texts that are scored at once.
CHUNK = 256
#: Words of a group whose scores are compared with those of the whole clause.
GROUP = 5
_ALIKE = str.maketrans("".join(a for a, _ in canonical.LOOK_ALIKE), "".join(b for _, b in canonical.LOOK_ALIKE))
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_NATIVE = re.compile("|".join(f"(?P<{name}>[{chars}])" for name, chars in SCRIPT_OF.items()))
_LETTER = re.compile(r"[^\W\d_]")
#: Pieces of one script: words of the scripts, other letters with their marks and signs, and what stands between clauses.
_MORE = "(?: [{0}][{0}\u200b-\u200d\u2060]*)*"
_OTHER = "[^\\s" + "".join(SCRIPT_OF.values()) + "]"
_PIECE = re.compile(
    "|".join(f"(?P<{name}>[{chars}][{chars}\u200b-\u200d\u2060]*{_MORE.format(chars)})" for name, chars in SCRIPT_OF.items())
    + r"|(?P<end>[.!?,;:\u2026\u0964\u3002\uff01\uff1f\uff0c\u3001]+(?=\s|$)|\n+|[\u0964\u3002\uff01\uff1f])|(?P<other>" + _OTHER + "+(?: " + _OTHER + "+)*)"
)


def ngrams(word: str) -> list[str]:
    """A word's features: itself, its script, and its runs of one to four letters."""
    w = f"^{word}$"
    script = _NATIVE.search(word)
    return [w, f"\x01{script.lastgroup if script else 'latin'}", *[w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)], *word]


def plain(word: str) -> str:
    """A Latin word in lower case without look-alikes and marks around it; empty if it has no letter."""
    word = unicodedata.normalize("NFKC", word.translate(_HIDDEN)).translate(_ALIKE).lower().strip(".,!?;:()[]\"'“”‘’«»-–—…/\\&+#*@%^~`|<>=")
    return word if _LETTER.search(word) else ""


def _native_words(kind: str, piece: str) -> list[str]:
    words = piece.split(" ")
    return [w[i : i + 2] for w in words for i in range(0, len(w), 2)] if kind == "zh" else words


def words_of(text: str) -> list[str]:
    """The words of a text as the machines take them; Chinese ones are of two signs."""
    out = []
    for m in _PIECE.finditer(text):
        kind, raw = m.lastgroup, m.group()
        if kind == "other":
            out += map(plain, raw.split(" "))
        elif kind != "end":
            out += _native_words(kind, raw)
    return [w for w in out if w]


class Rows:
    """Texts as words and words as features, in arrays: a text's score is the mean of its words', a word's the sum of its features'."""

    def __init__(self, texts: list[list[str]]) -> None:
        words: dict[str, int] = {}
        bags = [words.setdefault(w, len(words)) for text in texts for w in text]
        self.size = len(texts)
        lengths = np.array([len(text) for text in texts], np.int64)
        self.text_of, self.word = np.repeat(np.arange(len(texts)), lengths), np.array(bags, np.int64)
        self.share = np.repeat(1 / np.maximum(lengths, 1), lengths)
        index: dict[str, int] = {}
        lists = [[index.setdefault(f, len(index)) for f in ngrams(w)] for w in words]
        counts = np.array([len(x) for x in lists], np.int64)
        feature, of = np.array([i for x in lists for i in x], np.int64), np.repeat(np.arange(len(lists)), counts)
        # of features that stand in one place of the sample nothing can be learned
        known = np.bincount(feature, np.bincount(self.word, minlength=len(words))[of], len(index)) >= 2
        self.features = [f for f, keep in zip(index, known.tolist(), strict=True) if keep]
        kept = known[feature] if len(feature) else np.zeros(0, bool)
        self.feature, self.of, self.value = (np.cumsum(known) - 1)[feature[kept]], of[kept], np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)[kept]
        self.n_words = len(words)

    def fit(self, chosen: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
        """Weights of the features, and a bias: squared hinge loss by scaled gradient steps over the chosen texts; labels are 1 and -1."""
        place = np.full(self.size, -1)
        place[chosen] = np.arange(len(chosen))
        inside = place[self.text_of] >= 0
        text_of, word, share = place[self.text_of[inside]], self.word[inside], self.share[inside]
        wide, n = len(self.features), len(chosen)
        w, bias, seen, seen_bias = np.zeros(wide), 0.0, np.full(wide, 1e-10), 1e-10
        for _ in range(rounds if n and wide else 0):
            of_words = np.bincount(self.of, self.value * w[self.feature], self.n_words)
            slack = -labels * np.maximum(0.0, 1 - labels * (np.bincount(text_of, share * of_words[word], n) + bias)) * weights / weights.sum()
            of_words = np.bincount(word, share * slack[text_of], self.n_words)
            g, g_bias = np.bincount(self.feature, self.value * of_words[self.of], wide) + shrink * w, slack.sum() + shrink * bias
            seen += g * g
            seen_bias += g_bias * g_bias
            w -= 0.3 * g / np.sqrt(seen)
            bias -= 0.3 * g_bias / math.sqrt(seen_bias)
        return w, bias


class Model:
    """The machines, a column each: those of the families, then those of the pairs; scores of words, kept for words that come again."""

    def __init__(self, features: list[str], weights: np.ndarray, biases: np.ndarray) -> None:
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.biases = weights, biases
        self.places: dict[str, int] = {}
        self.latin: dict[str, int] = {}  # of words as written, in Latin letters, see latin_word
        self.table = np.empty((1024, len(LANGS)), np.float32)
        families = list(FAMILIES.values())
        self._family = np.array([next(i for i, langs in enumerate(families) if x in langs) for x in LANGS])
        self._first, self._second = (np.array([LANGS.index(p[k]) for p in PAIRS]) for k in (0, 1))

    def scores(self, word: str) -> np.ndarray:
        """A score for each language: that of its family, less what speaks for others in the machines of its pairs."""
        features = ngrams(word)
        known = [i for i in map(self.index.get, features) if i is not None]
        side = self.weights[known].sum(axis=0) / len(features) ** 0.5 + self.biases
        out = side[self._family]
        pairs = side[len(FAMILIES) :]
        np.add.at(out, self._first, np.minimum(0.0, pairs))
        np.subtract.at(out, self._second, np.maximum(0.0, pairs))
        if script := _NATIVE.search(word):
            out[LANGS.index(script.lastgroup)] += PRIOR
        return out

    def place(self, word: str) -> int:
        """Row of the table that holds a word's scores."""
        at = self.places.get(word)
        if at is None:
            at = self.places[word] = len(self.places)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[at] = self.scores(word)
        return at

    def latin_word(self, raw: str) -> int:
        """Twice the row of a word as it is written (-1 of one without a letter), and one more if it closes its clause."""
        word = plain(raw)
        out = self.latin[raw] = (self.place(word) if word else -1) * 2 + (raw[-1] in ".!?,;:\u2026")
        return out

    def forget(self) -> None:
        """Bounds what is kept; between texts only."""
        if max(len(self.places), len(self.latin)) > 300_000:
            self.places.clear()
            self.latin.clear()

    def best(self, words: list[str]) -> str:
        rows = [self.place(w) for w in words]
        return LANGS[int(self.table[rows].sum(axis=0).argmax())]


def _balance(labels: np.ndarray) -> np.ndarray:
    return np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))


def train(labelled: list[tuple[str, str]], counts: dict[str, int]) -> Model:
    """Machines from (text, label) rows of single languages; counts: rows of each label in the whole table.

    Most rows with the label of a rare language may be wrong ones of a common language. The first fit weighs rows as often as their
    label occurs, so that such rows count little against the right ones; rows that it gives another language are left out.
    """
    texts = [(words_of(t), label) for t, label in labelled]
    texts = [(w, label) for w, label in texts if w]
    for last in (False, True):
        rows, of = Rows([w for w, _ in texts]), np.array([label for _, label in texts], object)
        drawn = {x: int((of == x).sum()) for x in LANGS}
        natural = np.array([counts[x] / drawn[x] for x in of], np.float64)
        machines = []
        for langs in FAMILIES.values():
            machines.append((np.arange(len(of)), np.where(np.isin(of, langs), 1.0, -1.0)))
        for a, b in PAIRS:
            chosen = np.flatnonzero((of == a) | (of == b))
            machines.append((chosen, np.where(of[chosen] == a, 1.0, -1.0)))
        fitted = [rows.fit(chosen, y, _balance(y) if last else natural[chosen], 40 if last else 25) for chosen, y in machines]
        model = Model(rows.features, np.stack([w for w, _ in fitted], axis=1).astype(np.float32), np.array([b for _, b in fitted], np.float32))
        if not last:
            texts = [(w, label) for w, label in texts if model.best(w) == label]
    return model


class Identifier:
    """Languages of texts, and of their stretches."""

    def __init__(self, model: Model, allowed: tuple[str, ...]) -> None:
        """allowed: the languages that the labels of the text column know, its own one first; if none has Latin letters, or none others, all of these."""
        self.model, self.allowed = model, allowed
        self._of = {}
        for latin, langs in ((True, LATIN), (False, NATIVE)):
            names = [x for x in langs if x in allowed] or list(langs)
            self._of[latin] = np.array([LANGS.index(x) for x in names]), names, np.array([LANGS.index(x) for x in langs])

    def _clauses(self, text: str, out: list[list], rows: list[int]) -> None:
        """Adds (start, end, whether in Latin letters, script, number of words, first and last of its scored words) of each clause of one
        script, and rows of the model's table of the scored words.
        """
        open_ = False
        first = len(out)
        place, known, learn = self.model.place, self.model.latin, self.model.latin_word
        for m in _PIECE.finditer(text):
            kind = m.lastgroup
            if kind == "end":
                open_ = False
                continue
            start, end = m.span()
            raw = m.group()
            if kind == "other":
                for word in raw.split(" "):
                    told = known.get(word)
                    if told is None:
                        told = learn(word)
                    if told >= 0:
                        if open_ and out[-1][2]:
                            last = out[-1]
                        else:
                            out.append(last := [start, 0, True, kind, 0, len(rows), 0])
                            open_ = True
                        rows.append(told >> 1)
                        last[1] = start + len(word)
                        last[4] += 1
                        last[6] = len(rows)
                    elif mojibake.LOST in word:
                        if open_ and out[-1][2]:
                            out[-1][1] = start + len(word)
                        else:
                            out.append([start, start + len(word), True, kind, 0, len(rows), len(rows)])
                            open_ = True
                    if told & 1:
                        open_ = False
                    start += len(word) + 1
                continue
            pieces = _native_words(kind, raw)
            words = len(pieces)
            if kind != "zh" and start and len(out) > first and out[-1][3] == kind and out[-1][1] >= start - 2 and not text[start - 1].isspace():
                words -= 1  # one word, interrupted by a sign
            if open_ and out[-1][3] == kind:
                out[-1][1] = end
                out[-1][4] += words
            else:
                out.append([start, end, False, kind, words, len(rows), 0])
            rows += map(place, pieces)
            out[-1][6] = len(rows)
            open_ = True

    def stretches(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, words) of each stretch in one language."""
        return self.all_stretches([text])[0]

    def all_stretches(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """The stretches of each text."""
        self.model.forget()
        clauses: list[list] = []
        rows: list[int] = []
        cuts = [0]
        for text in texts:
            self._clauses(text, clauses, rows)
            cuts.append(len(clauses))
        if not clauses:
            return [[] for _ in texts]
        sums = np.concatenate([np.zeros((1, len(LANGS))), self.model.table[rows].cumsum(axis=0, dtype=np.float64)])
        latin, first, last = (np.array([c[k] for c in clauses]) for k in (2, 5, 6))
        totals = sums[last] - sums[first]
        mixed = self._mixed(sums, totals, latin, first, last)
        chosen, gaps = self._chosen(totals, latin)
        out = []
        for text, a, b in zip(texts, cuts, cuts[1:], strict=False):
            if b - a > 1 and latin[a:b].sum() > 1 and len(set(chosen[a:b][latin[a:b]])) > 1 or mixed[a:b].any():
                out.append(self._slowly(text, clauses[a:b], sums, mixed[a:b]))
            else:
                out.append(self._merged(clauses[a:b], chosen[a:b], gaps[a:b]))
        return out

    def _mixed(self, sums: np.ndarray, totals: np.ndarray, latin: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Clauses in Latin letters within which languages may change (where punctuation was lost)."""
        places = self._of[True][0]
        out = np.zeros(len(latin), bool)
        long = np.flatnonzero(latin & (last - first > GROUP))
        if len(places) > 1 and len(long):
            groups = -(-(last[long] - first[long]) // GROUP)
            begins = np.cumsum(groups) - groups
            of = np.repeat(np.arange(len(long)), groups)
            start = first[long][of] + GROUP * (np.arange(len(of)) - begins[of])
            scores = (sums[np.minimum(start + GROUP, last[long][of])] - sums[start])[:, places]
            best = totals[long][:, places].argmax(axis=1)
            out[long] = np.maximum.reduceat(scores.max(axis=1) - scores[np.arange(len(of)), best[of]], begins) > SWITCH / 2
        return out

    def _chosen(self, totals: np.ndarray, latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row, and by how much it is better than the next of those written alike."""
        every = np.arange(len(totals))
        chosen = np.where(latin, self._of[True][0][totals[:, self._of[True][0]].argmax(axis=1)], self._of[False][0][totals[:, self._of[False][0]].argmax(axis=1)])
        return chosen, self._gaps(totals, latin, chosen, every)

    @staticmethod
    def _gaps(totals: np.ndarray, latin: np.ndarray, chosen: np.ndarray, every: np.ndarray) -> np.ndarray:
        rivals = np.where(latin[:, None] == _IS_LATIN[None], totals, -np.inf)
        rivals[every, chosen] = -np.inf
        return totals[every, chosen] - rivals.max(axis=1)

    @staticmethod
    def _merged(units: list, chosen: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        """Stretches of units (start, end, .., number of words at 4) in a row."""
        out: list[list] = []
        for unit, at, gap in zip(units, chosen.tolist(), gaps.tolist(), strict=True):
            lang = LANGS[at]
            if out and out[-1][2] == lang:
                out[-1][1] = unit[1]
                out[-1][3] += gap
                out[-1][4] += unit[4]
            else:
                out.append([unit[0], unit[1], lang, gap, unit[4]])
        return [(a, b, lang, round(1 / (1 + math.exp(-max(-30.0, min(30.0, gap)))), 4), n) for a, b, lang, gap, n in out]

    def _slowly(self, text: str, clauses: list[list], sums: np.ndarray, mixed: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        """Stretches of a text whose clauses in Latin letters differ: they are labelled together, and cut where languages change within."""
        places = self._of[True][0]
        units: list[list] = []
        for clause, differ in zip(clauses, mixed.tolist(), strict=True):
            start, end, _, kind, _, a, b = clause
            path = self._viterbi((sums[a + 1 : b + 1] - sums[a:b])[:, places].tolist()) if differ else [0]
            cuts = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
            if len(cuts) > 2:
                spans = [m.span() for m in re.finditer(r"\S+", text[start:end]) if self.model.latin[m.group()] >= 0]
                units += [[start + spans[i][0], start + spans[j - 1][1], True, kind, j - i, a + i, a + j] for i, j in zip(cuts, cuts[1:], strict=False)]
            else:
                units.append(clause)
        latin, first, last = (np.array([c[k] for c in units]) for k in (2, 5, 6))
        totals = sums[last] - sums[first]
        chosen, _ = self._chosen(totals, latin)
        if latin.any():
            chosen[latin] = places[self._viterbi(totals[latin][:, places].tolist())]
        return self._merged(units, chosen, self._gaps(totals, latin, chosen, np.arange(len(units))))

    def _viterbi(self, sums: list[list[float]]) -> list[int]:
        best, back = sums[0], []
        for s in sums[1:]:
            top = max(range(len(best)), key=best.__getitem__)
            came = [top if best[top] - SWITCH > best[k] else k for k in range(len(s))]
            back.append(came)
            best = [max(best[k], best[top] - SWITCH) + s[k] for k in range(len(s))]
        at = max(range(len(best)), key=best.__getitem__)
        out = [at]
        for came in reversed(back):
            at = came[at]
            out.append(at)
        return out[::-1]

    def label(self, text: str, damaged: bool = False) -> tuple[str, float, list[tuple[int, int, str, float, int]]]:
        return self.labels([text], [damaged])[0]

    def labels(self, texts: list[str], damaged: list[bool]) -> list[tuple[str, float, list[tuple[int, int, str, float, int]]]]:
        return [self._label(*x) for x in zip(texts, damaged, self.all_stretches(texts), strict=True)]

    def _label(self, text: str, damaged: bool, found: list) -> tuple[str, float, list[tuple[int, int, str, float, int]]]:
        """The text's label (languages with at least a sixth of the words, joined by +), its confidence, its stretches.

        What is left of a misreading in two-byte signs is no Chinese: in a damaged text of another language it doesn't count. A text of
        which nothing but lost bytes is left has the column's own language, with a confidence of a half.
        """
        if damaged and any(x != "zh" and n for _, _, x, _, n in found):
            found = [x for x in found if x[2] != "zh"]
        words: dict[str, int] = {}
        sure: dict[str, float] = {}
        for _, _, lang, confidence, n in found:
            words[lang] = words.get(lang, 0) + n
            sure[lang] = max(sure.get(lang, 0.0), confidence)
        total = sum(words.values())
        if not total:
            lost = mojibake.LOST in text
            return (self.allowed[0] if lost else NO_WORDS), 0.5 if lost else 1.0, []
        held = sorted(x for x, n in words.items() if n and n >= total * PART - 1e-9)
        return "+".join(held), min(sure[x] for x in held), found


def _blank(texts: pa.Array) -> pa.Array:
    return pc.invert(pc.match_substring_regex(texts, r"[^\s\x{0085}\p{Z}]"))


_KEPT: dict[int, tuple] = {}


def _loaded(shared: Broadcast, tables: Broadcast, allowed: tuple[tuple[str, ...], ...]) -> tuple[list[Identifier], frequencies.Frequencies]:
    """Identifiers and frequencies; a worker keeps them, with the words they have scored, from task to task."""
    if _KEPT.get(0, (None,))[0] is not shared.value:
        own = Model(*shared.value)
        _KEPT[0] = shared.value, [Identifier(own, x) for x in allowed], frequencies.Frequencies(tables.value)
    return _KEPT[0][1:]


def identify(df: DataFrame, id_col: str, fields: dict[str, str], allowed_of: dict[str, tuple[str, ...]], stretches: bool = False, sample: int = SAMPLE) -> DataFrame:
    """The language of each text.

    fields: text column to label column. allowed_of: for each text column the languages that its labels know, its own one first.
    Gives id, field_name, given (its label, may be null), lang, confidence; with ``stretches`` a row for each stretch of one
    language: id, field_name, start_pos, end_pos (code points of the text, of the repaired one if it was damaged), lang,
    confidence. Null, empty and blank texts give no row; a text without words has the language zxx. The machines are trained on
    about ``sample`` rows of each label. Damage is judged as by garbled.restore of the same columns.
    """
    names = list(fields)
    rows = df.select(F.col(id_col).alias("k"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(names)), *(F.col(fields[c]).alias(f"g{i}") for i, c in enumerate(names)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"t{i}").alias("text"), F.col(f"g{i}").alias("label")) for i in range(len(names)))))
    labelled, counts = sampling.by_label(rows.select("k", each.alias("x")).select(F.struct("k", "x.field").alias("k"), "x.text", "x.label"), "k", "label", "text", list(LANGS), sample)
    screen = mojibake.suspicious()
    tables = frequencies.load(frequencies.count_corpus(df, names, screen))
    known = frequencies.Frequencies(tables.value)
    model = train([(t, g) for t, g in labelled if not mojibake.undo(t, known)[1]], counts)
    shared = rows.sparkSession.sparkContext.broadcast((list(model.index), model.weights, model.biases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = _loaded(shared, tables, tuple(allowed_of[c] for c in names))
        for b in batches:
            ids = b.column(0)
            for i, name in enumerate(names):
                texts, given = b.column(1 + i), b.column(1 + len(names) + i).to_pylist()
                skip, suspect = (pc.fill_null(x, y).to_pylist() for x, y in ((_blank(texts), True), (pc.match_substring_regex(texts, screen), False)))
                of, labels, sure, spans = [], [], [], []
                asked = [(j, *(mojibake.undo(text, known)[:2] if suspect[j] else (text, False))) for j, text in enumerate(texts.to_pylist()) if not skip[j]]
                for at in range(0, len(asked), CHUNK):
                    numbers, wholes, damaged = zip(*asked[at : at + CHUNK], strict=True)
                    for j, (label, confidence, found) in zip(numbers, by[i].labels(wholes, damaged), strict=True):
                        if stretches:
                            spans += found
                            of += [j] * len(found)
                        else:
                            of.append(j)
                            labels.append(label)
                            sure.append(confidence)
                if of:
                    keys = ids.take(pa.array(of))
                    field = pa.array([name] * len(of))
                    if stretches:
                        start, end, lang, confidence, _ = zip(*spans, strict=True)
                        yield pa.RecordBatch.from_arrays([keys, field, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang), pa.array(confidence)], ["k", "field_name", "start_pos", "end_pos", "lang", "confidence"])
                    else:
                        yield pa.RecordBatch.from_arrays([keys, field, pa.array([given[j] for j in of], pa.string()), pa.array(labels), pa.array(sure)], ["k", "field_name", "given", "lang", "confidence"])

    kind = rows.schema["k"].dataType.simpleString()
    columns = "start_pos int, end_pos int, lang string, confidence double" if stretches else "given string, lang string, confidence double"
    return rows.mapInArrow(run, f"k {kind}, field_name string, {columns}").withColumnRenamed("k", id_col)


def wrong_labels(identified: DataFrame) -> DataFrame:
    """The rows of identify whose label is missing or not the right one, a row for each language of the right one."""
    bad = identified.where("given IS NULL OR given <> lang")
    return bad.select(*[c for c in bad.columns if c not in ("given", "lang", "confidence")], F.explode(F.split("lang", "\\+")).alias("lang"), "confidence")
