"""Garbled text from wrong character encoding (problem 1): the channel, without Spark.

The noisy channel: text was written as UTF-8, its bytes were read in another encoding, once or several times, and some bytes were
lost on the way (they became U+FFFD, or vanished). ``layer`` proposes the reading that was taken, whose bytes make the lattice: every
word stands there as stored and as the bytes say. ``judged`` searches for the best path through a text's words under the word
frequencies of the corpus, which tells what of it is damaged; ``Decoder`` does the same for the bytes of a word, lost ones being wildcards.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

from .frequencies import END, SPELLED, START, words_of
from .lexicon import Lexicon

LOST = "\ufffd"
# --- fixed values: encodings that UTF-8 bytes get read in, likelier ones first -----------------------------------------
SINGLE_BYTE = (
    "cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "koi8_u", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15",
    "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "cp852", "cp855", "cp874", "iso8859_3", "iso8859_4", "iso8859_10", "iso8859_13", "iso8859_14", "iso8859_16", "mac_cyrillic", "mac_latin2", "mac_greek", "mac_turkish", "mac_iceland", "cp857", "cp858", "cp860", "cp861", "cp863", "cp865", "tis_620",
)
DOUBLE_BYTE = ("gb18030", "big5", "shift_jis", "cp932", "euc_kr", "cp949", "euc_jp", "big5hkscs")
#: Blocks of the scripts that the corpora are written in, and of the signs that stand between them.
SCRIPTS = ((0x0D00, 0x0D7F), (0x0900, 0x097F), (0x0B80, 0x0BFF), (0x4E00, 0x9FFF))
LATIN = ((0x00C0, 0x024F), (0x0300, 0x036F), (0x1E00, 0x1EFF))
SIGNS = ((0x00A0, 0x00BF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x2460, 0x25FF), (0x3000, 0x303F), (0xFF00, 0xFFEF), (0xFEFF, 0xFEFF))
#: Signs and letters that sound text holds and that no encoding above reads a lead byte of these scripts as.
COMMON = "\u00a0\u00ad‘’“”…–—«»ñāēīōūŭśḍḷḻṁṅṇṟṣṭṯĀĒĪŌŪŬŚḌḶḺṀṄṆṞṢṬṮÑ"
#: Bytes with which the letters of the scripts begin: two of a cut letter speak for it.
BEGINNINGS = (b"\xe0\xb4", b"\xe0\xb5", b"\xe0\xa4", b"\xe0\xa5", b"\xe0\xae", b"\xe0\xaf", b"\xe1\xb8", b"\xe1\xb9")
# ----------------------------------------------------------------------------------------------------------------------
#: What a byte that vanished without a mark costs, in nats; what a letter costs that stays lost.
DROPPED, UNKNOWN = 6.0, -16.0
#: What it costs, in nats, that a stretch of a text is read wrongly, before its words are asked.
MISREAD = 10.0
#: The part of a corpus that a letter must make to be guessed for lost bytes, so at most 1 / SEEN letters are.
SEEN = 2.0**-20
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\xe0-\xef][\x80-\xbf]|[\x80-\xff]")


def _within(code: int, blocks: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= code <= b for a, b in blocks)


@lru_cache(maxsize=64)
def byte_of(codec: str) -> dict[str, int]:
    """Characters from 0x80 that the encoding reads single bytes as; bytes that it lacks stay controls."""
    table: dict[str, int] = {chr(b): b for b in range(0x80, 0xA0)}
    if codec == "cp1252":
        table |= {chr(b): b for b in range(0xA0, 0x100)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


#: What the likelier encodings read bytes as.
_MISREAD = frozenset(c for codec in SINGLE_BYTE[:5] for c in byte_of(codec) if c > "\u009f")


@lru_cache(maxsize=4096)
def plausible(char: str) -> float:
    """How well a decoded character speaks for the decoding: 1 for letters of the scripts, less for others, below 0 against."""
    code = ord(char)
    if _within(code, SCRIPTS[:3]) or _within(code, ((0x1E00, 0x1EFF), (0x0100, 0x017F), (0x0300, 0x036F))):
        return 1.0
    if _within(code, SCRIPTS[3:]) or _within(code, LATIN) or _within(code, SIGNS):
        return 0.8
    return 0.55 if char in _MISREAD else 0.25  # perhaps a sign of another misreading below this one


@lru_cache(maxsize=64)
def _pairs(codec: str) -> re.Pattern:
    """A lead byte and a byte that continues it, or one that is lost, as the encoding reads them."""
    table = byte_of(codec)
    leads, rest = ("".join(re.escape(c) for c, b in table.items() if a <= b <= z) for a, z in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"[{leads}][{rest}{LOST}]")


@lru_cache(maxsize=1)
def suspicious() -> str:
    """A regular expression, for Python and RE2, of the signs of damage: a text without a match is sound.

    Lost bytes, controls, private characters, East Asian signs (which may be Chinese), or a lead byte with what may follow it.
    """
    leads, rest = set(), {chr(b) for b in range(0x80, 0xA0)} | {LOST}
    for codec in SINGLE_BYTE:
        for char, b in byte_of(codec).items():
            if 0xC2 <= b <= 0xF4:
                leads.add(char)
            elif b < 0xC0:
                rest.add(char)
    first, second = ("".join(map(re.escape, sorted(x))) for x in (leads - set(COMMON), rest))
    return f"[\u0080-\u009f{LOST}\ue000-\uf8ff\u3100-\u9fff\uac00-\ud7af]|[{first}][{second}]"


#: Cyrillic and Greek letters that stand for Latin ones in sound text.
_LOOK_ALIKE = frozenset("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈοανικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_DOUBLE_RUN = re.compile("[\u3000-\u9fff\uac00-\ud7af\ue000-\ufaff\ufe30-\ufe4f\uff01-\uffef\u00a4\u00a7\u00a8\u00b0\u00b1\u00b7\u00d7\u00e0-\u00fc\u0391-\u03c9\u0401-\u0451\u2010-\u2642\ufffd]+")


@lru_cache(maxsize=1)
def _suspicious() -> re.Pattern:
    return re.compile(suspicious())


def _decode(data: list[int]) -> tuple[str, float, int]:
    """Bytes (LOST is -1) as UTF-8: text with LOST for what is broken, evidence for the reading, bytes that fit nowhere.

    A letter that a lost byte cut short counts a little for the reading.
    """
    raw = bytes([b if b >= 0 else 0x1A for b in data])
    try:  # nothing is broken
        text = raw.decode("utf-8")
        if "\x1a" not in text:
            return text, sum(plausible(c) * (0.7 if c < "\u0800" else 1.0) for c in text if c > "\x7f"), 0
    except UnicodeDecodeError:
        pass
    out, evidence, broken, at = [], 0.0, 0, 0
    for m in _SEQUENCE.finditer(raw):
        out.append(raw[at : m.start()].decode("ascii", "replace"))
        at = m.end()
        part = m.group()
        try:
            char = part.decode("utf-8")
            out.append(char)
            evidence += plausible(char) * (1.0 if len(part) > 2 else 0.7)
        except UnicodeDecodeError:
            out.append(LOST)
            cut = part in BEGINNINGS
            broken += not cut
            evidence += 0.3 if cut else -0.45
    out.append(raw[at:].decode("ascii", "replace"))
    return "".join(out).replace("\x1a", LOST), evidence, broken


#: Stretches of a text: as stored, as read rightly (the same if sound), and the bytes if some may be lost.
Pieces = list[tuple[str, str, list[int] | None]]


def _joined(text: str, runs: list[tuple[int, int, list[int], str, float, int]]) -> tuple[float, int, str, Pieces]:
    """Score, broken bytes, text and pieces of a reading, of its runs (start, end, bytes, decoded, evidence, broken).

    Where the reading is certain from other runs, runs of cut letters go with it.
    """
    score = sum(r[4] for r in runs if r[4] > 0)
    broken, out, pieces, at = 0, [], [], 0
    for start, end, data, fixed, evidence, bad in runs:
        if evidence > 0 or (score >= 2 and (data[0] >= 0xC2 or -1 in data) and not any(c > "\x7f" and c != LOST for c in fixed)):
            broken += bad
            sound = text[at:start]
            out += [sound, fixed]
            pieces += [(sound, sound, None), (text[start:end], fixed, data)]
            at = end
    rest = text[at:]
    return score, broken, "".join([*out, rest]), [*pieces, (rest, rest, None)]


@lru_cache(maxsize=64)
def _to_bytes(codec: str) -> dict[int, int]:
    """For translate: characters to the bytes they were read from; others below U+0100 are moved out of the way."""
    return {b: 0xF0000 + b for b in range(0x80, 0x100)} | {ord(c): b for c, b in byte_of(codec).items()}


_HIGH = re.compile("[\u0080-\u00ff\ufffd]+")


def _side_by_side(text: str, fixed: str) -> Pieces:
    """Pieces word by word: a blank is never part of a sign of several bytes."""
    gap = (" ", " ", None)
    return [x for old, new in zip(text.split(" "), fixed.split(" "), strict=True) for x in ((old, new, None), gap)][:-1]


@lru_cache(maxsize=1 << 16)
def _decoded(run: str) -> tuple[list[int], str, float, int]:
    """The bytes of a run that shows them, and what _decode says of them."""
    data = [-1 if c == LOST else ord(c) for c in run]
    return data, *_decode(data)


def _single(text: str, shown: str) -> tuple[float, int, str, Pieces]:
    """shown: the text with each character that may stand for a byte as the character of that number."""
    try:
        fixed = shown.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    else:  # the whole text is damaged, and no byte is lost
        high = [c for c in set(fixed) if c > "\x7f"]
        if high:
            return len(re.sub("[\\x00-\\x7f]+", "", fixed)) * sum(map(plausible, high)) / len(high) * (0.7 if max(high) < "\u0800" else 1.0), 0, fixed, _side_by_side(text, fixed)
    runs = []
    for m in _HIGH.finditer(shown):
        run = m.group()
        if (max(run.replace(LOST, ""), default="") >= "\u00c2" or (LOST in run and len(set(run)) > 1)) and not _LOOK_ALIKE.issuperset(text[m.start() : m.end()]):
            runs.append((m.start(), m.end(), *_decoded(run)))
    return _joined(text, runs)


def _double(text: str, codec: str) -> tuple[float, int, str, Pieces]:
    runs = []
    for m in _DOUBLE_RUN.finditer(text):
        data: list[int] = []
        try:
            for c in m.group():
                data += [-1] if c == LOST else c.encode(codec)
        except UnicodeEncodeError:
            continue
        fixed, evidence, bad = _decode(data)
        # sound Chinese, two bytes a sign, seldom makes whole sequences of three
        whole = sum(c > "\x7f" and c != LOST for c in fixed)
        runs.append((m.start(), m.end(), data, fixed, evidence if bad * 5 <= whole else min(evidence, -0.1), bad))
    return _joined(text, runs)


@lru_cache(maxsize=1)
def _beginnings() -> tuple[tuple[str, tuple[tuple[str, frozenset[str]], ...]], ...]:
    """For each encoding what it reads the first byte, and those that may come second, of letters of the scripts as."""
    families = [(b, range(0x80, 0xC0)) for b in (0xC3, 0xC4, 0xC5, 0xC2, 0xCC, 0xCD, 0xCE, 0xCF, 0xD0, 0xD1, *range(0xE3, 0xEA), 0xEF)]
    families += [(0xE0, (0xB4, 0xB5, 0xA4, 0xA5, 0xAE, 0xAF)), (0xE1, range(0xB8, 0xBC)), (0xE2, range(0x80, 0x9A))]
    out = []
    for codec in SINGLE_BYTE:
        chars: dict[int, set[str]] = {}
        for c, b in byte_of(codec).items():
            chars.setdefault(b, set()).add(c)
        out.append((codec, tuple((lead, frozenset(c for b in seconds for c in chars.get(b, ()))) for first, seconds in families for lead in chars.get(first, ()))))
    return tuple(out)


def _clean(fixed: str, before: set[str], broken: int) -> bool:
    """Whether a reading brought up letters of the scripts only (or controls, of another misreading below), and broke nothing or left
    nothing that looks damaged.
    """
    if any(plausible(c) < 0.5 and c > "\x9f" for c in set(fixed) - before if c > "\x7f" and c != LOST):
        return False
    return not broken or not _suspicious().search(fixed.replace(LOST, ""))


def layer(text: str) -> tuple[str, Pieces] | None:
    """The text with one wrong reading undone and its pieces (sound text, or bytes), or None if nothing speaks for one."""
    best: tuple[float, int, str, Pieces] = (0.0, 0, "", [])
    signs = {c for c in set(text) if c > "\x7f"}
    held = {c: text.count(c) for c in signs}
    ranked = []
    for place, (codec, pairs) in enumerate(_beginnings()):
        weight = sum(held[lead] for lead, seconds in pairs if lead in held and not signs.isdisjoint(seconds))
        if weight:
            ranked.append((-weight, place, codec))
    top = -math.inf

    def rank(found: tuple[float, int, str, Pieces]) -> float:
        """Evidence, less what is broken, what belongs to no script here, and what still looks damaged."""
        if found[0] < 0.5:
            return -math.inf
        strange = sum(found[2].count(c) for c in set(found[2]) - signs if c > "\x9f" and plausible(c) < 0.5)
        return found[0] - 1.2 * found[1] - 0.5 * strange - 0.25 * len(_suspicious().findall(found[2].replace(LOST, "")))

    tried = set()
    for _, _, codec in sorted(ranked):
        if _pairs(codec).search(text):
            shown = text.translate(_to_bytes(codec))
            if shown not in tried:
                tried.add(shown)
                found = _single(text, shown)
                if (score := rank(found)) > top:
                    best, top = found, score
                    if found[0] >= 0.5 and found[1] * 8 <= found[0] and found[2].count(LOST) <= text.count(LOST) and _clean(found[2], signs, found[1]):
                        break  # all of the damage, or nearly, is undone
    if any("\u3000" <= c <= "\uf8ff" for c in signs):
        for codec in DOUBLE_BYTE:
            found = _double(text, codec)
            if (score := rank(found)) > top:
                best, top = found, score
    return (best[2], best[3]) if best[0] >= 0.5 else None


def _words(pieces: Pieces) -> list[tuple[str, str, Pieces, bool]]:
    """(as stored, as read, pieces, whether these differ) of stretches of a text, which are cut where both have the same white space."""
    out: list[tuple[str, str, Pieces, bool]] = []
    open_: Pieces = []

    def close() -> None:
        if open_:
            old, new = ("".join(p[k] for p in open_) for k in (0, 1))
            out.append((old, new, list(open_), old != new or any(p[2] is not None for p in open_)))
            open_.clear()

    for old, new, data in pieces:
        if data is None and old == new:
            first, last = re.search(r"\s", old), max(old.rfind(" "), old.rfind("\n"))
            if first is None:
                if old:
                    open_.append((old, new, None))
                continue
            start = first.start()
            if start:
                open_.append((old[:start], new[:start], None))
            close()
            if start < last:
                middle = old[start:last]
                out.append((middle, middle, [(middle, middle, None)], False))
            start = max(start, last)
            open_.append((old[start:], old[start:], None))
        else:
            open_.append((old, new, data))
    close()
    return out


def _loss(text: str, frequencies) -> float:  # noqa: ANN001
    return sum(map(frequencies.word, words_of(text)))


def chosen(pieces: Pieces, frequencies) -> Pieces | None:  # noqa: ANN001
    """The best path through the lattice of a text: its words as stored or as read, by the word frequencies; None if all is sound.

    A stretch that is read otherwise than what stands before it costs MISREAD.
    """
    words = _words(pieces)
    sound, wrong, back = 0.0, -MISREAD, []
    for old, new, _, differ in words:
        gain = _loss(new, frequencies) - _loss(old, frequencies) if differ else 0.0
        to_sound, to_wrong = wrong > sound, sound - MISREAD > wrong
        back.append((to_sound, to_wrong))
        sound, wrong = max(sound, wrong), max(wrong, sound - MISREAD) + gain
    state, out, any_ = wrong > sound, [], False
    for (old, _, parts, differ), (to_sound, to_wrong) in zip(reversed(words), reversed(back), strict=True):
        out.append(parts if state else [(old, old, None)])
        any_ |= state and differ
        state = not to_wrong if state else to_sound
    return [p for parts in reversed(out) for p in parts] if any_ else None


def undo(text: str, frequencies, depth: int = 3) -> tuple[str, bool, Pieces]:  # noqa: ANN001
    """The text with up to depth wrong readings undone, whether there was any damage, and the pieces of the last reading."""
    damaged, pieces, sign = LOST in text, [(text, text, None)], _suspicious()
    for _ in range(depth):
        found = layer(text) if sign.search(text) else None
        path = None if found is None else chosen(found[1], frequencies)
        if path is None:
            break
        pieces, damaged = path, True
        text = "".join(p[1] for p in path)
    return text, damaged, pieces


def _needs(byte: int) -> int:
    return 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0


_ATOM = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x00-\x7f]+|[\x80-\xff]")
#: Stands for all letters that the search doesn't guess.
_OTHER = "\x00"
_ALPHABETS = {"ml": SCRIPTS[:1], "hi": SCRIPTS[1:2], "ta": SCRIPTS[2:3], "latn": (*LATIN, (0x61, 0x7A), (0x41, 0x5A))}
_PUNCTUATION = ((0x2010, 0x2026),)


def _fits(pattern: tuple[int, ...], codes: np.ndarray) -> np.ndarray:
    """Which letters' UTF-8 bytes fit a pattern, in which -1 is any byte."""
    if len(pattern) == 2:
        data, inside = (0xC0 | codes >> 6, 0x80 | codes & 63), (codes >= 0x80) & (codes < 0x800)
    else:
        data, inside = (0xE0 | codes >> 12, 0x80 | codes >> 6 & 63, 0x80 | codes & 63), (codes >= 0x800) & (codes < 0x10000)
    for p, b in zip(pattern, data, strict=True):
        if p >= 0:
            inside = inside & (b == p)
    return inside


class Letters:
    """What letters cost after two others, for the letters of a script that the corpora have, as one array."""

    def __init__(self, frequencies, script: str) -> None:  # noqa: ANN001
        inside = [chr(c) for a, b in (*_ALPHABETS[script], *_PUNCTUATION) for c in range(a, b + 1)]
        self.frequencies = frequencies
        self.chars = [chr(START), _OTHER, LOST, *(c for c in inside if frequencies.share(c) >= SEEN)]
        self.place = {c: i for i, c in enumerate(self.chars)}
        self.codes = n = np.array([ord(c) for c in self.chars], np.int64)
        # [last letter, next letter, letter before the last]; of contexts that hold one of the others nothing is known: the letter's share tells
        self.after = frequencies.letters_after(n[None, None, :], n[:, None, None], n[None, :, None]).astype(np.float32)
        self.end = frequencies.letters_after(n[None], n[:, None], np.array(END)).astype(np.float32)
        self._fit: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}

    def cost(self, char: str, live: np.ndarray) -> np.ndarray:
        """Of a letter after the letters ``live``, by the letter before them."""
        at = self.place.get(char)
        return self.after[live, at] if at is not None else np.full((len(live), 1), math.log(self.frequencies.share(char) + 1e-9), np.float32)

    def _of(self, pattern: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if pattern not in self._fit:
            if len(self._fit) > 256:
                self._fit.clear()
            at = np.flatnonzero(_fits(pattern, self.codes) & (self.codes != ord(LOST)))
            self._fit[pattern] = at, np.ascontiguousarray(self.after[:, at])
        return self._fit[pattern]

    def fit(self, pattern: tuple[int, ...]) -> np.ndarray:
        """Places of the letters whose bytes fit the pattern."""
        return self._of(pattern)[0]

    def fitting(self, pattern: tuple[int, ...], live: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """What these cost after the letters ``live``, by the letters ``firsts`` before them."""
        out = self._of(pattern)[1]
        return out[live] if len(firsts) == out.shape[2] else out[live][:, :, firsts] if len(live) < len(firsts) else out[:, :, firsts][live]


class Decoder:
    """Finds the likeliest text over a lattice of bytes, lost ones being wildcards.

    A word is as likely as its part of the corpus, if it is in the dictionary, or else by its letters (frequencies.Frequencies.word);
    both searches are exact: that of the letters keeps every pair of last letters at every place, that of the dictionary every beginning.
    """

    def __init__(self, frequencies) -> None:  # noqa: ANN001
        self.frequencies = frequencies
        self._lexicon: Lexicon | None = None
        self._letters: dict[str, Letters] = {}
        self._tokens: dict[tuple, str] = {}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.frequencies.words, np.log(self.frequencies.counts / self.frequencies.n_words))
        return self._lexicon

    def letters(self, script: str) -> Letters:
        if script not in self._letters:
            self._letters[script] = Letters(self.frequencies, script)
        return self._letters[script]

    @staticmethod
    def edges(atoms: tuple, sizes: tuple[int, ...]) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place of lost bytes (atoms taken, byte pattern, cost) of the letters that may begin there; none where a letter stands."""
        every: list[list[tuple[int, tuple[int, ...], float]]] = []
        for at, first in enumerate(atoms):
            out: list[tuple[int, tuple[int, ...], float]] = []
            every.append(out)
            if isinstance(first, str):
                continue
            tail = []
            for x in atoms[at + 1 : at + 3]:
                if isinstance(x, str) or not (x == -1 or 0x80 <= x <= 0xBF):
                    break
                tail.append(x)
            if first == -1 or 0x80 <= first <= 0xBF:  # the lead byte is lost, marked or not
                known = [first, *tail]
                for size in sizes:
                    for k in range(1, min(size, len(known)) + 1):
                        part = known[:k]
                        if part[0] == -1:  # one mark may stand for a whole cut letter
                            out.append((k, (*part, *[-1] * (size - k)) if k == 1 or part[1] == -1 else (*[-1] * (size - k + 1), *part[1:]), 0.0))
                        elif k < size:
                            out.append((k, (*[-1] * (size - k), *part), DROPPED))
            else:
                size = _needs(first)
                if size in (2, 3):
                    k = min(size - 1, len(tail))
                    out.append((1 + k, (first, *tail[:k], *[-1] * (size - 1 - k)), DROPPED * (k < size - 1)))
                    if size == 3 and k == 1:  # the byte that vanished stood between
                        out.append((2, (first, -1, tail[0]), DROPPED))
        return every

    def spelled(self, atoms: tuple, edges: list, script: str, floor: float = -math.inf) -> tuple[float, str]:
        """Score and text of the likeliest word by its letters, if it is likelier than floor: Viterbi search over the places and pairs of letters.

        Scores only fall, so a beginning that has come down to the floor is left.
        """
        letters, n = self.letters(script), len(atoms)
        size, lost, other = len(letters.chars), letters.place[LOST], letters.place[_OTHER]
        score: list[np.ndarray | None] = [None] * (n + 1)  # by the last letter and the one before it
        score[0] = np.full((size, size), -np.inf, np.float32)
        score[0][0, 0] = 0.0
        before: list[list[tuple[int, np.ndarray, float]]] = [[] for _ in range(n + 1)]  # (place, letters, cost) of the edges that end at a place

        floor = np.float32(floor - SPELLED)

        def go(at: int, to: int, live: np.ndarray, into: np.ndarray, top: np.ndarray, price: float) -> None:
            before[to].append((at, into, price))
            if score[to] is None:
                score[to] = np.full((size, size), -np.inf, np.float32)
            grid = into[:, None], live[None]
            score[to][grid] = np.maximum(score[to][grid], top - np.float32(price) if price else top)

        for at, atom in enumerate(atoms):
            now = score[at]
            if now is None:
                continue
            hopeful = now > floor
            live, firsts = np.flatnonzero(hopeful.any(axis=1)), np.flatnonzero(hopeful.any(axis=0))
            if not len(live):
                continue
            now = now[live[:, None], firsts]
            if isinstance(atom, str):
                c = letters.place.get(atom, other)
                cost = letters.cost(atom, live)
                go(at, at + 1, live, np.array([c]), (now + (cost[:, firsts] if c != other else cost)).max(axis=1)[None], 0.0)
                continue
            go(at, at + 1, live, np.array([lost]), now.max(axis=1)[None], -UNKNOWN)
            made: dict[tuple[int, ...], np.ndarray] = {}
            for taken, pattern, price in edges[at]:
                if len(into := letters.fit(pattern)):
                    if pattern not in made:
                        made[pattern] = (now[:, None] + letters.fitting(pattern, live, firsts)).max(axis=2).T
                    go(at, at + taken, live, into, made[pattern], price)
        if score[n] is None:
            return -math.inf, ""
        last = score[n] + letters.end
        if last.max() <= floor:
            return -math.inf, ""
        best, (b, a) = float(last.max()), np.unravel_index(int(last.argmax()), last.shape)
        out, at = [], n
        while at > 0:  # which way a state was reached is found again
            ways = []
            for place, into, price in before[at]:
                if b in into:
                    cost = np.float32(0) if b == lost and price == -UNKNOWN else letters.cost(atoms[place] if isinstance(atoms[place], str) else letters.chars[b], np.array([a]))[0]
                    came = score[place][a] + cost - np.float32(price)
                    first = int(came.argmax())
                    ways.append((float(came[first]), place, first))
            _, place, first = max(ways)
            out.append(atoms[place] if isinstance(atoms[place], str) else letters.chars[b])
            at, b, a = place, a, first
        return SPELLED + best, "".join(reversed(out))

    def listed(self, atoms: tuple, edges: list, floor: float = -math.inf) -> tuple[float, str]:
        """Score and text of the likeliest word of the dictionary, if it is likelier than floor, which bounds the search."""
        tree, n = self.lexicon, len(atoms)
        ends: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(1, np.int64), np.zeros(1))], *([] for _ in range(n))]
        best = (floor, "")
        for at in range(n + 1):
            if not ends[at]:
                continue
            nodes, score = (np.concatenate(x) for x in zip(*ends[at], strict=True)) if len(ends[at]) > 1 else ends[at][0]
            kept = np.flatnonzero(score + tree.most[nodes] > floor)
            if not len(kept):
                continue
            nodes, score = nodes[kept], score[kept]
            if at == n:
                total = score + tree.ends[nodes]
                i = int(total.argmax())
                return (float(total[i]), tree.spelling(int(nodes[i]))) if total[i] > floor else best
            if len(ends[at]) > 1:  # the best of equal beginnings
                order = np.lexsort((-score, nodes))
                order = order[np.append(True, nodes[order][1:] != nodes[order][:-1])]
                nodes, score = nodes[order], score[order]
            if isinstance(atoms[at], str):
                of, to = tree.step(nodes, ord(atoms[at]))
                if len(of):
                    ends[at + 1].append((to, score[of]))
                continue
            if edges[at]:
                of, letter, to = tree.branch(nodes)
                for taken, pattern, price in edges[at]:
                    i = np.flatnonzero(_fits(pattern, letter))
                    if len(i):
                        ends[at + taken].append((to[i], score[of[i]] - price))
        return best

    def token(self, atoms: list, script: str = "ml") -> str:
        """The likeliest word of characters, bytes and lost bytes (-1); LOST where no letter is known to fit."""
        key = (tuple(atoms), script)
        if key not in self._tokens:
            if len(self._tokens) > 100_000:
                self._tokens.clear()
            edges = self.edges(key[0], (3, 2) if script == "latn" else (3,))
            score, text = self.listed(key[0], edges)
            self._tokens[key] = self.spelled(key[0], edges, script, score)[1] or text
        return self._tokens[key]

    def text(self, pieces: Pieces) -> str:
        """Text of the pieces with damaged words searched for."""
        atoms: list = []
        for _, fixed, data in pieces:
            if data is None:
                atoms += [-1 if c == LOST else c for c in fixed]
            else:
                raw = bytes([b if b >= 0 else 0x1A for b in data])
                for m in _ATOM.finditer(raw):
                    part = m.group()
                    try:
                        atoms += [-1 if c == "\x1a" else c for c in part.decode()]
                    except ValueError:
                        atoms += part
        whole = _script(atoms) or "ml"
        out, word = [], []
        for x in [*atoms, " "]:
            if isinstance(x, str) and (x.isspace() or x in ".,!?;:()\"“”‘’"):
                if word:
                    out.append("".join(word) if all(isinstance(c, str) for c in word) else self.token(word, _script(word) or whole))
                out.append(x)
                word = []
            else:
                word.append(x)
        return "".join(out)[:-1]


_LEADS = {0xB4: "ml", 0xB5: "ml", 0xA4: "hi", 0xA5: "hi", 0xAE: "ta", 0xAF: "ta"}


def _script(atoms: list) -> str:
    """The script of most letters of a word or text, whole or cut; empty if none tells."""
    held = dict.fromkeys(_ALPHABETS, 0)
    for i, x in enumerate(atoms):
        if isinstance(x, str):
            code = ord(x)
            if code < 0x250 or 0x1E00 <= code <= 0x1EFF:
                held["latn"] += x.isalpha()
            else:
                for name in ("ml", "hi", "ta"):
                    held[name] += _within(code, _ALPHABETS[name])
        elif x == 0xE0 and i + 1 < len(atoms) and atoms[i + 1] in _LEADS:
            held[_LEADS[atoms[i + 1]]] += 1
        elif x != -1 and (0xC3 <= x <= 0xCD or x == 0xE1):
            held["latn"] += 1
    most = max(held, key=held.__getitem__)
    return most if held[most] else ""


def repair(text: str, decoder: Decoder) -> tuple[str, bool, bool]:
    """(text as it was, whether it was damaged, whether all of it is back)."""
    fixed, damaged, pieces = undo(text, decoder.frequencies)
    if not damaged:
        return text, False, True
    if LOST in fixed:
        return decoder.text(pieces), True, False
    return fixed, True, True
