"""Sentence boundaries across languages and scripts (problem 6).

Terminal punctuation gives candidate boundaries; a maximum-entropy model classifies each by its neighbouring tokens, their case,
length, digits and script, and by how a quotation stands. It is trained on reliable boundaries: what stands before a line break or
the end of a text is certain. A model of the left side learns how candidates at line ends differ from all others (positive and
unlabelled examples: its probability over its mean at line ends is that of a boundary); its verdicts on candidates inside lines then
train the model of both sides. Quotations that close within their line hold no boundary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import canonical, frequencies, mojibake, sampling
from .maxent import MaxEnt

#: Texts of the training sample.
SAMPLE = 12_000
# --- fixed values: punctuation ----------------------------------------------------------------------------------------
TERMINAL = ".!?…।॥。！？｡．۔؟"
CLOSING = ")]}»”’\"'）」』】"
QUOTED = re.compile(r"“[^”\n]*”|‘[^’\n]*’|\"[^\"\n]*\"|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|„[^“\n]*“")
BREAKS = re.compile("[\\n\\r\\u2028\\u2029]+")
# ----------------------------------------------------------------------------------------------------------------------
_CANDIDATE = re.compile(f"[{re.escape(TERMINAL)}]+[{re.escape(CLOSING)}]*")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ALIKE = str.maketrans("".join(a for a, _ in canonical.LOOK_ALIKE), "".join(b for _, b in canonical.LOOK_ALIKE))
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_GAP = re.compile(r"\s*")
_AFTER = re.compile("[\u3040-\u30ff\u3400-\u9fff]{1,2}|[^\\s" + re.escape(TERMINAL) + "\u3040-\u30ff\u3400-\u9fff]*[" + re.escape(TERMINAL) + "]?[^\\s" + re.escape(TERMINAL) + "\u3040-\u30ff\u3400-\u9fff]*")
_LIST = re.compile(r"^\s*[(\[]?(?:\d{1,3}|[A-Za-z])[.)\]]\s*$")
_WORD = re.compile(r"[^\W\d_]")


def _script(char: str) -> str:
    code = ord(char)
    for name, a, b in (("ml", 0xD00, 0xD7F), ("hi", 0x900, 0x97F), ("ta", 0xB80, 0xBFF), ("zh", 0x3400, 0x9FFF)):
        if a <= code <= b:
            return name
    if char.isdigit():
        return "num"
    if char.isalpha():
        return "upper" if char.isupper() else "lower"
    return "space" if char.isspace() else "sign"


class Candidate:
    """A place in a line where a sentence may end: its end, and features of what stands before and behind it."""

    __slots__ = ("end", "left", "right")

    def __init__(self, end: int, left: tuple[str, ...], right: tuple[str, ...]) -> None:
        self.end, self.left, self.right = end, left, right


@lru_cache(maxsize=200_000)
def _plain(token: str) -> str:
    """The token without look-alikes, so that its spellings share what is learned."""
    for consonant, chillu in canonical.CHILLU:
        token = token.replace(consonant + "\u0d4d\u200d", chillu)
    token = unicodedata.normalize("NFKC", token.translate(_HIDDEN)).translate(_ALIKE)
    for drawn, one in canonical.DRAWN_ALIKE:
        token = token.replace(drawn, one)
    return token.replace(canonical.FOUR, canonical.CHILLU_RA)


@lru_cache(maxsize=200_000)
def _left(token: str, mark: str, quote: str, first: bool) -> tuple[str, ...]:
    token = _plain(token)
    out = [f"t={token}", f"s={token[-3:]}", f"s2={token[-2:]}", f"n={min(len(token), 6)}", f"m={mark[:3]}", f"q={quote}", f"n={min(len(token), 6)} m={mark[:1]}"]
    if token:
        out.append(f"c={_script(token[-1])} m={mark[:1]}")
        if any(c.isdigit() for c in token):
            out.append("digit")
        if "." in token:
            out.append("dotted")
        if token[0].isupper():
            out.append("capital")
    else:
        out.append("bare")
    if first:
        out.append("first")
    return tuple(out)


def _before(line: str, end: int) -> str:
    """The token that ends at a place: back to white space, over one sentence sign at most; of unspaced scripts two signs.

    So every token of a line is looked at a few times only, however long the line is.
    """
    start, signs = end, 0
    while start:
        char = line[start - 1]
        if char.isspace():
            break
        if _UNSPACED.match(char):
            if start == end:
                start -= 1 + (start > 1 and bool(_UNSPACED.match(line[start - 2])))
            break
        if char in TERMINAL:
            signs += 1
            if signs == 2:
                break
        start -= 1
    return line[start:end]


def _right(line: str, end: int) -> tuple[str, ...]:
    at = _GAP.match(line, end).end()
    if at == len(line):
        return ("end",)
    token = _plain(_AFTER.match(line, at).group())
    glued = "" if line[end].isspace() else "glued "
    return (f"{glued}c={_script(line[at])}", f"w={token}", f"w3={token[:3]}", *(("opens",) if line[at] in "“‘\"«「『" else ()))


def candidates(line: str) -> list[Candidate]:
    """Candidate boundaries of a line, which holds no line break; its end is none of them."""
    found = list(_CANDIDATE.finditer(line))
    if not found:
        return []
    indent = _GAP.match(line).end()

    def numbers(end: int) -> bool:
        """Whether the line up to there is the number of a list."""
        return end - indent < 12 and bool(_LIST.match(line[indent:end]))

    spans = []
    for m in QUOTED.finditer(line):
        at = m.start()
        while at and line[at - 1].isspace():
            at -= 1
        last = line[at - 1] if at else ""
        lead = "led" if last and last in ":：," else "opens" if not last or last in TERMINAL + CLOSING or numbers(at) else "within"
        spans.append((m.start(), m.end(), lead))
    opened = {a for a, _, _ in spans}
    out, quoted = [], 0
    for m in found:
        start, end, quote = m.start(), m.end(), "none"
        mark = m.group().rstrip(CLOSING)
        while quoted < len(spans) and spans[quoted][1] <= start:
            quoted += 1
        if quoted < len(spans) and spans[quoted][0] <= start:
            _, b, lead = spans[quoted]
            if start + len(mark) >= b - 1:  # the quotation closes here
                quote, end = lead, b
                while end < len(line) and line[end] in ")]}）":
                    end += 1
            else:
                quote = ""
        if not quote:
            continue
        if quote == "none" and end > start + len(mark):  # a quotation mark behind it may open the next one
            while end > start + len(mark) and line[end - 1] in "\"'" and end - 1 in opened:
                end -= 1
        token = _before(line, start).lstrip("([{“‘\"'«")
        out.append(Candidate(end, _left(token, mark, quote, numbers(end)), _right(line, end)))
    return out


def train(texts: list[str]) -> MaxEnt:
    """The model of both sides from a sample of texts."""
    inside, ends = [], []
    for text in texts:
        for line in BREAKS.split(text):
            for c in candidates(line.rstrip()):
                (ends if c.right == ("end",) else inside).append(c)
    left = MaxEnt.fit([c.left for c in ends] + [c.left for c in inside], [1.0] * len(ends) + [0.0] * len(inside))
    at_ends = sum(left.probability(c.left) for c in ends) / max(1, len(ends))
    verdicts = [min(1.0, left.probability(c.left) / max(at_ends, 1e-6)) for c in inside]
    rows = [c.left + c.right for c in inside] + [c.left + c.right for c in ends]
    return MaxEnt.fit(rows, [float(v > 0.4) for v in verdicts] + [1.0] * len(ends), rounds=40)


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


class Splitter:
    """Sentences of texts; verdicts on left sides are kept, as they come again and again."""

    def __init__(self, model: MaxEnt) -> None:
        self.model, self._known = model, {}

    def _ends(self, c: Candidate) -> bool:
        key = (c.left, c.right)
        if key not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = self.model.score(c.left + c.right) > 0
        return self._known[key]

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence, white space around it left out; nothing for a blank text."""
        if not _WORD.search(text):
            whole = _trim(text, 0, len(text))
            return [whole] if whole[0] < whole[1] else []
        out, at = [], 0
        for gap in [*BREAKS.finditer(text), None]:
            stop = gap.start() if gap else len(text)
            line, start = text[at:stop], 0
            for c in candidates(line):
                if c.end > start and c.right != ("end",) and self._ends(c):
                    out.append(_trim(text, at + start, at + c.end))
                    start = c.end
            out.append(_trim(text, at + start, stop))
            at = gap.end() if gap else stop
        return [x for x in out if x[0] < x[1]]


def split_sentences(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, corpus_cols: Sequence[str] = ()) -> DataFrame:
    """id, start_pos, end_pos (code points of the text as stored): every sentence of every text.

    Null, empty and blank texts, and texts that were decoded with a wrong encoding, give no row. The model is fitted on
    about ``sample`` texts, drawn by a hash of the id. Repeated rows give repeated rows. Damage is judged by the frequencies of
    the columns ``corpus_cols``, else of the text's own; with those of garbled.restore the verdicts are the same.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    screen = mojibake.suspicious()
    tables = frequencies.load(frequencies.count_corpus(df, list(corpus_cols) or [text_col], screen))
    known = frequencies.Frequencies(tables.value)
    model = train([t for t in sampling.texts(rows, "k", "t", sample) if not mojibake.undo(t, known)[1]])
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        splitter, known = Splitter(MaxEnt(shared.value)), frequencies.Frequencies(tables.value)
        for b in batches:
            at, starts, ends = [], [], []
            suspects = pc.match_substring_regex(b.column(1), screen).to_pylist()
            for i, text in enumerate(b.column(1).to_pylist()):
                if not (suspects[i] and mojibake.undo(text, known)[1]):
                    spans = splitter.split(text)
                    at += [i] * len(spans)
                    starts += [s for s, _ in spans]
                    ends += [e for _, e in spans]
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["k", "start_pos", "end_pos"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, start_pos int, end_pos int").withColumnRenamed("k", id_col)
