"""Same or near-same records across splits (problem 3).

Word sequences are compared by edit distance. Exact copies are first folded into classes. A pair of different texts whose
distance d is at most ``share`` of the longer one's words, with L words in the evaluation text, has d <= t for
t = floor(L * share / (1 - share)). The evaluation text is cut into t + 1 even segments of words, one of which must stand
unchanged in the training text, at a position that the edits before and behind it allow (multi-match-aware bounds). Training
substrings of the segments' lengths are kept if a Bloom filter of all segments may hold them, joined by hash, held in the join
against the bounds of position and length and against signatures of the words (so that a segment which very many texts share gives no
candidates of texts that differ elsewhere), and verified by banded dynamic programming over Arrow batches of pairs.

A hot segment, one that would make more than ``HOT`` pairs, is joined together with a rare word: texts within distance d of one another
have all but d words in common, so of any one order of the words, here by how frequent they are, the first d + 1 of both texts share one
(prefix filtering). The common phrase then brings together those texts only that share a rare word too, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut

from . import bloom

#: The greatest distance, as a share of the longer text's number of words.
SHARE = 0.2
#: Pairs that a segment may make before its texts must share a rare word as well; counters of words by which these are told.
HOT, SLOTS = 1 << 22, 1 << 16
#: Bytes of a word's code: two words that differ have the same one once in 2 ** 48.
CODE = 6
#: Cells of the dynamic programming table that are held at once.
CELLS = 2_000_000
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(1, 65)], np.uint64)


def allowed(words: int, share: float = SHARE) -> int:
    """Edits allowed for a longer text of so many words."""
    return int(words * share + 1e-9)


def most_edits(words: int, share: float = SHARE) -> int:
    """Edits that an evaluation text of so many words can be apart from any text within the share."""
    return int(words * share / (1 - share) + 1e-9)


def segments(words: int, share: float = SHARE) -> list[tuple[int, int]]:
    """(start, length) of the t + 1 segments, the longer ones last."""
    n = most_edits(words, share) + 1
    short, longer = divmod(words, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(maxsize=65536)
def lengths_needed(words: int, share: float = SHARE) -> tuple[int, ...]:
    """Lengths of the segments of all evaluation texts that a training text of so many words can be near to."""
    low, high = words - allowed(words, share), words + most_edits(words, share)
    return tuple(sorted({size for n in range(max(1, low), high + 1) for _, size in segments(n, share)[:: max(1, most_edits(n, share))]}))


def normal_words(texts: pa.Array) -> list[list[str]]:
    """Words between white space after all punctuation is deleted and case dropped."""
    plain = pc.utf8_lower(pc.replace_substring_regex(texts.cast(pa.large_string()), r"\p{P}+", ""))
    return [t.split() for t in plain.to_pylist()]


def word_table(df: DataFrame, id_col: str, text_col: str, group_col: str, side_col: str) -> DataFrame:
    """(k, grp, evaluation, cls, words): 16-byte class of the word sequence and CODE bytes for each word.

    Null texts and texts without words are left out.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(group_col).alias("grp"), F.col(side_col).alias("e"), F.col(text_col).alias("t"))
    rows = rows.where("t IS NOT NULL AND grp IS NOT NULL AND e IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, bytes] = {}
        for b in batches:
            kept, classes, packed = [], [], []
            for i, words in enumerate(normal_words(b.column(3))):
                if words:
                    for w in words:
                        if w not in codes:
                            if len(codes) > 500_000:
                                codes.clear()
                            codes[w] = xxhash.xxh3_64_digest(w)[:CODE]
                    kept.append(i)
                    classes.append(xxhash.xxh3_128_digest(" ".join(words)))
                    packed.append(b"".join([codes[w] if w in codes else xxhash.xxh3_64_digest(w)[:CODE] for w in words]))
            if kept:
                chosen = b.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*chosen.columns[:3], pa.array(classes, pa.binary()), pa.array(packed, pa.binary())], ["k", "grp", "evaluation", "cls", "words"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, grp string, evaluation boolean, cls binary, words binary")


def _codes(packed: bytes) -> np.ndarray:
    """The words' codes as numbers."""
    wide = np.zeros((len(packed) // CODE, 8), np.uint8)
    wide[:, :CODE] = np.frombuffer(packed, np.uint8).reshape(-1, CODE)
    return wide.view("<u8").ravel()


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows one after another, the rows' starts and lengths."""
    column = b.column(b.schema.get_field_index("words"))
    data = column.to_pylist()
    sizes = np.array([len(x) // CODE for x in data], np.int64)
    return _codes(b"".join(data)), np.cumsum(sizes) - sizes, sizes


def _group_salt(groups: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(g) for g in groups], np.uint64)


def _grams(flat: np.ndarray, at: np.ndarray, size: int, salt: np.ndarray) -> np.ndarray:
    """Keys of the runs of size words that start at the positions."""
    key = salt + np.uint64(size)
    for i in range(size):
        key = (key ^ key >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + flat[at + i] * _MULTIPLIERS[i % 64]
    return key ^ key >> np.uint64(32)


_KEYS = "key bigint, cls binary, grp string, pos int, n int, seg int, low bigint, high bigint"


def signatures(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for each text, a bit for each word. An edit changes two of them at most, so texts that are near differ in few."""
    out = []
    for shift in (3, 17):
        bits = np.left_shift(np.uint64(1), (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift + 40)) & np.uint64(63))
        out.append(np.bitwise_or.reduceat(bits, starts) if len(flat) else np.zeros(0, np.uint64))
    return out[0], out[1]


def _emit(b: pa.RecordBatch, rows: np.ndarray, key: np.ndarray, pos: np.ndarray, n: np.ndarray, seg: np.ndarray, signs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    of = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), b.column(b.schema.get_field_index("cls")).take(of), b.column(b.schema.get_field_index("grp")).take(of), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seg.astype(np.int32)), *(pa.array(x[rows].view(np.int64)) for x in signs)],
        ["key", "cls", "grp", "pos", "n", "seg", "low", "high"],
    )


def evaluation_segments(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """The t + 1 segments of each class: key, cls, grp, pos, n, seg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts, sizes = _flat(b)
            salts, signs = _group_salt(b.column(b.schema.get_field_index("grp")).to_pylist()), signatures(flat, starts, sizes)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for i, (start, size) in enumerate(segments(int(n), share)):
                    key = _grams(flat, starts[rows] + start, size, salts[rows])
                    yield _emit(b, rows, key, np.full(len(rows), start), sizes[rows], np.full(len(rows), i), signs)

    return classes.select("cls", "grp", "words").mapInArrow(run, _KEYS)


def training_substrings(classes: DataFrame, shared, size_bits: int, share: float = SHARE) -> DataFrame:  # noqa: ANN001
    """Substrings of each class, of the lengths that near texts' segments have, that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts, sizes = _flat(b)
            salts, signs = _group_salt(b.column(b.schema.get_field_index("grp")).to_pylist()), signatures(flat, starts, sizes)
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(flat)) - starts[row_of]
            needs = {int(n): lengths_needed(int(n), share) for n in np.unique(sizes)}
            for size in sorted({s for x in needs.values() for s in x}):
                wants = np.array([size in needs[int(n)] for n in sizes])
                at = np.flatnonzero(wants[row_of] & (inside + size <= sizes[row_of]))
                if len(at):
                    key = _grams(flat, at, size, salts[row_of[at]])
                    kept = np.flatnonzero(bloom.hits(shared, *bloom.halves(pa.array(key.view(np.int64))), size_bits))
                    if len(kept):
                        rows = row_of[at[kept]]
                        yield _emit(b, rows, key[kept], inside[at[kept]], sizes[rows], np.zeros(len(kept), np.int64), signs)

    return classes.select("cls", "grp", "words").mapInArrow(run, _KEYS)


def word_counts(classes: DataFrame) -> np.ndarray:
    """How often words occur in the classes, by ``SLOTS`` hashed counters; words that share one count as one."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((_flat(b)[0] >> np.uint64(8 * CODE - 16)).astype(np.int64), minlength=SLOTS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in classes.select("words").mapInArrow(local, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        out[r.slot] = r.n
    return out


def rare_words(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """(grp, cls, word): of each class the first words in the order of their frequency, so many that near texts have one of them in common."""
    shared = classes.sparkSession.sparkContext.broadcast(word_counts(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts, sizes = _flat(b)
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            # a word that stands in a text again is a word of its own
            order = np.lexsort((flat, row_of))
            same = np.append(False, (flat[order][1:] == flat[order][:-1]) & (row_of[order][1:] == row_of[order][:-1]))
            place = np.arange(len(flat))
            times = np.empty(len(flat), np.uint64)
            times[order] = place - np.maximum.accumulate(np.where(same, 0, place))
            order = np.lexsort((times, flat, shared.value[(flat >> np.uint64(8 * CODE - 16)).astype(np.int64)], row_of))
            first = np.array([min(int(n), most_edits(int(n), share) + 1) for n in sizes])
            kept = order[(place - starts[row_of]) < first[row_of]]
            word = (flat[kept] * np.uint64(0x9E3779B97F4A7C15)) ^ (times[kept] * np.uint64(0xBF58476D1CE4E5B9))
            of = pa.array(row_of[kept])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(word.view(np.int64))], ["grp", "cls", "word"])

    return classes.select("grp", "cls", "words").mapInArrow(run, "grp string, cls binary, word bigint")


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], bound: int) -> np.ndarray:
    """Edit distances of pairs of word arrays; bound + 1 stands for any distance above the bound."""
    n, width = len(a), 2 * bound + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top, wide = int(la.max()), int(max(la.max(), lb.max())) + width + 1
    left, right = np.zeros((n, top), np.int64), np.full((n, wide + bound), -1, np.int64)
    for i in range(n):
        left[i, : la[i]] = a[i]
        right[i, bound : bound + lb[i]] = b[i]  # column bound + j holds word j
    offsets = np.arange(width)
    far = np.int32(bound + 1)
    row = np.where(offsets - bound >= 0, offsets - bound, far).astype(np.int32)[None, :].repeat(n, 0)
    out = np.full(n, far, np.int32)
    out[la == 0] = np.minimum(lb[la == 0], far)
    for i in range(1, top + 1):
        j = i + offsets - bound  # the column of each cell
        same = right[:, i - 1 : i - 1 + width] == left[:, i - 1 : i]
        step = row + ~same
        step[:, j < 1] = far
        up = np.full_like(row, far)
        up[:, :-1] = row[:, 1:] + 1
        step = np.minimum(step, up)
        step[:, j < 0] = far
        if bound - i >= 0:
            step[:, bound - i] = i
        row = np.minimum(np.minimum.accumulate(step - offsets, axis=1) + offsets, far).astype(np.int32)
        done = np.flatnonzero(la == i)
        if len(done):
            k = lb[done] - i + bound
            inside = (k >= 0) & (k < width)
            out[done[inside]] = row[done[inside], k[inside]]
    return out


def _verify(share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = ([_codes(x).view(np.int64) for x in batch.column(i).to_pylist()] for i in (3, 4))
        longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
        bounds = np.array([allowed(int(n), share) for n in longer])
        near = np.zeros(len(a), bool)
        distance = np.zeros(len(a), np.int32)
        for bound in np.unique(bounds):
            rows = np.flatnonzero(bounds == bound)
            rows = rows[np.argsort(longer[rows], kind="stable")]
            step = max(1, CELLS // int((2 * bound + 1 + longer[rows].max()) or 1))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                distance[part] = banded_distance([a[x] for x in part], [b[x] for x in part], int(bound))
                near[part] = distance[part] <= bound
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(keep) for i in range(3)), pa.array(distance).filter(keep)], ["grp", "cls_e", "cls_t", "distance"])


def _candidates(joined: DataFrame, share: float) -> DataFrame:
    """(grp, cls_e, cls_t) of joined segments and substrings that the bounds of position and length and the signatures let through."""
    edits = F.floor(F.greatest("l_e", "l_t") * F.lit(share) + F.lit(1e-9))
    shift = F.col("q") - F.col("p")
    most = F.floor(F.col("l_e") * F.lit(share / (1 - share)) + F.lit(1e-9))
    return (
        joined.where((F.abs(F.col("l_e") - F.col("l_t")) <= edits) & (F.abs(shift) <= F.least(F.col("seg"), edits)))
        .where(F.abs(shift - (F.col("l_t") - F.col("l_e"))) <= F.least(most - F.col("seg"), edits))
        .where(F.bit_count(F.col("low_e").bitwiseXOR(F.col("low_t"))) <= 2 * edits)
        .where(F.bit_count(F.col("high_e").bitwiseXOR(F.col("high_t"))) <= 2 * edits)
        .where("cls_e <> cls_t")
        .select("grp", "cls_e", "cls_t")
    )


def overlaps(df: DataFrame, id_col: str, text_col: str, group_col: str, side_col: str, share: float = SHARE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near pairs of classes within a group, and the records of each class.

    pairs: grp, cls_e (an evaluation text), cls_t (a training text), distance. members: grp, cls, evaluation, k. side_col is
    true for evaluation records. Null texts, texts without words and rows whose group or side is null are no case. A class
    of very many copies is one text in all joins. hot: pairs that a segment may make by itself.
    """
    rows = cut(word_table(df, id_col, text_col, group_col, side_col))
    members = rows.select("grp", "cls", "evaluation", "k").distinct()  # without the words, which classes have once
    classes = cut(rows.groupBy("grp", "cls").agg(F.first("words").alias("words"), F.max("evaluation").alias("in_e"), F.min("evaluation").alias("only_e")))
    e, t = classes.where("in_e"), classes.where("NOT only_e")
    segment = evaluation_segments(e, share)
    n_words = F.octet_length("words") / CODE
    held = e.agg(F.sum(F.floor(n_words * share / (1 - share) + 1e-9) + 1).alias("n")).collect()[0].n  # one number
    size_bits, _ = bloom.size_for(int(held or 0))  # a crowded filter only lets more substrings through to the join
    shared = bloom.load(bloom.merged(segment.select("key"), size_bits), size_bits)
    a = cut(segment.select("key", "grp", F.col("cls").alias("cls_e"), F.col("pos").alias("p"), F.col("n").alias("l_e"), "seg", F.col("low").alias("low_e"), F.col("high").alias("high_e")))
    b = cut(training_substrings(t, shared, size_bits, share).select("key", "grp", F.col("cls").alias("cls_t"), F.col("pos").alias("q"), F.col("n").alias("l_t"), F.col("low").alias("low_t"), F.col("high").alias("high_t")))
    count = lambda rows, name: rows.groupBy("key").agg(F.count(F.lit(1)).alias(name))
    frequent = cut(count(a, "n_e").join(count(b, "n_t"), "key").where(F.col("n_e") * F.col("n_t") > hot).select("key"))
    if frequent.isEmpty():
        found = _candidates(a.join(b, ["key", "grp"]), share)
    else:
        found = _candidates(a.join(frequent, "key", "left_anti").join(b.join(frequent, "key", "left_anti"), ["key", "grp"]), share)
        rare = cut(rare_words(classes, share))
        with_words = lambda rows, cls: rows.join(frequent, "key", "left_semi").join(rare.withColumnRenamed("cls", cls), ["grp", cls])
        found = found.unionByName(_candidates(with_words(a, "cls_e").join(with_words(b, "cls_t"), ["key", "grp", "word"]), share))
    candidates = found.distinct()
    words = classes.select("grp", "cls", "words")
    both = candidates.join(words.select("grp", F.col("cls").alias("cls_e"), F.col("words").alias("words_e")), ["grp", "cls_e"]).join(
        words.select("grp", F.col("cls").alias("cls_t"), F.col("words").alias("words_t")), ["grp", "cls_t"]
    )
    near = both.select("grp", "cls_e", "cls_t", "words_e", "words_t").mapInArrow(lambda x: _verify(share, x), "grp string, cls_e binary, cls_t binary, distance int")
    same = classes.where("in_e AND NOT only_e").select("grp", F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"), F.lit(0).alias("distance"))
    return near.unionByName(same), members



def overlapping_records(df: DataFrame, id_col: str, text_col: str, group_col: str, side_col: str, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """(k_e, k_t, distance): every evaluation record with every training record of its group that is near or the same."""
    pairs, members = overlaps(df, id_col, text_col, group_col, side_col, share, hot)
    of = members.where("evaluation").select("grp", F.col("cls").alias("cls_e"), F.col("k").alias("k_e"))
    to = members.where("NOT evaluation").select("grp", F.col("cls").alias("cls_t"), F.col("k").alias("k_t"))
    return pairs.join(of, ["grp", "cls_e"]).join(to, ["grp", "cls_t"]).select("k_e", "k_t", "distance")
