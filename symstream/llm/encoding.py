"""Encoding of the whole corpus with a public tokenizer (problem 7).

The tiktoken library encodes with a local rank file. Texts are first split at safe boundaries: white space always starts a new
pre-token behind another sign, and so does a Chinese sign beside Chinese punctuation; the ids of the parts, one after another, are the ids
of the text. That bounds what the library sees at once by the longest run of letters, which the tokenizer itself takes whole, and lets
a task encode each distinct part once. Decoding joins the raw bytes of the ids, since one character can spread over several ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank files lie on every machine.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed value: the published pattern that splits text before the merges --------------------------------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ----------------------------------------------------------------------------------------------------------------------
#: Distinct parts that a task keeps encoded, and the longest that it keeps.
KEPT, KEPT_LENGTH = 300_000, 64
_UNEVEN = re.compile(r"\s\s|[^\S ]|^\s|\s$")
#: White space as the library's pattern understands it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Signs and punctuation of Chinese, which stand side by side without white space.
_HAN, _STOPS = "\u3400-\u4dbf\u4e00-\u9fff", "\u3001\u3002\u300c-\u300f\uff01\uff0c\uff1a\uff1b\uff1f\u2026"
_UNSPACED = re.compile(f"(?<=[{_HAN}])(?=[{_STOPS}])|(?<=[{_STOPS}])(?=[{_HAN}])")


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS):  # noqa: ANN201
    """The tokenizer of a rank file, without special tokens."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str) -> list[str]:
    """The text, cut at safe boundaries."""
    if _UNEVEN.search(text) is None:  # only single blanks: all of them are safe
        first, *rest = text.split(" ")
        found = [first, *[" " + x for x in rest]]
    else:
        found = _SAFE.split(text)
    if len(max(found, key=len)) > KEPT_LENGTH and _UNSPACED.search(text):
        found = [y for x in found for y in _UNSPACED.split(x)]
    return found


class _Encoded(dict):
    """Ids of parts as packed 32-bit numbers; each part is encoded when it is first asked for."""

    def __init__(self, ranks: str) -> None:
        super().__init__()
        self.encode = encoder(ranks).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(part), "<i4").tobytes()
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[part] = ids
        return ids


def packed_encoder(ranks: str = RANKS) -> Callable[[str | None], bytes]:
    """A function from a text to its packed ids; nothing for a null or an empty text."""
    known = _Encoded(ranks)
    return lambda text: b"".join(map(known.__getitem__, parts(text))) if text else b""


def encode(df: DataFrame, id_col: str, text_col: str, ranks: str = RANKS) -> DataFrame:
    """id and ``ids``, a list of integers for each row: empty for an empty and for a null text. A narrow map."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packed_encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ids = [pack(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["k", "ids"])

    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("k").alias(id_col), "ids")


def count_tokens(df: DataFrame, keep: list[str], text_col: str, ranks: str = RANKS) -> DataFrame:
    """The columns to keep, with ``n_tokens``, the number of ids of the text: 0 for an empty and for a null text."""
    rows = df.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packed_encoder(ranks)
        for b in batches:
            counts = pa.array([len(pack(t)) // 4 for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], counts], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode(df: DataFrame, id_col: str, ids_col: str, ranks: str = RANKS) -> DataFrame:
    """id and ``text`` from the raw bytes of the ids; a list that ends inside a character gets the replacement sign."""
    rows = df.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder(ranks).decode_bytes
        for b in batches:
            texts = [None if ids is None else raw(ids).decode("utf-8", errors="replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text string")
    return out.select(F.col("k").alias(id_col), "text")
