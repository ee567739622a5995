"""Garbled text from wrong character encoding (problem 1), on DataFrames.

A first pass over all rows counts the words of sound texts (``frequencies``); a second one screens each text with one regular
expression on Arrow data, and undoes the damage of those that match (``mojibake``). Nothing but blocks of the tables is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequencies, mojibake


_KEPT: list = [None, None]


def _decoder(tables: np.ndarray) -> mojibake.Decoder:
    """The decoder of the tables; a worker keeps what it has found out from task to task."""
    if _KEPT[0] is not tables:
        _KEPT[:] = tables, mojibake.Decoder(frequencies.Frequencies(tables))
    return _KEPT[1]


def restore(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """id, field_name, damaged, restored, complete: a row for each text that was decoded with a wrong encoding, wholly or in part.

    complete: no byte was lost. Lost bytes are restored by their likeliest letters; U+FFFD stays where none is known. Null, empty and
    sound texts give no row, repeated rows give repeated rows. Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("k"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(text_cols)))
    screen = mojibake.suspicious()
    shared = frequencies.load(frequencies.count_corpus(rows.drop("k"), [f"f{i}" for i in range(len(text_cols))], screen))
    names = list(text_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for b in batches:
            for i, name in enumerate(names):
                texts = b.column(i + 1)
                suspects = b.filter(pc.fill_null(pc.match_substring_regex(texts, screen), False))
                found = [(k, t, *mojibake.repair(t, decoder)) for k, t in zip(suspects.column(0), suspects.column(i + 1).to_pylist(), strict=True)]
                found = [x for x in found if x[3]]
                if found:
                    k, old, new, _, complete = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.as_py() for x in k], b.column(0).type), pa.array([name] * len(k)), pa.array(old), pa.array(new), pa.array(complete)],
                        ["k", "field_name", "damaged", "restored", "complete"],
                    )

    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, field_name string, damaged string, restored string, complete boolean")
    return out.withColumnRenamed("k", id_col)
