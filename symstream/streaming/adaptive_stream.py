"""Adaptive scoring of streams: a model for each key, which learns every symbol after it has scored it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symstream.operators.adaptive import Adaptive

OUTPUT = "key string, position bigint, symbol int, bits double"


def _fresh(order: int, method: str, alphabet: int) -> tuple[Adaptive, int]:
    return Adaptive(order, method, alphabet), 0


def _score(key: str, ordered: pd.DataFrame, model: Adaptive, at: int) -> tuple[pd.DataFrame, int]:
    """The next rows of a key, in order: their scores, and the position after them."""
    bits = []
    for s in ordered["symbol"].tolist():
        bits.append(model.bits(s))
        model.update(s)
    out = pd.DataFrame({"key": key, "position": range(at, at + len(bits)), "symbol": ordered["symbol"].astype("int32").to_numpy(), "bits": bits})
    return out, at + len(bits)


def _prepared(df: DataFrame, key_col: str, order_col: str, symbol_col: str) -> DataFrame:
    rows = df.select(F.col(key_col).cast("string").alias("key"), F.col(order_col).alias("order"), F.col(symbol_col).cast("int").alias("symbol"))
    return rows.where("key IS NOT NULL AND symbol IS NOT NULL AND symbol >= 0")


def score_stream(stream: DataFrame, key_col: str, order_col: str, symbol_col: str, order: int = 2, method: str = "D", alphabet: int = 256) -> DataFrame:
    """(key, position, symbol, bits) for each event of a stream; the model of a key is kept in its state from batch to batch.

    Events of a key within a micro-batch are ordered by order_col, then by symbol, also where they come in several Arrow batches: of a
    key's events in a micro-batch order and symbol are held until all are there, so the source's limits (maxFilesPerTrigger and the
    like) bound what a task holds. Rows without key or symbol are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, at = pickle.loads(state.get[0]) if state.exists else _fresh(order, method, alphabet)  # noqa: S301
        held = [rows[["order", "symbol"]] for rows in batches]
        out, at = _score(key[0], pd.concat(held).sort_values(["order", "symbol"], kind="stable"), model, at)
        yield out
        state.update((pickle.dumps((model, at)),))

    rows = _prepared(stream, key_col, order_col, symbol_col)
    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, "model binary", "append", GroupStateTimeout.NoTimeout)


def score_batch(df: DataFrame, key_col: str, order_col: str, symbol_col: str, order: int = 2, method: str = "D", alphabet: int = 256) -> DataFrame:
    """The same over a table. Keys come one after another, sorted by Spark (which spills), so that of a key only its model is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model, at = None, None, 0
        for rows in batches:
            for key, part in rows.groupby("key", sort=False):
                if key != now:
                    now, (model, at) = key, _fresh(order, method, alphabet)
                out, at = _score(key, part, model, at)
                yield out

    rows = _prepared(df, key_col, order_col, symbol_col)
    return rows.repartition("key").sortWithinPartitions("key", "order", "symbol").select("key", "symbol").mapInPandas(run, OUTPUT)


def static_scores(stream: DataFrame, keep: list[str], text_col: str, static) -> DataFrame:  # noqa: ANN001
    """Codelength of each text of a stream under a frozen model: a stateless projection."""
    shared = stream.sparkSession.sparkContext.broadcast(static)
    bits = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else shared.value.cost(t)), "double")
    return stream.select(*keep, bits(F.col(text_col)).alias("bits"))


def windowed_types(stream: DataFrame, time_col: str, type_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type in windows of event time; events later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), type_col).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", type_col, "n")
