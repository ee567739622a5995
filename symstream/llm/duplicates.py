"""Duplicates hidden by formatting differences (problem 4).

1. One narrow pass reduces every record to a 16-byte hash of its canonical fields (Arrow kernels; nothing is shuffled).
2. Every partition lists the filter bits of its hashes, and apart those of hashes that it saw twice, as packed blocks.
   Blocks are merged over the partitions: a bit that is set in two partitions, or twice in one, is set in the filter of
   repeated hashes. A hash that occurs twice has all its bits there, so the filter never misses one.
3. Only hashes that the filter lets through are shuffled and grouped exactly; all others are singletons.

The filter is sized by the number of records, so that some 3 % of the singletons pass it at any input size. Beyond 50 million
records it would outgrow what may be broadcast (64 MB); the hashes are then written as a table of shards, by a part of the hash and
without a shuffle, and each shard has its own filter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symstream.session import cut, ensure_checkpoint_dir

from . import bloom

#: White space, punctuation, controls and format characters, and symbols.
IGNORED = r"[\p{P}\p{Z}\p{C}\p{S}]+"


def canonical_array(texts: pa.Array) -> pa.Array:
    """Texts in lower case without white space, punctuation and symbols; null stays null."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), IGNORED, "")


def _digests(fields: list[pa.Array]) -> list[bytes]:
    """One hash for each row over its canonical fields; null is told from empty."""
    word = lambda x: pa.scalar(x, pa.large_string())
    marks = [pc.fill_null(pc.binary_join_element_wise(word("1"), a, word("")), word("0")) for a in map(canonical_array, fields)]
    joined = pc.binary_join_element_wise(*marks, word("\x1f"))
    return [xxhash.xxh3_128_digest(x) for x in joined.to_pylist()]


def _batch(ids: pa.Array, digests: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary())], ["k", "h"])


def hash_fields(df: DataFrame, id_col: str, text_cols: Sequence[str]) -> DataFrame:
    """(k, h) of each row: its id, and the hash of its text columns in canonical form."""
    rows = df.select(F.col(id_col).alias("k"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(text_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b.column(0), _digests(b.columns[1:]))

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, h binary")


def _field(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def hash_json(df: DataFrame, id_col: str, payload_col: str, names: Sequence[str]) -> DataFrame:
    """(k, h) of each row whose payload is a JSON object: hash of the named members, whatever their order or spelling.

    A missing member counts as null. Null and unreadable payloads, and JSON that is no object, are left out.
    """
    rows = df.select(F.col(id_col).alias("k"), F.col(payload_col).alias("p")).where(F.col("p").isNotNull())
    names = tuple(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, found = [], []
            for i, payload in enumerate(b.column(1).to_pylist()):
                try:
                    value = json.loads(payload)
                    if isinstance(value, dict):
                        row = [_field(value.get(n)) for n in names]
                        "".join(x or "" for x in row).encode()  # lone surrogates can't be stored
                        found.append(row)
                        kept.append(i)
                except (ValueError, RecursionError):
                    continue
            if kept:
                columns = [pa.array(list(c), pa.string()) for c in zip(*found, strict=True)]
                yield _batch(b.column(0).take(pa.array(kept)), _digests(columns))

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, h binary")


def shards_of(hashed: DataFrame, most: int = bloom.MOST_BITS) -> list[tuple[DataFrame, int]]:
    """Parts of hashed, by a part of the hash, with the size of the filter of each."""
    kept = cut(hashed)
    size, shards = bloom.size_for(kept.count(), most)
    if shards == 1:
        return [(kept, size)]
    spark = hashed.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    # bytes of the hash that the filter's first probe doesn't use
    part = F.pmod(F.conv(F.hex(F.substring("h", 9, 4)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
    kept.withColumn("shard", part).write.partitionBy("shard").parquet(path)
    written = spark.read.schema("k " + kept.schema["k"].dataType.simpleString() + ", h binary, shard int").parquet(path)
    return [(written.where(F.col("shard") == i).select("k", "h"), size) for i in range(shards)]


def possible_repeats(hashed: DataFrame, size: int) -> Callable[[bool], DataFrame]:
    """A function that gives the rows of hashed which the filter lets through (True) or holds as singletons (False)."""
    shared = bloom.load(bloom.merged(hashed.select("h"), size, repeated=True), size)

    def rows(repeated: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    hit = bloom.hits(shared, *bloom.halves(b.column(1)), size)
                    yield b.filter(pa.array(hit if repeated else ~hit))

        return hashed.mapInArrow(run, hashed.schema)

    return rows


def _collapse(hashed: DataFrame, size: int) -> DataFrame:
    rows = possible_repeats(hashed, size)
    groups = rows(True).distinct().groupBy("h").agg(F.min("k").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    single = rows(False).select(F.col("k").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return groups.select("keep_id", "copies").unionByName(single)


def collapse(hashed: DataFrame, most: int = bloom.MOST_BITS) -> DataFrame:
    """(keep_id, copies): each record once under its least id, with the number of ids that are the same record.

    hashed is (k, h) as hash_fields and hash_json give it; a row delivered again under its id counts once. An empty table
    gives no rows. A hash of very many rows is pre-aggregated on the map side. most: of bloom.size_for.
    """
    return reduce(DataFrame.unionByName, [_collapse(*x) for x in shards_of(hashed, most)])


def _copies(hashed: DataFrame, size: int) -> DataFrame:
    rows = possible_repeats(hashed, size)(True).distinct()
    groups = rows.groupBy("h").agg(F.min("k").alias("keep_id"), F.max("k").alias("most")).where("keep_id < most").select("h", "keep_id")
    return rows.join(groups, "h").where("k <> keep_id").select("keep_id", F.col("k").alias("copy_id"))


def copies_of(hashed: DataFrame, most: int = bloom.MOST_BITS) -> DataFrame:
    """(keep_id, copy_id): for each group of the same records its least id, with every other id.

    The groups' least ids come from a map-side aggregation; rows meet them in a join on the hash, whose hot keys the
    adaptive skew join splits. most: of bloom.size_for.
    """
    return reduce(DataFrame.unionByName, [_copies(*x) for x in shards_of(hashed, most)])
