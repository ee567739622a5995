"""Bloom filters, built in partitions and merged block by block.

Every partition lists the filter bits of its keys as packed blocks; blocks are merged over the partitions on executors. The
whole filter, ``2 ** size`` bits, is what reaches the driver and is broadcast: by ``size_for`` at least ``BITS_PER_KEY`` bits a key and
at most ``2 ** MOST_BITS`` (64 MB). More keys than one such filter serves are cut into shards by a part of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Bits of the filter for each key: of keys that occur once (1 - exp(-2 / 10)) ** 2 = 3.3 % then look as if they occurred again.
BITS_PER_KEY = 10
#: 2 to this power bits in a filter at most, and at least.
MOST_BITS, LEAST_BITS = 29, 16
#: 2 to this power bits in a block of it, the unit of merging.
BLOCK_BITS = 16
PROBES = 2


def size_for(keys: int, most: int = MOST_BITS) -> tuple[int, int]:
    """(size of a filter, number of shards) that serve so many keys."""
    bits = max(1, keys) * BITS_PER_KEY
    return min(most, max(LEAST_BITS, (bits - 1).bit_length())), -(-bits >> most) if bits > 1 << most else 1


def halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each key: of 16-byte digests the halves, of 64-bit keys the key and a mix of it."""
    if pa.types.is_binary(keys.type):
        both = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]
    first = keys.to_numpy(zero_copy_only=False).view(np.uint64)
    second = (first ^ first >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return first, second ^ second >> np.uint64(32)


def positions(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bit positions, a row for each probe."""
    return np.stack([(first + np.uint64(i) * second) >> np.uint64(64 - size) for i in range(PROBES)]).astype(np.int64)


def _pack(bits: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct positions as (block, packed bits)."""
    import zstandard

    block = min(BLOCK_BITS, size)
    packer = zstandard.ZstdCompressor(level=1)
    for part in np.split(bits, np.flatnonzero(np.diff(bits >> block)) + 1):
        if len(part):
            row = np.zeros(1 << block, np.uint8)
            row[part & (1 << block) - 1] = 1
            yield int(part[0] >> block), packer.compress(np.packbits(row).tobytes())


def merged(keys: DataFrame, size: int, repeated: bool = False) -> DataFrame:
    """(block, packed): the filter of the keys in the one column of keys; repeated: of those that occur more than once.

    A bit set in two partitions, or by a key that one partition saw twice, is set in the filter of repeated keys. A key
    that occurs twice has all its bits there, so the filter never misses one.
    """
    column = keys.columns[0]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [halves(b.column(0)) for b in batches if b.num_rows]  # 16 bytes a row of one partition
        if not parts:
            return
        first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at, counts = np.unique(first, return_index=True, return_counts=True)
        bits = positions(first[at], second[at], size)
        for twice, chosen in ((False, bits), (True, bits[:, counts > 1] if repeated else bits[:, :0])):
            rows = list(_pack(np.unique(chosen), size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([twice] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["block", "twice", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker, block, once, more = zstandard.ZstdDecompressor(), None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            out = more if repeated else once
            if block is not None and out.any():
                packed = zstandard.ZstdCompressor(level=1).compress(out.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["block", "packed"])

        for b in batches:
            for at, twice, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != block:
                    yield from done()
                    width = (1 << min(BLOCK_BITS, size)) // 8
                    block, once, more = at, np.zeros(width, np.uint8), np.zeros(width, np.uint8)
                row = np.frombuffer(unpacker.decompress(packed), np.uint8)
                if not twice:
                    more |= once & row
                    once |= row
                else:
                    more |= row
        yield from done()

    blocks = keys.select(column).mapInArrow(local, "block int, twice boolean, packed binary")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, packed binary")


def load(blocks: DataFrame, size: int) -> Broadcast:
    """The merged filter, broadcast: (2 ** size) / 8 bytes."""
    import zstandard

    bits = np.zeros((1 << size) // 8, np.uint8)
    width = (1 << min(BLOCK_BITS, size)) // 8
    for row in blocks.collect():  # blocks of one filter, whatever the input
        bits[row.block * width : (row.block + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.packed)), np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(bits.tobytes())


def hits(shared: Broadcast, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Which keys may be in the filter."""
    filled = np.frombuffer(shared.value, np.uint8)
    at = positions(first, second, size)
    return (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
