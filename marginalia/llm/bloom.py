"""Two Bloom filters over a table: keys seen once, and keys seen twice.

Each task fills a filter "once", and a filter "twice" with keys that were in the first already.
Filters of tasks merge bit by bit: what is in either "twice", or in both "once", goes into the
merged "twice". So a filter may hold more than it should, never less. Its size is bounded whatever
the input; more input only makes it less sharp, in the end so that all keys go on to the exact step. That
step is a plain aggregation of narrow rows, so its cost stays in proportion to the input; reading the input
again for each of several ranges of hashes would cost more than it saves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bounds of a filter's size in bits: 64 MB at most.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: Bits set for a key.
PROBES = 2
#: Bytes of a filter in a row while filters merge.
PIECE = 1 << 18


def bits_for(df: DataFrame, bytes_for_a_bit: float) -> int:
    """A filter's size for df, from the bytes that the planner expects it to have."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())
    return min(MAX_BITS, max(MIN_BITS, 1 << int(size / bytes_for_a_bit).bit_length()))


def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """For keys of two 64-bit numbers, the bit positions of each probe."""
    return [(keys[:, 0] + np.uint64(i) * (keys[:, 1] | np.uint64(1))) & np.uint64(bits - 1) for i in range(PROBES)]


def spread(values: np.ndarray) -> np.ndarray:
    """Keys of two numbers from 64-bit values."""
    a = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    b = a * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([a ^ (b >> np.uint64(31)), b], axis=1)


def holds(bitmap: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Whether all the bits of each key are set."""
    out = np.ones(len(at[0]), dtype=bool)
    for p in at:
        out &= (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def put(bitmap: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(bitmap, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, twice: bool = True) -> np.ndarray:
    """The merged filter "twice" (or "once") of the keys that keys_of finds in a batch of df.

    It comes to the driver in pieces; bits // 8 bytes in all.
    """
    piece = min(PIECE, bits // 8)
    names = ["piece", "once", "twice"]

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = keys_of(batch)
            if not len(keys):
                continue
            if twice:
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                keys = keys[order]
                fresh = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
                often = np.diff(np.r_[np.flatnonzero(fresh), len(keys)]) > 1
                keys = keys[fresh]
            at = probes(keys, bits)
            if twice:
                again = holds(one, at) | often
                put(two, [p[again] for p in at])
            put(one, at)
        for n in range(0, bits // 8, piece):
            if one[n : n + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([n // piece], pa.int64()), pa.array([one[n : n + piece].tobytes()]), pa.array([two[n : n + piece].tobytes() if twice else b""])], names)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (np.frombuffer(b, np.uint8) for b in pair)
                if n in held:
                    o, t = held[n]
                    one, two = o | one, (t | two | (o & one)) if twice else two
                held[n] = one, two
        for n, pair in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pair[twice].tobytes()])], ["piece", "bits"])

    tasks = max(1, 2 * df.sparkSession.sparkContext.defaultParallelism)  # so many filters are merged, not one for each split
    parts = map_arrow(df.coalesce(tasks), fill, "piece long, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(parts.repartition(F.col("piece")), merge, "piece long, bits binary").toLocalIterator():
        out[row.piece * piece : (row.piece + 1) * piece] = np.frombuffer(row.bits, np.uint8)
    return out


def among(keys: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """What tells, in a worker, for each long of an array whether keys (one column, a long) may hold it."""
    bits = bits_for(keys, 4)
    once = keys.sparkSession.sparkContext.broadcast(build(keys, lambda b: spread(b.column(0).to_numpy().view(np.uint64)), bits, twice=False))
    return lambda column: holds(once.value, probes(spread(column.to_numpy().view(np.uint64)), bits))


def apart(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have one of the keys, rows that have none); the key is df's first column, a long, and keys' only one.

    The second part needs no join, so it isn't shuffled. df is read twice, once for each part.
    """
    found = among(keys)

    def keep(wanted: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: (batch.filter(pa.array(found(batch.column(0)) == wanted)) for batch in batches)

    return map_arrow(df, keep(True), df.schema), map_arrow(df, keep(False), df.schema)
