"""Helpers that the corpus operators share: working tables, Arrow mapping and keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.runtime import materialize, ship, spread

#: Sorts after every real id; stands for a null id while rows are grouped or joined.
NO_ID = (1 << 63) - 1
#: Bytes of a slice of a batch, beyond a single row.
SLICE_BYTES = 8 << 20
#: Values that join_hot() broadcasts at most, and rows below which none is hot.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if it has fewer splits than there are."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A working table of df with a column row, a number of its own for each row that stays when it is read again."""
    return materialize(df.withColumn("row", F.monotonically_increasing_id()), name)


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows rows and about SLICE_BYTES bytes, one row at least."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def release() -> None:
    """Give memory that was freed back to the system, as a worker waits for tasks beside others of its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow over slices of batches, which bound what fn holds at once.

    Spark itself ends a batch at spark.sql.execution.arrow.maxBytesPerBatch (64 MB if not set), read when
    the plan runs; no setting of the session is changed here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(sliced(batches, rows))
        finally:
            release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_remembering: object = None


def only(memory):
    """memory, which becomes the one that this worker keeps: what another operator's model remembered is forgotten."""
    global _remembering
    if _remembering is not memory:
        if _remembering is not None:
            _remembering.forget()
            release()
        _remembering = memory
    return memory


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], count: str) -> DataFrame:
    """Inner join of left with right, which has one row for each value of on, without hot tasks.

    right's column count says how many rows of left have the value, and is dropped. Values with more than
    a HOT_KEYS-th of all rows are HOT_KEYS at most, whatever the input, so their rows of right are broadcast,
    and left's rows with them stay where they are; only the others are shuffled. Both tables are read
    twice, so they should be working tables or cheap scans.
    """
    on = [on] if isinstance(on, str) else on
    total, most = right.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return left.join(right.drop(count), on)
    fields = [c for c in right.columns if c not in (*on, count)]
    hot = right.where(F.col(count) > limit).select(*on, F.struct(*fields).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    own = [c for c in left.columns if c not in on]
    met = marked.where("_hot is not null").select(*on, *own, *(F.col(f"_hot.{f}").alias(f) for f in fields))
    rest = marked.where("_hot is null").select(*on, *own).join(right.where(F.col(count) <= limit).drop(count), on)
    return met.unionByName(rest)


def key_of(column: str) -> F.Column:
    """The id to group by: a null id becomes NO_ID, so that it sorts last and joins with itself."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def utf8(column: str) -> F.Column:
    """A text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def crc_of(column: str) -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def unit_hash(column: str, seed: int) -> F.Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) / float(1 << 30)
