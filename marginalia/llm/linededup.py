"""Line dedup: two Bloom filters, for hashes seen once and seen twice, pick the lines worth a shuffle.

Pass one reads every document and fills the filters; a document counts once for a key. Only the
filter "twice" is sent out; it has a bounded size whatever the input (see bloom.py).
Pass two shuffles the keys that "twice" holds: their 128-bit digests and documents, which confirm
repeats and choose the first document; keys with equal digests count as equal. Rows of very frequent
lines aren't shuffled to meet their first document (join_hot). The drops then meet the texts by
document; texts that a Bloom filter shows to lose nothing stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import join_hot, key_of, map_arrow, materialize, utf8

#: What is stripped from both ends of a line for its key.
BLANK = b" \t\n\v\f\r"


def digests(text: bytes, min_points: int) -> list[bytes | None]:
    """For each line the 128-bit digest of its key; None where the key is too short to matter."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()
        long = len(key) >= min_points and (len(key) >= 4 * min_points or len(key.decode("utf-8", "replace")) >= min_points)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def as_keys(found: Iterable[bytes]) -> np.ndarray:
    """Digests as keys of two numbers."""
    return np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2)


def drops(docs: DataFrame, min_points: int, bits: int | None = None) -> DataFrame:
    """(key, spot, lines): the digests of the keys that a row loses; docs has key, spot and text.

    key is the document's, spot tells apart the rows without an id, which all have one key: however many
    they are, a list holds the lines of one text only.
    """
    bits = bits or bloom.bits_for(docs, 8)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return as_keys(key for text in batch.column(2).to_pylist() for key in {*digests(text, min_points)} - {None})

    bitmap = docs.sparkSession.sparkContext.broadcast(bloom.build(docs, keys_of, bits))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[int] = []
            found: list[bytes] = []
            for n, text in enumerate(batch.column(2).to_pylist()):
                keys = {*digests(text, min_points)} - {None}
                found += keys
                names += [n] * len(keys)
            if found:
                hit = np.flatnonzero(bloom.holds(bitmap.value, bloom.probes(as_keys(found), bits)))
                at = pa.array(np.array(names)[hit])
                yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in hit], pa.binary()), batch.column(0).take(at), batch.column(1).take(at)], ["line", "key", "spot"])

    held = materialize(map_arrow(docs, suspects, "line binary, key long, spot long"), "suspects")
    repeats = materialize(held.groupBy("line").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first < last").select("line", "first", "n"), "repeats")
    lost = join_hot(held, repeats, "line", "n").where("key != first")
    return materialize(lost.groupBy("key", "spot").agg(F.collect_set("line").alias("lines")), "drops")


def dedup_lines(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """docs with three more columns: kept (text as bytes), n_lines, n_dropped; its own columns stay.

    docs needs doc_id and text. A line's key is the line without blanks at both ends, A-Z
    lower-cased; keys of at least min_points code points that two documents hold lose all their
    lines but in the least doc_id. A null or empty text is one empty line. Rows with a null doc_id
    are one document, after all others; rows that repeat a doc_id are one document too. If docs
    already has columns of these names, the new ones replace them.
    """
    key, spot = "_marginalia_key", "_marginalia_spot"
    own = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped", key, spot, "_marginalia_lines")]
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(utf8("text"))).alias(spot), key_of("doc_id").alias(key), *own)
    lost = drops(given.select(F.col(key).alias("key"), F.col(spot).alias("spot"), utf8("text").alias("text")), min_points)
    lost = lost.select(F.col("key").alias(key), F.col("spot").alias(spot), F.col("lines").alias("_marginalia_lines"))
    touched, untouched = bloom.apart(given, lost.select(spot))
    joined = touched.join(lost.hint("shuffle_hash"), [key, spot], "left")
    schema, columns = joined.select(*own).schema, joined.columns
    at = {name: columns.index(name) for name in (*own, "_marginalia_lines")}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, lost in zip(batch.column(at["text"]).cast(pa.binary()).to_pylist(), batch.column(at["_marginalia_lines"]).to_pylist(), strict=True):
                text = text or b""
                if not lost:
                    kept.append(text)
                    lines.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone, parts = set(lost), text.split(b"\n")
                left = [p for p, d in zip(parts, digests(text, min_points), strict=True) if d not in gone]
                kept.append(b"\n".join(left))
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            arrays = [batch.column(at[c]) for c in own] + [pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*own, "kept", "n_lines", "n_dropped"])

    out = schema.add("kept", "binary").add("n_lines", "long").add("n_dropped", "long")
    whole = utf8("text")
    lines = F.octet_length(whole) - F.octet_length(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    as_is = untouched.select(*own, whole.alias("kept"), lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return map_arrow(joined, cut, out).unionByName(as_is)
