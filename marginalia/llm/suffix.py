"""Repeated substrings, found by sorting the corpus's suffixes one bucket at a time.

A byte goes if a string of ``size`` bytes that covers it starts anywhere else too. The suffixes that
matter are those with size bytes left in their document. They are split into buckets, and each
bucket is sorted on its own, so memory follows the largest bucket, not the corpus:

1. A suffix's bucket is its anchor: of the GRAM-byte strings in its first size bytes, the one with
   the least hash, leftmost. Equal strings have equal anchors at equal distances, so what is equal
   shares a bucket. Suffixes with one anchor follow each other; a row stands for such a run.
2. Two Bloom filters over the anchors keep the runs whose bucket may hold more than one.
3. Runs with equal bytes throughout, by a digest of 128 bits, are repeats as a whole. Only one of
   them, and runs that are unlike all others of their bucket, need sorting: their bytes go to the
   task of the bucket.
4. A bucket of more than ``crowd`` runs is first split by longer prefixes: its suffixes fall into PARTS
   bands of distances to the anchor, and the suffixes of a band are dealt by all the bytes that they
   have in common. Bands are cut again while they are crowded; runs that are equal throughout, or
   alone, leave on the way. A bucket of one distance holds one string only.
5. The task ranks the cover samples of a bucket in the order of their suffixes: the positions of a
   difference cover modulo PERIOD, by their first PERIOD bytes and then by doubling. The bucket's
   suffixes are sorted by their first PERIOD bytes. Two that tie there are told apart by the ranks
   of the samples at the least distance at which both have one, so a tie of any length costs one
   comparison. Neighbours are then compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import join_hot, map_arrow, materialize, numbered, utf8

#: Bytes of an anchor, and the period of the difference cover.
GRAM, PERIOD = 32, 64
#: The numbers below STEP and its multiples up to half a period have all differences modulo PERIOD.
STEP = 8
#: Whether a residue is in the cover, and for two residues the least step from both into the cover.
COVER = np.array([r < STEP or (r % STEP == 0 and 2 * r <= PERIOD) for r in range(PERIOD)])
SHIFT = np.array([[next(d for d in range(PERIOD) if COVER[(a + d) % PERIOD] and COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
#: Bytes of texts that are hashed at once, and of runs that are sorted at once.
SLICE, SORTED = 1 << 18, 1 << 19
#: Runs of a bucket beyond which it is split, a MB or so, and bands into which it is.
CROWD, PARTS = 4096, 4
_random = np.random.default_rng(20240229)
#: A random odd number for each byte, and two odd multipliers.
BYTES = _random.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS = [int(x) | 1 for x in _random.integers(1, 1 << 62, 2)]
WORD = (1 << 64) - 1


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the length bytes from each position (fewer at the end: meaningless)."""
    power, have = MULTIPLIERS[0], 0
    block, size = BYTES[data], 1
    total = np.zeros(len(data), np.uint64)
    while True:
        if length & size:  # total = total * power(size) + block shifted by what total has
            moved = np.zeros_like(block)
            moved[: len(data) - have] = block[have:]
            total = total * np.uint64(power) + moved if have else block.copy()
            have += size
            if have == length:
                return total
        moved = np.zeros_like(block)
        moved[: len(data) - size] = block[size:]
        block = block * np.uint64(power) + moved
        size, power = size * 2, power * power & WORD


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each position (fewer at the end)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        more = values.copy()
        np.minimum(values[: len(values) - step], values[step:], out=more[: len(values) - step])
        values, have = more, have + step
    return values


def digest(run: bytes, low: int) -> bytes:
    """16 bytes for a run: of its bytes and where they lie about the anchor."""
    return hashlib.blake2b(run, digest_size=16, salt=low.to_bytes(4, "little")).digest()


def segments(texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in lists of about SLICE bytes; longer texts in parts that overlap by size - 1."""
    held, weight = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - size + 1, SLICE - size + 1):
            part = text[at : at + SLICE]
            if held and weight + len(part) > SLICE:
                yield held
                held, weight = [], 0
            held.append((i, at, part))
            weight += len(part)
    if held:
        yield held


def runs(texts: list[bytes], size: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, run's digest in two halves, position of the anchor, distances to the run's first and last suffix)."""
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for part in segments(texts, size):
        buffer = b"".join(t for _, _, t in part)
        data = np.frombuffer(buffer, np.uint8)
        lengths = np.array([len(t) for _, _, t in part])
        ends = np.cumsum(lengths)
        end, place = np.repeat(ends, lengths), np.arange(len(data))
        grams = rolling(data, GRAM)
        rank = (grams * np.uint64(MULTIPLIERS[1])) >> np.uint64(32) << np.uint64(32) | place.astype(np.uint64)
        rank[place + GRAM > end] = WORD
        first = np.flatnonzero(place + size <= end)
        anchor = (sliding_min(rank, size - GRAM + 1)[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1])])
        tail = np.r_[head[1:], len(first)] - 1
        anchor, low, high = anchor[head], first[head], first[tail]
        which = np.searchsorted(ends, anchor, side="right")
        start = ends[which] - lengths[which] - np.array([at for _, at, _ in part])[which]
        kinds = np.zeros((len(anchor), 2), np.int64)
        if hashed:
            kinds = np.frombuffer(b"".join(digest(buffer[a:b], x) for a, b, x in zip(low.tolist(), (high + size).tolist(), (anchor - low).tolist(), strict=True)), np.int64).reshape(-1, 2)
        columns = (np.array([i for i, _, _ in part])[which], grams[anchor].view(np.int64), kinds[:, 0], kinds[:, 1], anchor - start, anchor - low, anchor - high)
        for column, values in zip(out, columns, strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


def suspects(docs: DataFrame, size: int) -> DataFrame:
    """Runs whose anchor may occur twice: (h, c, e, row, pos, lo, hi); docs has row and text."""
    bits = bloom.bits_for(docs, 4)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return bloom.spread(runs(batch.column(1).to_pylist(), size, hashed=False)[1])

    twice = docs.sparkSession.sparkContext.broadcast(bloom.build(docs, keys_of, bits))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, h, c, e, pos, lo, hi = runs(batch.column(1).to_pylist(), size)
            kept = bloom.holds(twice.value, bloom.probes(bloom.spread(h), bits)) if len(h) else np.empty(0, bool)
            row = batch.column(0).to_numpy()[text[kept]]
            columns = ((h[kept], pa.int64()), (c[kept], pa.int64()), (e[kept], pa.int64()), (row, pa.int64()), (pos[kept], pa.int32()), (lo[kept], pa.int16()), (hi[kept], pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["h", "c", "e", "row", "pos", "lo", "hi"])

    return map_arrow(docs, find, "h long, c long, e long, row long, pos int, lo short, hi short")


class Bucketed:
    """The suffixes of some buckets, in order: by bucket, then by their bytes to the end of their run.

    A run's text begins low bytes before its anchor and holds its suffixes down to high before it. Places
    count from the anchor, so that suffixes with equal strings have the same residue.
    """

    def __init__(self, bucket: np.ndarray, texts: list[bytes], low: np.ndarray, high: np.ndarray, size: int):
        self.data = np.frombuffer(b"".join(t + bytes(PERIOD) for t in texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts])
        start = np.cumsum(self.lengths + PERIOD) - self.lengths - PERIOD
        run_of = np.repeat(np.arange(len(texts)), self.lengths + PERIOD)
        place = np.arange(len(self.data)) - start[run_of]
        self.residue = (place - low[run_of] + PERIOD * size) % PERIOD
        self.left = self.lengths[run_of] - place  # bytes to the end of the run
        padded = np.r_[self.data, np.zeros(PERIOD, np.uint8)].astype(np.uint64)
        self.words = np.zeros(len(self.data) + PERIOD, np.uint64)  # eight bytes from each position, the first one highest
        for k in range(8):
            self.words[: len(self.data)] |= padded[k : k + len(self.data)] << np.uint64(56 - 8 * k)
        self.rank = self.sample_ranks()
        count = low - high + 1
        self.run = np.repeat(np.arange(len(texts)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.suffix = start[self.run] + self.offset
        self.order, self.tied = self.sort(bucket[self.run])

    def prefix_keys(self, at: np.ndarray) -> list[np.ndarray]:
        """The first PERIOD bytes from each position as numbers, the most significant one last."""
        return [self.words[at + k] for k in range(PERIOD - 8, -1, -8)]

    def sample_ranks(self) -> np.ndarray:
        """For each position of the cover, the number of its suffix in the order of all such suffixes."""
        at = np.flatnonzero(COVER[self.residue] & (self.left > 0))
        rank = np.full(len(self.data) + PERIOD, -1, np.int64)
        keys = [np.minimum(self.left[at], PERIOD), *self.prefix_keys(at)]
        have = PERIOD
        while len(at):
            order = np.lexsort(keys)
            fresh = np.r_[True, np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)]
            rank[at[order]] = np.cumsum(fresh) - 1
            if fresh.all() or have >= self.left.max():
                break
            after = np.where(self.left[at] > have, rank[np.minimum(at + have, len(rank) - 1)], -1)
            keys, have = [after, rank[at]], 2 * have
        return rank

    def sort(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes, whether each one in it ties with the next in bucket and first PERIOD bytes)."""
        residue = self.residue[self.suffix]
        prefix = [*self.prefix_keys(self.suffix), bucket]
        own = self.rank[self.suffix + SHIFT[residue, residue]]
        order = np.lexsort([own, residue, *prefix])
        tied = np.all([k[order[1:]] == k[order[:-1]] for k in prefix], axis=0) if len(order) else np.empty(0, bool)
        group = np.r_[0, np.cumsum(~tied)] if len(order) else np.empty(0, np.int64)
        order = self.merge(order, group, residue[order])
        return order, tied

    def merge(self, order: np.ndarray, group: np.ndarray, residue: np.ndarray) -> np.ndarray:
        """order with the residues of each group merged; before, a group's suffixes are sorted within each residue only.

        A suffix's place in its group is the number of smaller ones in each residue, found by bisection.
        """
        if not len(order):
            return order
        head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (residue[1:] != residue[:-1])])  # where a residue of a group begins
        several = np.bincount(group[head]) > 1  # groups of more than one residue
        tail = np.r_[head[1:], len(order)]
        head, tail = head[several[group[head]]], tail[several[group[head]]]
        if not len(head):
            return order
        size = tail - head
        block = np.repeat(np.arange(len(head)), size)
        mixed = np.arange(len(block)) + np.repeat(head - np.cumsum(size) + size, size)
        at, mine = self.suffix[order], residue[mixed]
        key = group[head] * PERIOD + residue[head]
        smaller = mixed - head[block]  # in its own residue
        for other in np.unique(mine):
            sought = group[head] * PERIOD + other
            place = np.minimum(np.searchsorted(key, sought), len(key) - 1)
            has = (key[place] == sought) & (residue[head] != other)
            which = np.flatnonzero(has[block])
            place, own = place[block[which]], mine[which]
            low, high, begin = head[place], tail[place], head[place]
            shift = SHIFT[own, other]
            value = self.rank[at[mixed[which]] + shift]
            while (open_ := low < high).any():
                middle = (low + high) // 2
                found = self.rank[at[np.minimum(middle, len(at) - 1)] + shift]
                less = open_ & ((found < value) | ((found == value) & (other < own)))
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            smaller[which] += low - begin
        out = order.copy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])  # where a group begins; groups are numbered from 0
        out[first[group[mixed]] + smaller] = order[mixed]
        return out


def sort_bucket(bucket: np.ndarray, texts: list[bytes], low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, distance from the anchor) of each suffix with an equal string in another run of its bucket."""
    found = Bucketed(bucket, texts, low, high, size)
    good = np.zeros(len(found.order), dtype=bool)
    windows = np.lib.stride_tricks.sliding_window_view(found.data, size) if len(found.data) >= size else None
    same = np.flatnonzero(found.tied)
    for at in range(0, len(same), 1 << 14):
        part = same[at : at + (1 << 14)]
        left, right = found.order[part], found.order[part + 1]
        equal = (windows[found.suffix[left]] == windows[found.suffix[right]]).all(axis=1)
        good[left[equal]] = good[right[equal]] = True
    return found.run[good], (low[found.run] - found.offset)[good]


def told_apart(rows: DataFrame, size: int, all_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ranges of runs that occur twice in their bucket, a row for each kind of run that needs sorting).

    Of rows (h, c, e, row, pos, lo, hi, and others) one for each (h, c, e) stays, if its bucket holds other
    kinds too and not all of them occur twice; n is the number of kinds in the bucket. Beyond the first
    round the rows are those of crowded buckets only.
    """
    spot, kind = F.struct("row", "pos"), ["h", "c", "e"]
    counted = rows.groupBy(*kind).agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count("*").alias("times"))
    kinds = materialize(counted.select(*kind, "first", "times", (F.col("first") < F.col("last")).alias("often")), "kinds")
    often = kinds.where("often").select(*kind, "often", "times")
    met = join_hot(rows, often, kind, "times") if all_rows else rows.join(often, kind)
    whole = met.select("row", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") - F.col("hi") + size).alias("end"))
    needy = kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("often").alias("all")).where("n > 1 and not all").select("h", "n")
    return whole, kinds.join(needy, "h").select(*kind, "n", "first")


def repeated_spans(docs: DataFrame, size: int = 200, crowd: int = CROWD) -> DataFrame:
    """(row, start, end): ranges of documents' bytes covered by repeated strings; they may overlap. docs has row and text."""
    found = materialize(suspects(docs, size), "suspects")
    whole, wanted = told_apart(found, size)
    lists = found.join(wanted, ["h", "c", "e"]).where("row = first.row and pos = first.pos")
    lists = materialize(lists.groupBy("row").agg(F.collect_list(F.struct("h", "n", "pos", "lo", "hi")).alias("runs")), "wanted")
    touched, _ = bloom.apart(docs, lists.select("row"))
    pieces = materialize(contexts(touched.join(lists.hint("shuffle_hash"), "row"), size), "contexts")
    out = whole
    while True:
        simple = (F.col("n") <= crowd) | (F.col("near") == F.col("far"))
        out = out.unionByName(sorted_spans(pieces.where(simple), size))
        crowded = pieces.where(~simple)
        if crowded.isEmpty():
            return out
        bands = materialize(banded(crowded, size).drop("n"), "bands")
        whole, wanted = told_apart(bands, size, all_rows=False)
        pieces = materialize(bands.join(wanted, ["h", "c", "e"]).where("row = first.row and pos = first.pos").select(*pieces.columns), "contexts")
        out = out.unionByName(whole)


#: A run with its bytes. near and far bound the distances of its bucket's suffixes to the anchor, n is the number of runs in the bucket.
PIECE = "h long, n long, near short, far short, row long, pos int, lo short, hi short, bytes binary"
PIECE_KINDS = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]


def table_of(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def contexts(docs: DataFrame, size: int) -> DataFrame:
    """The bytes of the listed runs, as PIECE; docs has row, text and runs."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r["h"], r["n"], 0, size - GRAM, row, r["pos"], r["lo"], r["hi"], text[r["pos"] - r["lo"] : r["pos"] - r["hi"] + size])
                for row, text, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                for r in listed
            ]
            yield table_of(rows, PIECE_KINDS, PIECE)

    return map_arrow(docs.select("row", "text", "runs"), cut, PIECE, 256)


def banded(pieces: DataFrame, size: int) -> DataFrame:
    """The pieces cut into bands by their suffixes' distance to the anchor; those of a band whose common bytes agree share the new bucket h."""
    schema = PIECE + ", c long, e long"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, n, near, far, row, pos, lo, hi, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = -(-(far - near + 1) // PARTS)
                for a in range(near, far + 1, width):
                    b = min(far, a + width - 1)
                    low, high = min(lo, b), max(hi, a)
                    if low < high:
                        continue
                    common = data[lo - a : lo + size - b]  # what all suffixes at distances a to b hold
                    bucket = hashlib.blake2b(common, digest_size=8, salt=(h & WORD).to_bytes(8, "little"), person=a.to_bytes(2, "little")).digest()
                    own = data[lo - low : lo - high + size]
                    c, e = np.frombuffer(digest(own, low), np.int64).tolist()
                    rows.append((int.from_bytes(bucket, "little", signed=True), n, a, b, row, pos, low, high, own, c, e))
            yield table_of(rows, [*PIECE_KINDS, pa.int64(), pa.int64()], schema)

    return map_arrow(pieces, cut, schema)


def spans_of(row: np.ndarray, start: np.ndarray, size: int) -> pa.RecordBatch:
    """Ranges of size bytes from each start, joined where they follow each other."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)]) if len(row) else np.empty(0, np.int64)
    tail = np.r_[head[1:], len(row)] - 1 if len(row) else head
    return pa.RecordBatch.from_arrays([pa.array(row[head], pa.int64()), pa.array(start[head], pa.int32()), pa.array(start[tail] + size, pa.int32())], ["row", "start", "end"])


def sorted_spans(pieces: DataFrame, size: int) -> DataFrame:
    """Each bucket sorted in one task, as many whole buckets at a time as SORTED bytes hold."""

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            h, row, pos, low, high = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))
            bucket = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            run, distance = sort_bucket(bucket, [r[5] for r in rows], low, high, size)
            return spans_of(row[run], pos[run] - distance, size)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight > SORTED and r[0] != held[-1][0]:
                    yield out(held)
                    held, weight = [], 0
                held.append(r)
                weight += len(r[5])
        if held:
            yield out(held)

    dealt = pieces.select("h", "row", "pos", "lo", "hi", "bytes").repartition(F.col("h")).sortWithinPartitions("h")
    return map_arrow(dealt, sort, "row long, start int, end int")


def remove_repeats(docs: DataFrame, size: int = 200, crowd: int = CROWD) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    Every row is a document of its own, also rows that share a doc_id or have none: rows with equal texts
    are each other's repeats. A null or empty text, or one of fewer than size bytes, loses nothing. Other
    columns, whatever their names, are not read. Rows are numbered once, in a working table.
    """
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), "documents")
    gone = materialize(repeated_spans(docs.select("row", "text"), size, crowd).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")
    touched, untouched = bloom.apart(docs.select("row", "doc_id", "text"), gone.select("row"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out, at, spans = [], 0, 0
                for start, end in sorted((g["start"], min(g["end"], len(text))) for g in gone or ()):
                    if start >= len(text):
                        continue
                    if start > at or not spans:
                        out.append(text[at:start])
                        spans += 1
                    at = max(at, end)
                out.append(text[at:])
                kept = b"".join(out)
                rows.append((len(text), len(text) - len(kept), spans, kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    cutting = map_arrow(touched.join(gone.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "gone"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", 512)
    size_of = F.octet_length("text").cast("long")
    return cutting.unionByName(untouched.select("doc_id", size_of.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept")))
