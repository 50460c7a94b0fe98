"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Byte-pair encoding of a prefix ends in exactly one token. So for each prefix of a piece the encoder
stores that last token: the token t that ends there, such that the prefix before t ends in a token
that may stand before t. Following the stored tokens backwards gives the encoding. Appending bytes
extends the table; after an edit only the entries from there on are computed again, until they are
as before. Whether one token may stand before another is asked of the merge rules once for each
pair and then remembered.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, only

#: The ids of a part of a text, these joined by commas, and the bytes that they decode to.
Unit = tuple[tuple[int, ...], str, bytes]
IDS, JOINED, DECODED = map(itemgetter, range(3))
#: Pieces, parts between single spaces, pairs of tokens, and prefixes of pieces with their last tokens that a
#: worker remembers, of each at most; pieces and parts of more than MEMO_BYTES it doesn't.
MEMO, MEMO_BYTES = 300_000, 64
#: A single space that starts a match of the pattern.
SINGLE = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file in the tiktoken format, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes pieces and whole texts, and decodes ids. Workers keep its memory, bounded by remember, between tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = MEMO):
        self.ranks, self.pattern, self.remember = ranks, pattern, remember
        self.split = regex.compile(pattern)
        self.cuts = pattern == public_tokenizers.PATTERN  # whether single spaces start a match, as encode() may use
        self.token = {rank: token for token, rank in ranks.items()}
        self.text = {rank: str(rank) for rank in self.token}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.begins: dict[bytes, int] = {}  # each prefix of a token that is a proper token itself has its rank, else -1
        for token in ranks:
            for k in range(1, len(token)):
                self.begins.setdefault(token[:k], -1)
        for token, rank in ranks.items():
            # a token that its own bytes don't merge to never ends a prefix
            self.begins[token] = rank if self.merge(token) == [rank] else self.begins.get(token, -1)
        self.forget()

    def forget(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, Unit] = {}

    def __reduce__(self) -> tuple:
        return Codec, (self.ranks, self.pattern, self.remember)

    def merge(self, piece: bytes) -> list[int]:
        """The merge rules themselves, for short pieces: always the leftmost pair of least rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            ranked = [(get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two tokens."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece. The last tokens of its prefixes are remembered, as words share their beginnings."""
        n = len(piece)
        if n > MEMO_BYTES:
            return Prefixes(self, piece).ids()
        prefixes, begins, pairs = self.prefixes, self.begins.get, self.pairs.get
        last = [-1]
        for j in range(1, n + 1):
            token = prefixes.get(piece[:j])
            if token is None:
                break
            last.append(token)
        room = len(prefixes) < self.remember
        for j in range(len(last), n + 1):
            for i in range(j - 1, -1, -1):
                token = begins(piece[i:j])
                if token is not None and token >= 0:
                    if not i:
                        break
                    fits = pairs(last[i] << 20 | token)
                    if fits is None:
                        fits = self.may_follow(last[i], token)
                    if fits:
                        break
            last.append(token)
            if room:
                prefixes[piece[:j]] = token
        out, size = [], self.size
        while n:
            out.append(last[n])
            n -= size[last[n]]
        out.reverse()
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """The ids of a part of a text that no match of the pattern crosses the ends of."""
        out: list[int] = []
        matches = self.split.findall(part)
        for piece in matches:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode()))
                if len(matches) > 1 and len(piece) <= MEMO_BYTES and len(self.pieces) < self.remember:
                    self.pieces[piece] = ids
            out += ids
        return tuple(out)

    def unit(self, part: str) -> Unit:
        ids = self.encode_part(part)
        return ids, ",".join(map(self.text.__getitem__, ids)), self.decode(ids)

    def spaced_unit(self, part: str) -> Unit:
        """The unit of a space and what follows it, which is remembered."""
        found = self.spaced.get(part)
        if found is None:
            found = self.unit(" " + part)
            if len(part) <= MEMO_BYTES and len(self.spaced) < self.remember:
                self.spaced[part] = found
        return found

    def units(self, text: str) -> list[Unit]:
        """A text in parts, each with its ids, these as text, and what they decode to.

        By the shipped pattern a single space between characters that aren't white space starts a match
        whatever stands around it, so parts between such spaces are encoded, and remembered, on their own.
        Texts that another pattern splits aren't cut.
        """
        if not text:
            return []
        if not self.cuts:
            return [self.unit(text)]
        first, *parts = text.split(" ")
        if not first or first[-1].isspace():
            return self.units_between(text)
        out = [self.unit(first)]
        get = self.spaced.get
        for part in parts:
            found = get(part)
            if found is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self.units_between(text)
                found = self.spaced_unit(part)
            out.append(found)
        return out

    def units_between(self, text: str) -> list[Unit]:
        """The same where white space comes in runs: cut only at single spaces between other characters."""
        cuts = [0, *(space.start() for space in SINGLE.finditer(text)), len(text)]
        first, *parts = (text[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        return [self.unit(first), *(self.spaced_unit(p[1:]) for p in parts)]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, each match of the pattern on its own, no special tokens."""
        return [i for ids, _, _ in self.units(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Prefixes:
    """For each prefix of a piece, by its length, the last token of its encoding.

    append() extends the piece and edit() replaces a range of it. Both keep the table exact, and
    compute only what the change can reach.
    """

    def __init__(self, codec: Codec, piece: bytes = b""):
        self.codec, self.piece, self.last = codec, piece, [-1] * (len(piece) + 1)
        self.fill(0)

    def append(self, more: bytes) -> None:
        self.edit(len(self.piece), len(self.piece), more)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace piece[start:end] by new."""
        tail, after = self.last[end:], start + len(new)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = self.last[: start + 1] + [-1] * (len(self.piece) - start)
        self.fill(start, after, tail)

    def fill(self, known: int, after: int = 0, tail: list[int] | None = None) -> None:
        """Compute the entries beyond the first known + 1, which are right.

        tail: the entries of an earlier table for the same bytes, from the entry after on. Once as
        many entries in a row agree with it as a token has bytes, it holds for the rest.
        """
        piece, last, n = self.piece, self.last, len(self.piece)
        begins, pairs, longest = self.codec.begins.get, self.codec.pairs.get, self.codec.longest
        agreed = 0
        for i in range(max(0, known - longest), n):
            before = last[i]
            if tail is not None and i >= after:
                agreed = agreed + 1 if before == tail[i - after] else 0
                if agreed >= longest:
                    last[i:] = tail[i - after :]
                    return
            for j in range(i + 1, n + 1):
                token = begins(piece[i:j])
                if token is None:
                    break
                if token >= 0 > last[j]:  # the last token is unique, so one that is known needs no other
                    fits = pairs(before << 20 | token) if i else True
                    if fits is None:
                        fits = self.codec.may_follow(before, token)
                    if fits:
                        last[j] = token

    def ids(self) -> list[int]:
        out, at, last, size = [], len(self.piece), self.last, self.codec.size
        while at:
            token = last[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


def encode_and_decode(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, ids (list of int), decoded (bytes).

    The vocabulary is read on the driver and sent to the workers; its size doesn't depend on docs.
    A null text is empty and has no ids. Null ids and repeated rows are kept as they are; other
    columns, whatever their names, are not read. To get digests only, see digests().
    """
    codec = shared_codec(docs.sparkSession, vocabulary_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [only(codec.value).encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [codec.value.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(as_long("doc_id"), as_text("text")), run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = False, remember: int = MEMO) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids); as encode_and_decode() otherwise.

    ids_sha256 is that of the decimal ids joined by commas. The decoded bytes stay in the worker. remember
    bounds a worker's memory, at some 700 bytes each; results don't depend on it.
    """
    codec = shared_codec(docs.sparkSession, vocabulary_path, pattern, remember)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units_of = only(codec.value).units
            of_ids, of_bytes, sizes = [], [], [0]
            whole = array("i")
            for t in batch.column(1).to_pylist():
                units = units_of(t or "")
                sizes.append(sizes[-1] + sum(map(len, map(IDS, units))))
                of_ids.append(hashlib.sha256(",".join(map(JOINED, units)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(DECODED, units))).hexdigest())
                if with_ids:
                    for ids in map(IDS, units):
                        whole.extend(ids)
            size = pa.array([b - a for a, b in zip(sizes, sizes[1:], strict=False)], pa.int64())
            ids = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(whole, np.int32), pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), *ids], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(as_long("doc_id"), as_text("text")), run, schema)


def shared_codec(spark: SparkSession, vocabulary_path: str, pattern: str, remember: int = MEMO) -> Broadcast:
    return spark.sparkContext.broadcast(Codec(load_ranks(vocabulary_path), pattern, remember))


def as_long(column: str) -> F.Column:
    return F.col(column).cast("long").alias(column)


def as_text(column: str) -> F.Column:
    return F.col(column).cast("string").alias(column)
