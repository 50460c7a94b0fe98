"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton reads a document's words and tracks the longest match that ends at each; where that
reaches a window (13 words, or a whole shorter item), the window's words are hit. Automata are built
for blocks of items of a bounded size, long items in parts that overlap by less than a window. One block
at a time is collected, built and broadcast, so the driver and a worker hold one of them whatever the
benchmark holds (about 600 bytes a word); with several blocks what each of them hits is written down, and
merged by document at the end. Only stretches of words whose neighbouring pairs all occur in the items are streamed: elsewhere the
automaton could match fewer words than the shortest window has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, numbered, utf8

#: Bytes of a word: digits, a-z after lower-casing, and all of a character beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words of the items in one automaton, about, and of a part of an item.
BLOCK_WORDS, PART_WORDS = 200_000, 20_000
NONE: frozenset[str] = frozenset()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """A generalised suffix automaton over the words of items [(name or None, words)]."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = 13):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for name, words in items if words]
        for _, word in coded:
            last = 0
            for w in word:
                last = self.extend(last, w)
        self.least = min([window, *(len(w) for _, w in coded)])
        pairs = {a << 32 | b for _, w in coded for a, b in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.names: dict[int, set[str]] = {}  # of a window's state: items that hold it
        self.whole: dict[int, list[tuple[int, str | None]]] = {}  # items shorter than a window that end a state's strings
        self.at = self.ancestors()
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for name, word in coded:
            state = 0
            for n, w in enumerate(word, 1):
                state = self.next[state][w]
                if n >= window and name is not None:
                    self.names.setdefault(self.at[state], set()).add(name)
            if len(word) < window:
                while self.length[self.link[state]] >= len(word):
                    state = self.link[state]
                ends.setdefault(state, []).append((len(word), name))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__) if ends else ():
            if found := ends.get(state, []) + self.whole.get(self.link[state], []):
                self.whole[state] = found

    def extend(self, last: int, w: int) -> int:
        """The state after the string of state last and the word w, which is added where it is new."""
        at = self.next[last].get(w)
        if at is not None:
            return at if self.length[at] == self.length[last] + 1 else self.clone(last, w, at)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            at = self.next[last][w]
            self.link[new] = at if self.length[at] == self.length[last] + 1 else self.clone(last, w, at)
        return new

    def clone(self, last: int, w: int, at: int) -> int:
        new = len(self.length)
        self.next.append(dict(self.next[at]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[at])
        self.link[at] = new
        while last >= 0 and self.next[last].get(w) == at:
            self.next[last][w] = new
            last = self.link[last]
        return new

    def ancestors(self) -> list[int]:
        """For each state of a window's length or more the state of the window that ends its strings."""
        out = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= self.window:
                out[state] = state if self.length[self.link[state]] < self.window else out[self.link[state]]
        return out

    def stretches(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers, 0 for one that no item holds, and ranges that could hold a window."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        if self.least < 2:
            good = ids > 0
        else:
            good = np.zeros(len(ids), dtype=bool)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            key = ids[at] << 32 | ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            good[at[self.pairs[place] == key]] = True
        edge = np.flatnonzero(np.diff(np.r_[False, good, False]))
        more = self.least >= 2
        return ids, [(a, b + more) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + more - a >= self.least]

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Mark the hit words, and collect the names of items with an occurring window."""
        if len(words) < self.least or not self.ids:
            return
        ids, ranges = self.stretches(words)
        step, link, length, whole = self.next, self.link, self.length, self.whole.get
        for begin, end in ranges:
            state = matched = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin):
                while state and w not in step[state]:
                    state = link[state]
                    matched = length[state]
                if w in step[state]:
                    state = step[state][w]
                    matched += 1
                if matched >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    found |= self.names.get(self.at[state], NONE)
                for size, name in whole(state, ()):
                    if size <= matched:
                        hit[i + 1 - size : i + 1] = True
                        if name is not None:
                            found.add(name)


def parts(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(name, words joined by blanks, their number) of the items (item_id, text), long ones in parts that together hold each window once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), most):
                    part = words[at : at + most + window - 1]
                    rows += [(name, b" ".join(part), len(part))] if part else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int64()))], ["name", "words", "n"])

    return map_arrow(benchmark.select(F.col("item_id").cast("string").alias("name"), utf8("text").alias("text")), cut, "name string, words binary, n long")


def automata(benchmark: DataFrame, window: int) -> Iterator[tuple[int, Automaton]]:
    """(number of blocks, automaton) for each block of the benchmark's items (item_id, text), built when it is asked for."""
    items = materialize(parts(benchmark, window, PART_WORDS), "items")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("name", "words"), F.lit(blocks))
    for k in range(blocks):
        rows = items.where(block == k).collect()  # about BLOCK_WORDS words
        yield blocks, Automaton([(r["name"], bytes(r["words"]).split()) for r in rows], window)


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text less the stretches of hit words, each from its first word's start to its last one's end."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, cleaned: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, contaminated (and clean, bytes, if asked for).

    docs needs doc_id and text, benchmark item_id and text. A null text has no words; an item with a
    null item_id hits words but isn't named; items that share an id count once. A document is
    contaminated if a word is hit, and one in share of its words at least. clean is the text less its
    hit spans. Of docs only doc_id and text are read unless cleaned, where its other columns stay and
    columns with the new names are replaced.
    """
    new = ["n_words", "n_hit", "n_items", "items", "contaminated", "clean"]
    own = [c for c in docs.columns if c not in new] if cleaned else ["doc_id"]
    schema = docs.select(*own).schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items", T.ArrayType(T.StringType())).add("contaminated", "boolean")
    if cleaned:
        schema = schema.add("clean", "binary")
    given = docs.select(*(F.col(c).alias(f"c{n}") for n, c in enumerate(own)), utf8("text").alias("_text"))
    blocks = automata(benchmark, window)
    count, automaton = next(blocks)
    if count == 1:
        return map_arrow(given, judged(schema, share, docs.sparkSession.sparkContext.broadcast(automaton)), schema)
    given, found = numbered(given, "documents"), None
    while automaton is not None:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        hits = materialize(hit_by(given, shared), "hits")
        shared.destroy()
        found = hits if found is None else found.union(hits)
        automaton = next(blocks, (count, None))[1]
    found = found.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("names")).alias("names"))
    joined = given.join(found, "row", "left").select(*given.columns[:-1], "starts", "ends", "names")
    return map_arrow(joined, judged(schema, share), schema)


def hit_by(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """(row, starts, ends, names) of the documents (row, _text) with hits: the ranges of hit words and the names of the items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, names = words_of(text), set()
                hit = np.zeros(len(words), dtype=bool)
                automaton.value.scan(words, hit, names)
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
                    rows.append((row, edge[::2], edge[1::2], sorted(names)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["row", "starts", "ends", "names"])

    return map_arrow(docs.select("row", "_text"), run, "row long, starts array<int>, ends array<int>, names array<string>")


def judged(schema: T.StructType, share: int, automaton: Broadcast | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The results of batches of documents' columns and text; hits come from the automaton, or else from the columns starts, ends and names."""
    cleaned = schema.names[-1] == "clean"
    width = len(schema.names) - 5 - cleaned

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hits, named, clean = [], [], [], []
            texts = batch.column(width).to_pylist()
            known = repeat((None, None, None)) if automaton else zip(*(batch.column(width + i).to_pylist() for i in (1, 2, 3)), strict=True)
            for text, (starts, ends, names) in zip(texts, known, strict=automaton is None):
                words, found = words_of(text), set(names or ())
                hit = np.zeros(len(words), dtype=bool)
                if automaton:
                    automaton.value.scan(words, hit, found)
                for a, b in zip(starts or (), ends or (), strict=True):
                    hit[a:b] = True
                size.append(len(words))
                hits.append(int(hit.sum()))
                named.append(sorted(found))
                if cleaned:
                    clean.append(without(text, hit) if hits[-1] else text)
            bad = [h > 0 and share * h >= n for h, n in zip(hits, size, strict=True)]
            arrays = [pa.array(size, pa.int64()), pa.array(hits, pa.int64()), pa.array(list(map(len, named)), pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays, *([pa.array(clean, pa.binary())] if cleaned else [])], schema.names)

    return run


def digest_of_items(column: str = "items") -> F.Column:
    """sha256 of the names, sorted as strings, joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(column)), 256)
