"""SimHash near-duplicates, searched through BK-trees.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the document's shingle
hashes. Two fingerprints link if they differ in at most ``radius`` bits; a component is what links
reach.

The search does not broadcast a tree of the whole corpus, which would grow with it. Fingerprints
are distinct first, so copies cost nothing. A fingerprint is cut into ``radius + 2`` blocks: two of
them that link agree in at least two blocks, so every pair of blocks, with its bits, names a shard.
Each shard has its own BK-tree, built and searched in the task that holds the shard; children are
keyed by their integer distance to the parent, and a search follows only the edges within the
radius. A shard reports a star (member, root) for each of its components, never pairs; the stars of
all shards are joined by alternating large-star and small-star steps over working tables.

A shard of more than TILE fingerprints is cut into tiles, and each two tiles make a shard, so what a task
holds is bounded. In a dense shard neighbours in a few sorted orders are linked first; the search then
leaves out subtrees of the query's own component, and queries of the shard's largest component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, key_of, map_arrow, materialize, utf8

#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Queries that walk the trees of a task at once; fewer in large shards, so that at most FRONTIER nodes are looked at.
QUERIES, FRONTIER = 1 << 9, 1 << 22
#: Fingerprints of a shard beyond which it is cut into tiles, and beyond which neighbours are linked first.
TILE, DENSE = 1 << 15, 1 << 8
#: Edges up to which a hub's fit a task.
SMALL = 1_000_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; zero if it has no words."""
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint as a signed long) of each row; a null id gets the key NO_ID."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, words, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["key", "fp"])

    return map_arrow(docs.select(key_of("doc_id").alias("key"), utf8("text").alias("text")), run, "key long, fp long")


def blocks(count: int) -> list[tuple[int, int]]:
    """64 bits cut into blocks of (first bit, bits) that differ by one bit in size at most."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(column: F.Column, radius: int) -> F.Column:
    """The shards of a fingerprint: one for each pair of its radius + 2 blocks."""
    cut = blocks(radius + 2)
    keys = []
    for n, (a, b) in enumerate(combinations(cut, 2)):
        bits = [F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in (a, b)]
        keys.append((F.lit(n).cast("long") * F.lit(1 << 50)) + bits[0] * F.lit(1 << 25) + bits[1])
    return F.array(*keys)


class Forest:
    """BK-trees of many shards in arrays: node i has a value, and children by distance."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard: for each value the number of its shard, ascending from 0; values are distinct in a shard."""
        n = len(value)
        self.value, self.child = value, np.full((n, 65), -1, dtype=np.int32)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = first[shard].astype(np.int32)
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parent = self.root[waiting]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, their parents) from the roots' children on
        while len(waiting):
            distance = np.bitwise_count(value[waiting] ^ value[parent])
            slot = parent.astype(np.int64) * 65 + distance
            _, chosen = np.unique(slot, return_index=True)
            self.child.reshape(-1)[slot[chosen]] = waiting[chosen]
            self.levels.append((waiting[chosen], parent[chosen]))
            rest = np.ones(len(waiting), dtype=bool)
            rest[chosen] = False
            parent = self.child.reshape(-1)[slot[rest]]
            waiting = waiting[rest]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """For each node its label, if its whole subtree has it; else -1."""
        out = label.copy()
        for nodes, parents in reversed(self.levels):
            out[parents[out[nodes] != label[parents]]] = -1
        return out

    def search(self, queries: np.ndarray, radius: int, label: np.ndarray, uniform: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for each node within the radius and of another label, searched from the query's own root.

        With uniform, subtrees that have the query's label throughout aren't entered.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        query, node = queries, self.root[queries]
        steps = np.arange(-radius, radius + 1)
        while len(query):
            distance = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            near = (distance <= radius) & (label[query] != label[node])
            found.append((query[near], node[near]))
            at = distance[:, None] + steps
            below = np.where((at >= 0) & (at <= 64), self.child[node[:, None], np.clip(at, 0, 64)], -1)
            row, column = np.nonzero(below >= 0)
            query, node = query[row], below[row, column]
            if uniform is not None:
                enter = uniform[node] != label[query]
                query, node = query[enter], node[enter]
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def components(size: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label with the labels at both ends of each link made one, the least of all that links join."""
    left, right = label[left], label[right]
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for at in (root[left], root[right], left, right):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, root):
            return root[label]
        root = new


def stars(shard: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every member that links to another value of its shard; root is the least value."""
    order = np.lexsort((value, shard))
    shard, value = shard[order], value[order]
    fresh = np.r_[True, (shard[1:] != shard[:-1]) | (value[1:] != value[:-1])]
    shard, value = shard[fresh], value[fresh]
    label = labels(shard, value, radius)
    member = label != np.arange(len(value))
    return value[member], value[label[member]]


def roots(shard: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row that has the least value which links reach in its shard."""
    order = np.lexsort((value, shard))
    fresh = np.r_[True, (np.diff(shard[order]) != 0) | (value[order[1:]] != value[order[:-1]])]
    first = order[fresh]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = first[labels(shard[first], value[first], radius)[np.cumsum(fresh) - 1]]
    return out


def labels(shard: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct values in ascending order by shard the number of the least that links reach in it, by a BK-tree for each shard."""
    out = np.arange(len(value))
    edge = np.r_[True, shard[1:] != shard[:-1]]
    some = np.flatnonzero(np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1)
    if not len(some):
        return out
    shard, value = shard[some], value[some]
    shard = np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1
    forest, label = Forest(shard, value), np.arange(len(value))
    largest = int(np.bincount(shard).max())
    dense = largest > DENSE
    if dense:
        label = neighbours(shard, value, radius, label)
    # one end of each missing link is outside its shard's largest component
    order = np.lexsort((np.bincount(label, minlength=len(value))[label], shard))
    big = label[order[np.flatnonzero(np.r_[shard[order][1:] != shard[order][:-1], True])]]
    queries = np.flatnonzero(label != big[shard])
    step = max(16, min(QUERIES, FRONTIER // largest))
    uniform = forest.uniform(label) if dense else None
    for at in range(0, len(queries), step):
        left, right = forest.search(queries[at : at + step], radius, label, uniform)
        if len(left):
            label = components(len(value), left, right, label)
            uniform = forest.uniform(label) if dense else None
    out[some] = some[label]
    return out


def neighbours(shard: np.ndarray, value: np.ndarray, radius: int, label: np.ndarray) -> np.ndarray:
    """label lowered along links between values that follow each other in their shard, in the order of their bits turned by some steps."""
    found = []
    for turn in range(0, 64, 3):
        turned = value << np.uint64(turn) | value >> np.uint64(64 - turn) if turn else value
        order = np.lexsort((turned, shard))
        left, right = order[1:], order[:-1]
        near = (shard[left] == shard[right]) & (np.bitwise_count(value[left] ^ value[right]) <= radius)
        found.append((left[near], right[near]))
    return components(len(value), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), label)


def whole_shards(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of batches in order of their first, the shard, cut after about as many rows, where a shard ends."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        waiting += batch.num_rows
        if waiting < rows:
            continue
        kept = [np.concatenate(x) for x in zip(*held, strict=True)]
        whole = kept[0] != kept[0][-1]
        if whole.any():
            yield [x[whole] for x in kept]
        held = [[x[~whole] for x in kept]]
        waiting = len(held[0][0]) if whole.any() else 0  # a shard that grows is joined less often
    if held and any(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Stars (u, v), v < u unsigned, of the fingerprints in column fp within each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, value in whole_shards(batches):
            u, v = stars(shard, value.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    spread = distinct.select(F.explode(shard_keys(F.col("fp"), radius)).alias("shard"), "fp")
    spread = tiled(spread, tile).repartition(F.col("shard")).sortWithinPartitions("shard")
    return map_arrow(spread, run, "u long, v long", 10_000).distinct()


def tiled(spread: DataFrame, tile: int) -> DataFrame:
    """spread (shard, fp, more columns) with each shard of more than tile rows cut into tiles, and a shard for each two of them."""
    large = materialize(spread.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large")
    if large.isEmpty():
        return spread
    # a fingerprint has one row for each pair of blocks, so shards of more than tile rows are few for the rows there are
    tiles = F.ceil(F.col("n") / tile).cast("int") + 1
    own = F.pmod(F.xxhash64(F.lit(5), "fp"), tiles).cast("int")
    met = spread.join(large, "shard", "left").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), tiles - 1), lambda t: t != F.col("own"))
    pairs = F.transform(others, lambda t: F.xxhash64("shard", F.least(t, F.col("own")), F.greatest(t, F.col("own"))))
    return met.select(F.explode(F.when(F.col("n").isNull(), F.array("shard")).otherwise(pairs)).alias("shard"), *spread.drop("shard").columns)


def connect(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges (u, v) but the roots; a root is its component's least vertex.

    Alternates large-star and small-star steps; each reads and writes a working table, so a lost
    executor costs one step. Rounds grow with the logarithm of the longest path. From SMALL edges on the
    hub of a large component doesn't collect its edges in one task (join_hot).
    """

    def least(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return materialize(found, name) if many else found

    def meet(rows: DataFrame, found: DataFrame) -> DataFrame:
        return join_hot(rows, found, "u", "n") if many else rows.join(found.drop("n"), "u")

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = edges.count(), None
    while True:
        many = mark[0] > SMALL
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = meet(both, least(both, "least")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large")
        low = least(large, "low")
        small = meet(large, low).where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            return edges.select("u", F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fingerprint (hex), component_id.

    component_id is the least doc_id that links reach, the row's own included. Null and empty texts
    have fingerprint zero and link like any other. Rows with a null doc_id are kept; a component in
    which every id is null has a null component_id. Repeated rows come out as often as they came in.
    Other columns, whatever their names, are not read.
    """
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "distinct")
    roots = connect(links(distinct, radius)).withColumnRenamed("u", "fp")
    labelled = materialize(distinct.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "labelled")
    least = materialize(labelled.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("members")), "least")
    by_print = materialize(join_hot(labelled, least, "root", "members").select("fp", "component", "n"), "by_print")
    real = lambda c: F.when(F.col(c) != F.lit((1 << 63) - 1), F.col(c))
    return join_hot(prints, by_print, "fp", "n").select(
        real("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        real("component").alias("component_id"),
    )
