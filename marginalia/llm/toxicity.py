"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

A text gives a few numbers: densities of a small fixed lexicon and of words and word beginnings that
training finds in toxic texts, how near they stand to a second person, capitals, punctuation and
obfuscated spelling. Trees are grown on the driver from a bounded sample; scoring reads every text
once, in the workers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, map_arrow, materialize, unit_hash, utf8

#: Insults that count without training.
LEXICON = frozenset(b"idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting dumb clown garbage".split())
#: Second persons of some languages.
SECOND = frozenset("you your yours u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes ti tus vosotros".encode().split())
#: Punctuation becomes a blank before words are cut.
BLANKS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
CAPITALS, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
OBFUSCATED = re.compile(rb"[A-Za-z][A-Za-z]*[0-9@$!*|][A-Za-z0-9@$!*|]*[A-Za-z]")
PLAIN = bytes.maketrans(b"013457@$!|ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastasiiabcdefghijklmnopqrstuvwxyz")
#: Bytes of a word's beginnings that may be learned.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words between a lexicon word and a second person that are still near.
NEAR = 5
FEATURES = 13
#: Parts of the sample, and the likelihood ratio from which a gram is learned.
FOLDS, LEAST_RATIO = 4, 10


def grams(words: Iterable[bytes]) -> set[bytes]:
    """What may be learned of words: the words, and their beginnings marked by a star."""
    out = set(words)
    return out | {w[:k] + b"*" for w in out for k in BEGINNINGS if len(w) > k}


class Features:
    """Turns texts into rows of FEATURES numbers."""

    def __init__(self, learned: Iterable[bytes]):
        learned = set(learned)
        self.words = LEXICON | {g for g in learned if not g.endswith(b"*")}
        self.stems = {g[:-1] for g in learned if g.endswith(b"*")}
        self.heads = {s[: BEGINNINGS[0]] for s in self.stems}

    def hits(self, words: list[bytes]) -> list[int]:
        """Places of words in the lexicon, or with a learned beginning."""
        known, heads, stems, first = self.words, self.heads, self.stems, BEGINNINGS[0]
        return [i for i, w in enumerate(words) if w in known or (w[:first] in heads and any(w[:k] in stems for k in BEGINNINGS if len(w) > k))]

    def of(self, text: bytes) -> list[float]:
        words = text.translate(BLANKS).split()
        n = max(1, len(words))
        at = self.hits(words)
        near = sum(1 for i in at if not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])) if at else 0
        letters = len(text) - len(text.translate(None, LETTERS))
        capitals = len(text) - len(text.translate(None, CAPITALS))
        marks = len(text) - len(text.translate(None, MARKS))
        odd = OBFUSCATED.findall(text)
        hidden = sum(1 for w in odd if w.translate(PLAIN) in self.words)
        fixed = sum(1 for i in at if words[i] in LEXICON)
        size = max(1, len(text))
        return [
            math.log1p(n), len(at) / n, math.log1p(len(at)), float(len({words[i] for i in at})), fixed / n, math.log1p(fixed), near / n, float(near),
            capitals / max(1, letters), text.count(b"!") / size, marks / size, len(odd) / n, math.log1p(hidden),
        ]

    def table(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.of(t) for t in texts], dtype=np.float64).reshape(-1, FEATURES)


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into BINS bins."""

    BINS = 32

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.BINS + 1)[1:-1], method="lower")) if len(x) else np.empty(0) for k in range(x.shape[1])]
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base, self.trees = math.log(mean / (1 - mean)), []
        bins = self.bin(x)
        total = np.full(len(x), self.base)
        for _ in range(rounds if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-total))
            tree: list[tuple[int, int]] = []  # (feature, last bin of the left) by node, breadth first
            node, gradient, weight = np.zeros(len(x), np.int64), y - p, p * (1 - p)
            for level in range(depth):
                count = 1 << level
                best = [(0.0, 0, self.BINS)] * count
                whole = [np.bincount(node, v, count) for v in (gradient, weight)]
                for k in range(x.shape[1]):
                    g, h = (np.cumsum(np.bincount(node * self.BINS + bins[:, k], v, count * self.BINS).reshape(count, -1), axis=1) for v in (gradient, weight))
                    g2, h2 = whole[0][:, None] - g, whole[1][:, None] - h
                    gain = np.where((h > 1e-6) & (h2 > 1e-6), g * g / (h + least) + g2 * g2 / (h2 + least) - (whole[0] ** 2 / (whole[1] + least))[:, None], 0.0)
                    for i, cut in enumerate(gain.argmax(axis=1)):
                        if gain[i, cut] > best[i][0] + 1e-9:
                            best[i] = (float(gain[i, cut]), k, int(cut))
                tree += [(k, cut) for _, k, cut in best]
                feature, cut = (np.array([b[j] for b in best]) for j in (1, 2))
                node = 2 * node + (bins[np.arange(len(x)), feature[node]] > cut[node])
            leaf = rate * np.bincount(node, gradient, 1 << depth) / (np.bincount(node, weight, 1 << depth) + least)
            self.trees.append((np.array(tree), leaf))
            total = total + leaf[node]
        self.depth = depth

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if x.shape[1] else x.astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, total, row = self.bin(x), np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                feature, cut = tree[(1 << level) - 1 + node].T
                node = 2 * node + (bins[row, feature] > cut)
            total += leaf[node]
        return total


class Isotonic:
    """A step function from margins to probabilities that never falls, by pooling adjacent violators."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        at, where = np.unique(margin, return_inverse=True)
        blocks: list[list[float]] = []  # sum, weight, last margin
        for i, (s, w) in enumerate(zip(np.bincount(where, y, len(at)), np.bincount(where, minlength=len(at)), strict=True)):
            blocks.append([float(s), float(w), float(at[i])])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, w, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, last]
        self.at = np.array([b[2] for b in blocks])
        self.value = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])  # never quite 0 or 1
        self.value = np.maximum.accumulate(self.value)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        """The step's value, moved a little by the margin, so that a step keeps the trees' order."""
        plain = 1 / (1 + np.exp(-margin))
        if not len(self.at):
            return plain
        return np.clip(0.95 * self.value[np.minimum(np.searchsorted(self.at, margin), len(self.at) - 1)] + 0.05 * plain, 0, 1)


class Model:
    def __init__(self, features: Features, trees: Trees, isotonic: Isotonic):
        self.features, self.trees, self.isotonic = features, trees, isotonic

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.isotonic(self.trees.margin(self.features.table(texts)))


def learn_grams(sample: DataFrame, limit: int = 5_000) -> list[list[bytes]]:
    """For each fold, and at last for all, the grams that tell toxic texts apart in the other folds: by the likelihood ratio, limit at most.

    sample has text, toxic and fold.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bytes, int], list[int]] = {}
            for text, label, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for gram in (b"", *grams(text.translate(BLANKS).split())):  # the empty gram counts the texts
                    found.setdefault((gram, fold), [0, 0])[label] += 1
            columns = ([k[0] for k in found], pa.binary()), ([k[1] for k in found], pa.int32()), ([v[1] for v in found.values()], pa.int64()), ([v[0] for v in found.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], ["gram", "fold", "toxic", "other"])

    each = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("other", "toxic") for k in range(FOLDS)]
    found = map_arrow(sample.select("text", "toxic", "fold"), count, "gram binary, fold int, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *each)
    rows = list(found.where("gram = X'' or (toxic >= 3 and toxic > 2 * other)").drop("toxic", "other").toLocalIterator())
    names = [bytes(r["gram"]) for r in rows]
    seen = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 2, FOLDS)  # gram, label, fold
    out = []
    for k in range(FOLDS + 1):
        kept = seen[:, :, [f for f in range(FOLDS) if f != k]].sum(axis=2)
        other, toxic = next((kept[i] for i, name in enumerate(names) if not name), (0, 0))
        p = toxic / max(1, other + toxic)
        scores = []
        for name, (b, a) in zip(names, kept.tolist(), strict=True):
            if not name or a < 3 or a <= 4 * b:
                continue
            both, ratio = a + b, 0.0
            for n, expected in ((a, both * p), (b, both * (1 - p)), (toxic - a, (other + toxic - both) * p), (other - b, (other + toxic - both) * (1 - p))):
                ratio += 2 * n * math.log(n / expected) if n and expected > 0 else 0
            if ratio > LEAST_RATIO:
                scores.append((-ratio, name))
        out.append([name for _, name in sorted(scores)[:limit]])
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: F.Column, per_label: int = 3_000) -> Model:
    """Learn from labelled documents that aren't held out.

    Bound of the sample, whatever the input: about per_label documents of each label, chosen by a
    hash of doc_id. It falls into FOLDS parts by another hash. The features of a part count words that
    the other parts taught, so trees see such words as they will be in new texts; for the calibration, too,
    each part is scored by trees of the others.
    A document with labels of both kinds isn't used. Without labels of both kinds scores follow from
    the few that there are, or are 0.5.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, per_label / max(1, sizes.get(1, 0))).otherwise(per_label / max(1, sizes.get(0, 0)))
    chosen = F.broadcast(known.where(unit_hash("doc_id", 23) < share).select("doc_id", F.col("toxic").cast("int").alias("toxic")))  # about 2 * per_label rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).join(chosen, "doc_id")
    part = unit_hash("doc_id", 29)
    sample = materialize(sample.select("text", "toxic", F.floor(part * FOLDS).cast("int").alias("fold"), part.alias("part")), "sample")
    learned = learn_grams(sample)
    features = [Features(g) for g in learned]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features[k].of(t) for t, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], ["toxic", "fold", "part", "x"])

    rows = map_arrow(sample, measure, "toxic int, fold int, part double, x array<double>").collect()
    rows.sort(key=lambda r: (r["part"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    fold = np.array([r["fold"] for r in rows], dtype=np.int64)
    margin = np.zeros(len(rows))
    for k in np.unique(fold):
        own = fold == k
        margin[own] = Trees(x[~own], y[~own]).margin(x[own])
    return Model(features[-1], Trees(x, y), Isotonic(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (1 from 0.5 on); its other columns stay, columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("score", "predicted", "_text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(len(own)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*own, "score", "predicted"])

    return map_arrow(docs.select(*own, utf8("text").alias("_text")), run, docs.select(*own).schema.add("score", "double").add("predicted", "integer"))


def held_out() -> F.Column:
    """Documents kept from training: crc32 of doc_id as text, mod 5, is 0."""
    return F.pmod(crc_of("doc_id"), F.lit(5)) == 0


def detect(docs: DataFrame, labels: DataFrame, per_label: int = 3_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text), learned from labels (doc_id, toxic).

    A null text is scored as the empty one. Null ids and repeated rows are kept; other columns are not read.
    """
    model = train(docs, labels, held_out(), per_label)
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")
