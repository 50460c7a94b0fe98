"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; training learns only their probabilities, for
each language, by expectation and maximisation over the words of a bounded sample. A word's
probability in a language is the sum over all ways to cut it into pieces, which the forward
algorithm computes; a text's is the product over its words. The prediction is the likeliest
language, its score the posterior probability under equal priors.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of, map_arrow, only, unit_hash

#: A word: a letter, and letters and combining marks after it. Digits and other number characters are none.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Stands before each word, as in the vocabulary.
START = "▁"
#: Words below this length go through the batched forward algorithm; longer ones rescale as they go, and
#: training cuts them into parts below it, so that no probability underflows.
SHORT = 32
#: Words that go through it at once: some 10 MB.
BLOCK = 4096
#: Least probability of a piece, and that of a character that no piece covers.
FLOOR, UNKNOWN = 1e-7, 1e-8
#: Tokens that a worker remembers; the first ones stay, as frequent tokens come early.
MEMO = 300_000
#: Becomes blank before texts are cut into tokens, so that a word with and without it is one token.
MARKS = ".,;:!?()\"[]"


def vocabulary(path: str) -> list[str]:
    """The pieces of letters in lower case of a SentencePiece model, with the word start or without."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if (q := p.removeprefix(START)).lower() == q and (LETTERS.fullmatch(q) or p == START)})


class Pieces:
    """Finds the pieces in words. Piece 0 stands for a character that no piece covers."""

    def __init__(self, pieces: list[str]):
        self.names = ["", *pieces]
        self.ids = {p[:k]: 0 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(self.names) if i}

    def edges(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) of each piece in START + word, by start."""
        text, get = START + word, self.ids.get
        for i in range(len(text)):
            if not get(text[i]):
                yield i, i + 1, 0
            for j in range(i + 1, len(text) + 1):
                piece = get(text[i:j])
                if piece is None:
                    break
                if piece:
                    yield i, j, piece

    def codes(self, word: str, out: array) -> int:
        """Append the edges of a short word as numbers, start << 32 | end << 24 | piece; returns how many."""
        text, get, put, before = START + word, self.ids.get, out.append, len(out)
        n = len(text)
        for i in range(n):
            piece, j, base = get(text[i]), i + 1, i << 32
            put(base | j << 24 | (piece or 0))
            while piece is not None and j < n:
                j += 1
                piece = get(text[i:j])
                if piece:
                    put(base | j << 24 | piece)
        return len(out) - before


class Lattice:
    """The edges of many words, in the order in which the forward algorithm needs them."""

    def __init__(self, pieces: Pieces, words: list[str]):
        codes, size = array("q"), array("q")
        for word in words:
            size.append(pieces.codes(word, codes))
        code = np.frombuffer(codes, np.int64) if len(codes) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.frombuffer(size, np.int64) if len(size) else 0)
        order = np.argsort((code >> 24 & 255).astype(np.uint8), kind="stable")
        code, self.word = code[order], word[order]
        self.start, self.end, self.piece = (code >> 32).astype(np.int32), (code >> 24 & 255).astype(np.int32), (code & 0xFFFFFF).astype(np.int32)
        self.length = np.array([len(w) + 1 for w in words], dtype=np.int32)
        self.width = int(self.length.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(self.width + 2))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]; prob[piece, language]."""
        alpha = np.zeros((len(self.length), self.width + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for at in range(1, self.width + 1):
            part = slice(self.cuts[at], self.cuts[at + 1])
            word = self.word[part]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            alpha[word[first], at] = np.add.reduceat(alpha[word, self.start[part]] * prob[self.piece[part]], first, axis=0)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.length), self.width + 1, prob.shape[1]))
        beta[np.arange(len(self.length)), self.length] = 1
        by_start = np.argsort(self.start * np.int64(len(self.length) + 1) + self.word, kind="stable")
        cuts = np.searchsorted(self.start[by_start], np.arange(self.width + 1))
        for at in range(self.width - 1, -1, -1):
            part = by_start[cuts[at] : cuts[at + 1]]
            word = self.word[part]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            beta[word[first], at] = np.add.reduceat(beta[word, self.end[part]] * prob[self.piece[part]], first, axis=0)
        return beta


class Model:
    """Probabilities of pieces for each language; log_words scores words."""

    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray, remember: int = MEMO):
        self.pieces, self.langs, self.prob, self.remember = pieces, langs, prob, remember
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs) + 1))

    def __getstate__(self) -> dict:
        return {"names": self.pieces.names, "langs": self.langs, "prob": self.prob, "remember": self.remember}

    def __setstate__(self, state: dict) -> None:
        self.__init__(Pieces(state["names"][1:]), state["langs"], state["prob"], state["remember"])

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word) for each language, summed over all segmentations."""
        out = np.empty((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) < SHORT]
        for at in range(0, len(short), BLOCK):
            part = short[at : at + BLOCK]
            lattice = Lattice(self.pieces, [words[i] for i in part])
            out[part] = np.log(lattice.forward(self.prob)[np.arange(len(part)), lattice.length])
        for i in (i for i, w in enumerate(words) if len(w) >= SHORT):
            out[i] = self.log_long(words[i])
        return out

    def log_long(self, word: str) -> np.ndarray:
        """The same for one word of any length: positions are rescaled, so nothing underflows."""
        n, scale = len(word) + 1, np.zeros(len(self.langs))
        alpha: dict[int, np.ndarray] = {0: np.ones(len(self.langs))}
        at, reach = 0, 1
        for start, end, piece in self.pieces.edges(word):
            if start > at:  # edges come by start: alpha[start] is complete
                at = start
                top = alpha[at].copy()
                scale += np.log(top)
                alpha = {k: v / top for k, v in alpha.items() if k >= at}
            alpha[end] = alpha.get(end, 0) + alpha[start] * self.prob[piece]
            reach = max(reach, end)
        return scale + np.log(alpha[n])

    def tokens(self, tokens: Iterable[str]) -> tuple[dict[str, int], np.ndarray]:
        """(numbers of the tokens that weren't known, rows): what each token adds to a text's score.

        A token adds the sum over its words for each language, and in the last column its letters. Rows of
        tokens that are remembered come first.
        """
        new = [t for t in tokens if t not in self.memo]
        if not new:
            return {}, self.rows
        split = [(t,) if t.isalpha() else LETTERS.findall(t) for t in new]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for p in split for w in p))}
        value = self.log_words(list(words)) if words else np.zeros((0, len(self.langs)))
        flat = np.array([words[w] for p in split for w in p], dtype=np.int64)
        size = np.array([len(p) for p in split])
        rows = np.zeros((len(new), len(self.langs) + 1))
        if len(flat):
            rows[size > 0, :-1] = np.add.reduceat(value[flat], (np.cumsum(size) - size)[size > 0], axis=0)
            rows[:, -1] = [sum(map(len, p)) for p in split]
        kept = min(len(new), max(0, self.remember - len(self.memo)))
        at = len(self.memo)
        if at + kept > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(kept, len(self.rows)), len(self.langs) + 1))])
        self.rows[at : at + kept] = rows[:kept]
        self.memo.update(zip(new[:kept], range(at, at + kept), strict=True))
        extra = dict(zip(new[kept:], range(len(self.rows), len(self.rows) + len(new) - kept), strict=True))
        return extra, np.concatenate([self.rows, rows[kept:]]) if extra else self.rows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, log-likelihood for each letter) of each text; und, 0 and null for null, for no letters and for an empty model."""
        if not self.langs:
            return [("und", 0.0, None)] * len(texts)
        split = []
        for text in texts:
            plain = (text or "").lower()
            for mark in MARKS:
                plain = plain.replace(mark, " ")
            split.append(plain.split())
        extra, rows = self.tokens({t for s in split for t in s})
        number = self.memo.__getitem__ if not extra else lambda t: self.memo[t] if t in self.memo else extra[t]
        out = []
        for text, s in zip(texts, split, strict=True):
            if not s or not LETTERS.search(text):
                out.append(("und", 0.0, None))
                continue
            *total, letters = rows[np.fromiter(map(number, s), np.int64, len(s))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1 / np.exp(np.array(total) - total[best]).sum()), float(total[best] / letters)))
        return out


def parts(word: str) -> list[str]:
    """A word as training counts it: in parts of fewer than SHORT characters."""
    return [word[i : i + SHORT - 1] for i in range(0, len(word), SHORT - 1)]


def fit(counts: dict[str, dict[str, int]], pieces: Pieces, rounds: int = 3) -> Model:
    """EM over word counts of each language; languages in order of name, so ties go to the first."""
    langs = sorted(counts)
    short: dict[str, Counter] = {lang: Counter() for lang in langs}
    for lang in langs:
        for word, n in counts[lang].items():
            for part in parts(word):
                short[lang][part] += n
    counts = short
    words = sorted({w for c in counts.values() for w in c})
    at = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), len(langs)))
    for n, lang in enumerate(langs):
        for w, c in counts[lang].items():
            weight[at[w], n] = c
    size = len(pieces.names)
    prob = np.full((size, len(langs)), 1 / size)
    block = 20_000  # words at once
    for _ in range(rounds if words else 0):
        expected = np.full(prob.shape, 0.01)
        for lo in range(0, len(words), block):
            lattice, w = Lattice(pieces, words[lo : lo + block]), weight[lo : lo + block]
            alpha, beta = lattice.forward(prob), lattice.backward(prob)
            share = w / alpha[np.arange(len(w)), lattice.length]
            flow = alpha[lattice.word, lattice.start] * prob[lattice.piece] * beta[lattice.word, lattice.end] * share[lattice.word]
            for n in range(len(langs)):
                expected[:, n] += np.bincount(lattice.piece, flow[:, n], minlength=size)
        prob = np.maximum(expected / expected.sum(axis=0), FLOOR)
    prob[0] = UNKNOWN
    return Model(pieces, langs, prob)


def train(docs: DataFrame, vocabulary_path: str, held_out: F.Column, docs_per_language: int = 200, words_per_language: int = 200_000) -> Model:
    """Learn every language of rows with a language that are not held out.

    Bounds of the sample, whatever the input: about docs_per_language documents of each language,
    chosen by a hash of doc_id, and of their distinct words the words_per_language most frequent ones.
    Words of any length count, and so do documents of any length.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select("lang", "text", unit_hash("doc_id", 11).alias("chance"))
    sizes = known.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("size"))
    sample = known.join(F.broadcast(sizes), F.col("lang") == F.col("name")).where(F.col("chance") * F.col("size") < docs_per_language).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in LETTERS.findall(text.lower()))
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "word", "n"])

    totals = map_arrow(sample, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts: dict[str, dict[str, int]] = {}
    for r in totals.withColumn("place", place).where(F.col("place") <= words_per_language).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    pieces = Pieces(vocabulary(vocabulary_path))
    if not counts:
        return Model(pieces, [], np.zeros((len(pieces.names), 0)))
    return fit(counts, pieces)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and per_letter; its other columns stay, columns of these names are replaced.

    per_letter is the logarithm of the text's likelihood in the language predicted, for each letter: about
    -3 for a text of that language, near that of unknown characters for one of none that was learned.
    """
    new = ("lang_pred", "score", "per_letter")
    own = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = own.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = only(shared.value).predict(batch.column(at).to_pylist())
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*own, *new])

    return map_arrow(docs.select(*own), run, docs.select(*own).schema.add("lang_pred", "string").add("score", "double").add("per_letter", "double"))


def held_out() -> F.Column:
    """Documents kept from training: crc32 of doc_id as text, mod 4, is 2; a null doc_id is not."""
    return F.pmod(crc_of("doc_id"), F.lit(4)) == 2


def detect(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 200, remember: int = MEMO) -> DataFrame:
    """Train on docs (doc_id, text, lang), then docs with held_out, lang_pred, score and per_letter.

    A text that is null or has no letters (number characters are none) is und with score 0, as are all if
    no row has a language. Null ids and repeated rows are kept; ties go to the first language by name.
    remember bounds the tokens that a worker remembers; results don't depend on it.
    """
    model = train(docs, vocabulary_path, held_out(), docs_per_language)
    model.remember = remember
    return identify(docs.withColumn("held_out", held_out()), model)
