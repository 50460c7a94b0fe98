"""One analyzer for index, query and highlighting.

A text is split at white space and ASCII punctuation except the apostrophe; a chunk loses a
possessive ending and is split where camel case has a boundary; a part that the compound dictionary
holds becomes its terms, any other is lower-cased, loses a possessive ending, is dropped if empty or
a stop word, and stemmed. Tables go through built-in functions; the stemmer runs once for each
distinct term. The plain functions do the same for a query and for spans of a title.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.porter2 import stem
from marginalia.runtime import ship

#: The stop words and the compounds of the analyzer.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
COMPOUNDS = {"execplan": ("exec", "plan")}
#: Unicode white space, and ASCII punctuation but the apostrophe.
SEPARATORS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-&(-/:-@\x5B-\x60\x7B-\x7E]+"
_SEPARATORS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SEPARATORS))
_POSSESSIVE = re.compile(r"(?:'s|s')$", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@dataclass(frozen=True)
class Span:
    """A slice of the analyzed text with the terms it gives, none for what isn't searched."""

    surface: str
    terms: tuple[str, ...]


def term_of(part: str, stemmed: bool = True) -> tuple[str, ...]:
    low = _POSSESSIVE.sub("", part.lower())
    if not low or low in STOPWORDS:
        return ()
    return (stem(low) if stemmed else low,)


def spans(chunk: str, stemmed: bool = True) -> list[Span]:
    """The spans of a chunk without separators; joined, their surfaces are the chunk."""
    tail = m[0] if (m := _POSSESSIVE.search(chunk)) else ""
    base = chunk.removesuffix(tail)
    out: list[Span] = []
    for part in _CAMEL.split(base) if base else ():
        terms = COMPOUNDS.get(part.lower())
        if terms is None:
            out.append(Span(part, term_of(part, stemmed)))
            continue
        for at, term in zip((sum(map(len, terms[:i])) for i in range(len(terms))), terms, strict=False):
            out.append(Span(part[at : at + len(term)], (stem(term) if stemmed else term,)))
    return [*out, Span(tail, ())] if tail else out


def analyze_text(text: str, stemmed: bool = True) -> list[str]:
    """The terms of a text, in order, repeats kept."""
    return [t for chunk in _SEPARATORS.split(text) for s in spans(chunk, stemmed) for t in s.terms]


def analyze_path(path: str, stemmed: bool = True) -> list[str]:
    return analyze_text(path.removesuffix(".md"), stemmed)


def highlight(text: str, terms: set[str], begin: str = "\x1b[1m", end: str = "\x1b[0m") -> str:
    """text for a row of output, with the spans marked that give one of the terms."""
    out = []
    for piece in re.split(f"({_SEPARATORS.pattern})", text):
        if _SEPARATORS.fullmatch(piece):
            out.append(re.sub(r"[\r\n]", " ", piece).replace("|", "\\|"))
            continue
        out += [f"{begin}{s.surface}{end}" if terms.intersection(s.terms) else s.surface for s in spans(piece)]
    return "".join(out)


def parts(text: Column) -> Column:
    """An array of a text's parts in lower case; some may be empty.

    A chunk's possessive ending goes, then camel case is split. Both are done on the whole text, which
    is read by each pattern once, rather than for each chunk.
    """
    chunk_end = rf"(?i)(?:'s|s')(?={SEPARATORS[:-1]}|\z)"
    bare = F.when(F.contains(text, F.lit("'")), F.regexp_replace(text, chunk_end, "")).otherwise(text)
    split = F.regexp_replace(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.split(F.lower(split), SEPARATORS)


def explode_terms(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., raw): a row for each term of the column text, before stemming.

    Explodes first and filters after, so each step is a plain projection inside generated code.
    """
    out = df.select(*keep, F.explode(parts(F.col(text))).alias("part")).where("part != ''")
    part = F.col("part")
    whole = F.when(F.contains(part, F.lit("'")), F.regexp_replace(part, "(?:'s|s')$", "")).otherwise(part)
    expanded = F.array(whole)
    for compound, terms in COMPOUNDS.items():
        expanded = F.when(part == compound, F.array(*map(F.lit, terms))).otherwise(expanded)
    out = out.select(*keep, F.explode(expanded).alias("raw"))
    return out.where((F.col("raw") != "") & ~F.col("raw").isin(*STOPWORDS))


@F.pandas_udf(T.StringType())
def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in words:
        yield part.map(stem)


def stems_of(terms: DataFrame) -> DataFrame:
    """(raw, term): the stem of each distinct raw term."""
    ship(terms.sparkSession)
    return terms.select("raw").distinct().select("raw", _stems("raw").alias("term"))
