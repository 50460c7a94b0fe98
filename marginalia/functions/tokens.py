"""Token counts by a byte-pair vocabulary in the tiktoken format, whose path is a parameter.

The budgets of rule files are meant for o200k_base, which needs a download. Without its file any
other vocabulary is a stand-in: the counts are then labelled with its name, never as o200k.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The pattern by which o200k_base splits texts.
O200K = "|".join(
    [
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)


class TokenCounter:
    """Counts tokens; name says by which vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.name, self.pattern = os.path.splitext(os.path.basename(path))[0], pattern
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


def count_tokens(counter: TokenCounter) -> Callable[[Column], Column]:
    """A column function for the tokens of whole texts; a worker builds the encoding once."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = counter.encoding()
        for part in texts:
            yield part.map(lambda t: len(encoding.encode_ordinary(t or ""))).astype("int64")

    return count
