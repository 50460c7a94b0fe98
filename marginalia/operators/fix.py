"""Applying edits: byte ranges of a file replaced from its end to its start."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.runtime import ship


class OverlapError(ValueError):
    """Two edits of a file touch the same bytes."""


def overlaps(edits: DataFrame) -> DataFrame:
    """(path, start, end, next_start) of edits (path, start, end) that reach into the next one."""
    after = F.lead("start").over(Window.partitionBy("path").orderBy("start", "end"))
    return edits.select("path", "start", "end", after.alias("next_start")).where("end > next_start")


def apply(content: str, edits: list[tuple[int, int, str]]) -> str:
    """content with the edits (start, end, replacement) applied; offsets are UTF-8 bytes."""
    data, limit = content.encode(), None
    for start, end, new in sorted(edits, key=lambda e: -e[0]):
        if limit is not None and end > limit:
            raise OverlapError(f"overlapping fix edits at byte offsets {start}..{end} and {limit}..")
        data, limit = data[:start] + new.encode() + data[end:], start
    return data.decode()


@F.pandas_udf(T.StringType())
def _rewrite(content: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, lists in content:
        yield pd.Series([apply(t, [(e["start"], e["end"], e["replacement"]) for e in edits]) for t, edits in zip(texts, lists, strict=True)])


def rewrites(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, content) of the files that the edits of findings change. Nothing is written."""
    ship(files.sparkSession)
    edits = found.where("edit is not null").groupBy(F.col("file").alias("path")).agg(F.collect_list("edit").alias("edits"))
    changed = files.select("path", "content").join(edits, "path").withColumn("new", _rewrite("content", "edits"))
    return changed.where("new != content").select("path", F.col("new").alias("content"))


def summary(found: DataFrame) -> DataFrame:
    """One row: how many findings can be mended, and their rules in order."""
    return found.where("fixable").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("rule")).alias("rules"))


def write_back(changed: DataFrame, root: str | Path) -> int:
    """Overwrite the changed files below root, from the driver, one at a time; returns how many."""
    n = 0
    for row in changed.toLocalIterator():
        Path(root, row.path).write_bytes(row.content.encode())
        n += 1
    return n
