"""Sizes of files: lines and tokens, beside the limits that the rule file sets. A report, not a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.lint import with_policy
from marginalia.plans.config import Config


def sizes(files: DataFrame, config: Config, count: Callable[[Column], Column] | None = None, min_lines: int | None = None, min_tokens: int | None = None) -> DataFrame:
    """path, lines, max_lines, tokens and max_tokens of files (path, content), in the order of the paths' components.

    Without a token counter tokens are null. With bounds, files that reach one of them.
    """
    known = with_policy(files, config)
    tokens = count(F.col("content")).cast("long") if count else F.lit(None).cast("long")
    out = known.select("path", X.count_lines(F.col("content")).alias("lines"), F.col("policy.max_lines").alias("max_lines"), tokens.alias("tokens"), F.col("policy.max_tokens").alias("max_tokens"))
    bounds = [F.coalesce(F.col(c) >= least, F.lit(False)) for c, least in (("lines", min_lines), ("tokens", min_tokens)) if least is not None]
    if bounds:
        out = out.where(bounds[0] | bounds[-1])
    return out.orderBy(X.components(F.col("path")))
