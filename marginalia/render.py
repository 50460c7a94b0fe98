"""Text for terminals: rows, diagnostics and hints. Only small, ordered results come here."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.analyzer import analyze_text, highlight
from marginalia.functions.text import row_field, shell_escape
from marginalia.runtime import ship

#: Colours of score bands.
BANDS = {"high": "32", "medium": "33", "low": "31"}
#: Colours of severities.
SEVERITIES = {"error": "31", "warning": "33"}


def field(text: str | None) -> str:
    return (text or "").replace("\r", " ").replace("\n", " ").replace("|", "\\|")


def row(path: str, name: str | None, description: str | None) -> str:
    """path | name | description."""
    return " | ".join(map(field, (path, name, description)))


EXPLAIN_HEADER = "score | relative | coverage | path | name | description"


@F.pandas_udf(T.StringType())
def _marked(text: pd.Series, query: pd.Series) -> pd.Series:
    terms = {q: set(analyze_text(q)) for q in query.unique()}
    return pd.Series([highlight(x or "", terms[q]) for x, q in zip(text, query, strict=True)])


def match_rows(found: DataFrame, query: str, colour: bool = False, explain: bool = False, path_only: bool = False) -> DataFrame:
    """found (path, name, description; with explain also score, relative, coverage and band) and line, its row of output.

    With colour the query's terms are marked in the row, and the score has its band's colour. A row that is
    the path only is never marked.
    """
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("path", "name", "description")]
    shown = [_marked(f, F.lit(query)) if colour else row_field(f) for f in fields]
    line = F.col("path") if path_only else F.concat_ws(" | ", *shown)
    if explain:
        score = F.format_string("%.2f", "score")
        band = F.element_at(F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair]), F.col("band"))
        line = F.concat_ws(" | ", F.concat(F.lit("\x1b["), band, F.lit("m"), score, F.lit("\x1b[0m")) if colour else score, "relative", "coverage", line)
    ship(found.sparkSession)
    return found.withColumn("line", line)


def diagnostics(found: DataFrame, colour: bool = False) -> DataFrame:
    """findings with text: two lines for each, where and what."""
    severity = F.col("severity")
    if colour:
        code = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), severity)
        severity = F.concat(F.lit("\x1b["), code, F.lit("m"), severity, F.lit("\x1b[0m"))
    where = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))
    head = F.concat_ws("  ", where, severity, "rule", F.when(F.col("fixable"), F.lit("fixable")))
    return found.withColumn("text", F.concat(head, F.lit("\n"), "message"))


def size_table(rows: list) -> list[str]:
    """Sizes as a table, paths to the left and numbers to the right; columns without any number are left out."""
    columns = ["path", *(c for c in ("lines", "max_lines", "tokens", "max_tokens") if c == "lines" or any(r[c] is not None for r in rows))]
    table = [[c.replace("_", "-") for c in columns], *([str(r[c]) if r[c] is not None else "" for c in columns] for r in rows)]
    width = [max(len(line[i]) for line in table) for i in range(len(columns))]
    return ["  ".join([line[0].ljust(width[0]), *(x.rjust(w) for x, w in zip(line[1:], width[1:], strict=True))]).rstrip() for line in table]


def fix_hint(count: int, rules: Iterable[str], targets: Iterable[str]) -> str | None:
    """What a fix would mend, and the command for it."""
    if not count:
        return None
    command = " ".join(["marginalia", "fix", *map(shell_escape, targets)])
    return f"{count} fixable finding{'s' if count != 1 else ''} ({', '.join(sorted(rules))}); run `{command}`"


def token_note(files: int, vocabulary: str | None) -> str:
    """By which vocabulary token budgets were checked, or that they weren't."""
    of = f"max-tokens of {files} file{'s' if files != 1 else ''}"
    if vocabulary is None:
        return f"{of} not checked: no --vocabulary given"
    return f"{of} checked by the vocabulary {vocabulary}"
