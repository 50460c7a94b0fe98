"""Ignore-file patterns as regular expressions, on the driver and as column conditions.

A list of patterns decides about a path by its last pattern that matches. There are two ways to ask:
about the path itself, where a pattern for a folder says nothing about what is below; and about the
path or, failing that, its nearest parent that any pattern matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """regex matches whole relative paths; it is valid in Python and in Java."""

    regex: str
    negated: bool
    folders_only: bool


def _segment(glob: str) -> str:
    """One path segment of a pattern as a regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed character class in pattern {glob!r}")
            body, i = glob[i:end], end + 1
            inverse = body[:1] in ("!", "^")
            inside = re.sub(r"([\\\[\]&~^])", r"\\\1", body[inverse:])
            out.append(f"(?!/)[{'^' if inverse else ''}{inside}]")
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ValueError(f"unclosed alternatives in pattern {glob!r}")
            out.append("(?:" + "|".join(_segment(x) for x in glob[i:end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def compile_pattern(line: str) -> Pattern | None:
    """A line of an ignore file; None for a blank line and a comment."""
    text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    folders_only = text.endswith("/")
    parts = text.rstrip("/").lstrip("/").split("/")
    anchored = "/" in text.rstrip("/")
    if not anchored:
        parts = ["**", *parts]
    regex = ""
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            regex += ".+" if last else "(?:[^/]+/)*"
        else:
            regex += _segment(part) + ("" if last else "/")
    return Pattern(regex, negated, folders_only)


def compile_patterns(lines: list[str]) -> list[Pattern]:
    return [p for line in lines if (p := compile_pattern(line))]


def decide(patterns: list[Pattern], path: str, is_folder: bool = False) -> bool | None:
    """True if the last pattern that matches takes the path, False if it is negated, None without one."""
    for p in reversed(patterns):
        if (is_folder or not p.folders_only) and re.fullmatch(p.regex, path, re.DOTALL):
            return not p.negated
    return None


def takes(patterns: list[Pattern], path: str, parents: bool = False) -> bool:
    """Whether the patterns take a file's path, or (parents) its nearest parent that any of them matches."""
    found = decide(patterns, path)
    while found is None and parents and "/" in path:
        path = path.rpartition("/")[0]
        found = decide(patterns, path, is_folder=True)
    return bool(found)


def _decision(patterns: list[Pattern], path: Column, is_folder: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for p in patterns:  # the last one that matches ends up outermost
        hit = path.rlike(f"^(?s:{p.regex})$(?!\\n)")
        out = F.when(hit & is_folder if p.folders_only else hit, F.lit(not p.negated)).otherwise(out)
    return out


def taken(patterns: list[Pattern], path: Column, parents: bool = False) -> Column:
    """takes() as a condition on a column of paths, so that it can be pushed to where paths are read."""
    if not patterns:
        return F.lit(False)
    own = _decision(patterns, path, F.lit(False))
    if parents:
        parts = F.split(path, "/")
        above = F.transform(F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        decided = F.filter(F.transform(above, lambda p: _decision(patterns, p, F.lit(True))), lambda d: d.isNotNull())
        own = F.coalesce(own, F.try_element_at(decided, F.lit(1)))
    return F.coalesce(own, F.lit(False))
