"""Front matter: a leading block of plain YAML between two lines of three hyphens.

Only what catalogues need is read: scalars, which stay text, lists of scalars, mappings one level
deep, and folded block scalars. Anything else makes the block malformed, with the line of the first
trouble. Spark has no expression for it, so a table is parsed in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A field's value: a text, a list of texts, or a mapping of texts.
Value = str | list[str] | dict[str, str]
_PAIR = T.StructType().add("key", "string").add("value", "string")
_FIELD = T.StructType().add("key", "string").add("kind", "string").add("scalar", "string").add("seq", T.ArrayType(T.StringType())).add("map", T.ArrayType(_PAIR))
SCHEMA = T.StructType().add("status", "string").add("malformed_line", "integer").add("fields", T.ArrayType(_FIELD))


@dataclass
class Frontmatter:
    status: str
    line: int | None = None
    fields: dict[str, Value] = field(default_factory=dict)


class Malformed(Exception):
    def __init__(self, line: int):
        self.line = line


@dataclass
class Line:
    """A line of the block: its number in the file, its text, and how far it is indented."""

    number: int
    text: str

    @property
    def bare(self) -> str:
        return self.text.strip()

    @property
    def indent(self) -> int:
        return len(self.text.encode()) - len(self.text.lstrip().encode())

    @property
    def empty(self) -> bool:
        return not self.bare or self.bare.startswith("#")


def split_lines(text: str) -> list[str]:
    """Lines end at a line feed, with a carriage return before it or not."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def parse(text: str | None) -> Frontmatter:
    lines = split_lines(text or "")
    if not lines or lines[0] != "---":
        return Frontmatter("none")
    if "---" not in lines[1:]:
        return Frontmatter("malformed", max(1, len(lines)))
    block = [Line(n, x) for n, x in enumerate(lines[1 : lines.index("---", 1)], 2)]
    try:
        return Frontmatter("valid", None, Block(block).mapping())
    except Malformed as bad:
        return Frontmatter("malformed", bad.line)


def scalar(text: str, line: int) -> str:
    """An inline value: matching outer quotes go, nothing is unescaped."""
    if text[:1] and text[0] in "{[&*!|>":
        raise Malformed(line)
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def pair(line: Line, seen: dict) -> tuple[str, str]:
    """Key and value of a line; the key is what stands before the first colon."""
    key, colon, value = line.bare.partition(":")
    if not colon or not key or key in seen or re.search(r"[{}\[\]&*!]", key):
        raise Malformed(line.number)
    return key, value.strip()


class Block:
    """Reads lines from the top."""

    def __init__(self, lines: list[Line]):
        self.lines, self.at = lines, 0

    def mapping(self) -> dict[str, Value]:
        out: dict[str, Value] = {}
        while self.at < len(self.lines):
            line = self.lines[self.at]
            self.at += 1
            if line.empty:
                continue
            if line.indent or line.bare in ("-", "...") or line.bare.startswith("- "):
                raise Malformed(line.number)
            key, value = pair(line, out)
            if not value:
                out[key] = self.nested()
            elif value in (">", ">-", ">+"):
                out[key] = self.folded(value[1:])
            else:
                out[key] = scalar(value, line.number)
        return out

    def nested(self) -> Value:
        """What is indented below a key without a value: a list, a mapping, or nothing."""
        first = next((x for x in self.lines[self.at :] if not x.empty), None)
        if first is None or not first.indent:
            return ""
        children = []
        while self.at < len(self.lines) and ((line := self.lines[self.at]).empty or line.indent >= first.indent):
            self.at += 1
            if not line.empty:
                if line.indent > first.indent:
                    raise Malformed(line.number)
                children.append(line)
        if first.bare == "-" or first.text.lstrip().startswith("- "):
            return [self.item(x) for x in children]
        out: dict[str, str] = {}
        for child in children:
            key, value = pair(child, out)
            if not value:
                raise Malformed(child.number)
            out[key] = scalar(value, child.number)
        return out

    def item(self, line: Line) -> str:
        text = line.text.lstrip()
        if not text.startswith("- ") or not text[2:].strip():
            raise Malformed(line.number)
        return scalar(text[2:].strip(), line.number)

    def folded(self, chomp: str) -> str:
        """Lines joined by blanks; empty ones and deeper ones keep their breaks."""
        rest = self.lines[self.at :]
        start = next((i for i, x in enumerate(rest) if x.bare), None)
        if start is None:
            self.at = len(self.lines)
            return ""
        self.at += start
        depth = rest[start].indent
        if not depth:
            return ""
        body: list[tuple[str, bool] | None] = []
        while self.at < len(self.lines) and (not (line := self.lines[self.at]).bare or line.indent >= depth):
            self.at += 1
            body.append((line.text.encode()[depth:].decode("utf-8", "replace").rstrip(), line.indent > depth) if line.bare else None)
        blank = 0
        while body and body[-1] is None:
            body.pop()
            blank += 1
        out, gap, deep = "", 0, False
        for entry in body:
            if entry is None:
                gap += 1
                continue
            text, deeper = entry
            if out:
                kept = deep or deeper
                out += "\n" * (gap + kept) if gap or kept else " "
            out, gap, deep = out + text, 0, deeper
        ending = {"": 1 if out else 0, "-": 0, "+": blank + (1 if out else 0)}[chomp]
        return out + "\n" * ending


def as_row(found: Frontmatter) -> dict:
    fields = []
    for key, value in found.fields.items():
        kind = "scalar" if isinstance(value, str) else "sequence" if isinstance(value, list) else "mapping"
        pairs = [{"key": k, "value": v} for k, v in value.items()] if kind == "mapping" else None
        fields.append({"key": key, "kind": kind, "scalar": value if kind == "scalar" else None, "seq": value if kind == "sequence" else None, "map": pairs})
    return {"status": found.status, "malformed_line": found.line, "fields": fields}


@F.pandas_udf(SCHEMA)
def frontmatter(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The front matter of each text, as a struct of status, malformed_line and fields in order."""
    for part in texts:
        rows = [as_row(parse(t)) for t in part]
        out = pd.DataFrame(rows, columns=["status", "malformed_line", "fields"])
        out["malformed_line"] = out["malformed_line"].astype("Int32")
        yield out


def scalar_field(parsed: str, name: str) -> F.Column:
    """A field's text in a column of frontmatter(); null if there is none or it isn't a scalar."""
    hit = F.filter(F.col(f"{parsed}.fields"), lambda f: (f["key"] == name) & (f["kind"] == "scalar"))
    return F.try_element_at(hit, F.lit(1))["scalar"]
