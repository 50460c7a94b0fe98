"""A scanner for the parts of GitHub-flavoured Markdown that rules look at.

It finds headings, inline links and code spans, with UTF-8 byte offsets, in document order. Links are
not looked into; neither are images, code blocks, HTML and definitions. It knows fences, indented
code, HTML blocks, quotes, lists, ATX and setext headings, tables, escapes, code spans, autolinks and
images, and footnotes. Front matter is body text here: its lines and the closing hyphens are a setext
heading, if they are one paragraph.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import NOT_SLUG

_NODE = T.StructType().add("seq", "integer").add("type", "string").add("value", "string").add("url", "string").add("line", "integer").add("col", "integer").add("start", "integer").add("end", "integer")
SCHEMA = T.ArrayType(_NODE)
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r" {0,3}#{1,6}(?=[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)[^\]]+\]:[ \t]*\S")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|/?[A-Za-z][A-Za-z0-9-]*(?=[\s/>]|$))")
_HTML_END = ((re.compile(r" {0,3}<!--"), "-->"), (re.compile(r" {0,3}<\?"), "?>"), (re.compile(r"(?i) {0,3}<(?:script|pre|style|textarea)\b"), re.compile(r"(?i)</(?:script|pre|style|textarea)>")))
_TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--.*?--|\?.*?\?)>", re.DOTALL)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>")
_TITLE = re.compile(r"""\s+(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))""", re.DOTALL)
_EMPHASIS = re.compile(r"(?<!\\)(\*\*\*|\*\*|\*|~~|(?<![A-Za-z0-9])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![A-Za-z0-9]))")


@dataclass
class Node:
    """A heading, link or code span; start and end are offsets in characters until they are placed."""

    type: str
    value: str
    url: str | None
    start: int
    end: int


class Inline:
    """Scans the text of one block; places[i] is the source offset of its character i."""

    def __init__(self, text: str, places: list[int]):
        self.text, self.places = text, places

    def nodes(self) -> list[Node]:
        out: list[Node] = []
        self.scan(0, len(self.text), out)
        return out

    def node(self, kind: str, value: str, url: str | None, start: int, end: int) -> Node:
        return Node(kind, value, url, self.places[start], self.places[end - 1] + 1)

    def code_end(self, at: int, stop: int) -> tuple[int, int] | None:
        """(where the content begins, where the span ends) of a code span at a backtick run."""
        run = re.compile("`+").match(self.text, at)
        for close in re.compile("`+").finditer(self.text, run.end(), stop):
            if len(close[0]) == len(run[0]):
                return run.end(), close.end()
        return None

    def code_value(self, start: int, end: int) -> str:
        value = self.text[start:end].replace("\n", " ")
        return value[1:-1] if len(value) > 1 and value[0] == value[-1] == " " and value.strip(" ") else value

    def scan(self, at: int, stop: int, out: list[Node]) -> None:
        text = self.text
        while at < stop:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                if span := self.code_end(at, stop):
                    ticks = span[0] - at
                    out.append(self.node("code", self.code_value(span[0], span[1] - ticks), None, at, span[1]))
                    at = span[1]
                else:
                    at = re.compile("`+").match(text, at).end()
            elif c == "<" and (m := _AUTOLINK.match(text, at, stop) or _TAG.match(text, at, stop)):
                at = m.end()
            elif c == "!" and text[at + 1 : at + 2] == "[" and (link := self.link(at + 1, stop)):
                at = link[3]
            elif c == "[" and (link := self.link(at, stop)):
                label, label_end, url, end = link
                if any(n.type == "link" for n in self.inner(label, label_end)):
                    at += 1  # a link holds no link: the inner one counts
                else:
                    out.append(self.node("link", plain(text[label:label_end]), url, at, end))
                    at = end
            else:
                at += 1

    def inner(self, start: int, stop: int) -> list[Node]:
        out: list[Node] = []
        self.scan(start, stop, out)
        return out

    def link(self, at: int, stop: int) -> tuple[int, int, str, int] | None:
        """(label start, label end, destination, end) of an inline link at a bracket."""
        text, depth, i = self.text, 0, at
        while i < stop:
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "`" and (span := self.code_end(i, stop)):
                i = span[1] - 1
            elif c == "<" and (m := _AUTOLINK.match(text, i, stop) or _TAG.match(text, i, stop)):
                i = m.end() - 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    break
            i += 1
        if i >= stop or text[i + 1 : i + 2] != "(":
            return None
        j = re.compile(r"\s*").match(text, i + 2, stop).end()
        if text[j : j + 1] == "<":
            m = re.compile(r"<((?:\\.|[^<>\n\\])*)>").match(text, j, stop)
            if not m:
                return None
            url, j = m[1], m.end()
        else:
            begin, depth = j, 0
            while j < stop and not text[j].isspace() and ord(text[j]) > 31:
                if text[j] == "\\":
                    j += 1
                elif text[j] == "(":
                    depth += 1
                elif text[j] == ")":
                    if not depth:
                        break
                    depth -= 1
                j += 1
            url = text[begin:j]
        if m := _TITLE.match(text, j, stop):
            j = m.end()
        j = re.compile(r"\s*").match(text, j, stop).end()
        if j >= stop or text[j] != ")":
            return None
        return at + 1, i, re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url), j + 1


def plain(text: str) -> str:
    """Text and code of a label or heading, less markup."""
    inline = Inline(text, list(range(len(text))))
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] and not text[at + 1].isalnum():
            out.append(text[at + 1])
            at += 2
        elif c == "`" and (span := inline.code_end(at, len(text))):
            out.append(inline.code_value(span[0], span[1] - (span[0] - at)))
            at = span[1]
        elif c == "!" and text[at + 1 : at + 2] == "[" and (link := inline.link(at + 1, len(text))):
            at = link[3]
        elif c == "[" and (link := inline.link(at, len(text))):
            out.append(plain(text[link[0] : link[1]]))
            at = link[3]
        elif c == "<" and (m := _TAG.match(text, at)):
            at = m.end()
        elif m := _EMPHASIS.match(text, at):
            at = m.end()
        else:
            out.append(c)
            at += 1
    return "".join(out)


@dataclass
class Place:
    """Where a line's text lies: how many quotes it is in, its indent behind them, and whether an item begins; at is the text's start."""

    quotes: int
    indent: int
    item: bool
    at: int


class Blocks:
    """Splits a source into blocks of text and collects their nodes.

    Containers are tracked by two numbers: the quote markers of a line, and the column at which the text of
    the innermost list item or footnote stands. A paragraph goes on in a line that lacks its containers;
    fences and HTML end with theirs.
    """

    def __init__(self, source: str):
        self.source, self.nodes = source, []
        self.lines: list[tuple[int, str]] = []
        at = 0
        for line in source.split("\n"):
            self.lines.append((at, line.removesuffix("\r")))
            at += len(line) + 1
        self.open: list[tuple[int, str]] = []
        self.depth = 0  # column of the item's text, 0 outside lists and footnotes
        self.within = (0, 0)  # quotes and depth of the open paragraph

    def run(self) -> list[Node]:
        fence: tuple[str, int, int] | None = None  # marker, quotes, depth
        html: tuple[str | re.Pattern, int] | None = None  # what ends it, quotes
        blank = True
        for offset, line in self.lines:
            if fence:
                marker, quotes, depth = fence
                have, indent, at = self.inside(line, quotes)
                text = line[at + min(indent, depth) :]
                if have == quotes and (indent >= depth or not text.strip()):
                    if re.fullmatch(rf" {{0,3}}{marker[0]}{{{len(marker)},}}[ \t]*", text):
                        fence = None
                    continue
                fence = None
            place = self.unwrap(line, blank)
            text = line[place.at :]
            if html:
                end, quotes = html
                if place.quotes >= quotes:
                    if (end == "" and not text.strip()) or (isinstance(end, str) and end and end in text) or (isinstance(end, re.Pattern) and end.search(text)):
                        html = None
                    continue
                html = None
            if not text.strip() and not place.item:
                self.close()
                blank = True
                continue
            lazy = bool(self.open) and not place.item and (place.quotes < self.within[0] or place.indent < self.within[1])
            if self.open and (place.item or place.quotes > self.within[0]):
                self.close()
            if m := _FENCE.match(text):
                self.close()
                fence = m[1], place.quotes, self.depth
            elif not self.open and re.match(r" {4}|\t", text):
                pass  # indented code
            elif m := _ATX.match(text):
                self.close()
                title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", text[m.end() :]).strip()
                begin = text.find(title, m.end()) if title else m.end()
                self.block([(offset + place.at + begin, title)], True)
            elif self.open and not lazy and _SETEXT.fullmatch(text):
                self.close(heading=True)
            elif _RULE.fullmatch(text):
                self.close()
            elif not self.open and _DEFINITION.match(text):
                pass
            elif not self.open and _HTML.match(text):
                end = next((e for start, e in _HTML_END if start.match(text)), "")
                done = end and (end in text if isinstance(end, str) else end.search(text))
                html = None if done else (end, place.quotes)
            elif text.strip():
                if not self.open:
                    self.within = place.quotes, self.depth
                lead = len(text) - len(text.lstrip())
                self.open.append((offset + place.at + lead, text.strip()))
            blank = False
        self.close()
        return self.nodes

    def inside(self, line: str, quotes: int) -> tuple[int, int, int]:
        """(quote markers found, up to quotes; blanks behind them; where these begin)."""
        at = have = 0
        while have < quotes and (m := _QUOTE.match(line, at)):
            at, have = m.end(), have + 1
        rest = line[at:]
        return have, len(rest) - len(rest.lstrip(" ")), at

    def unwrap(self, line: str, blank: bool) -> Place:
        """Where the text behind quote, list and footnote markers begins; depth follows. blank: after an empty line."""
        quotes, indent, at = self.inside(line, len(line))
        base, item = at, False
        if line[at:].strip() and not indent and blank:
            self.depth = 0
        at += min(indent, self.depth)
        while True:
            if m := _FOOTNOTE.match(line, at):
                at, item = m.end(), True
                self.depth = 4
            elif not _RULE.fullmatch(line[at:]) and (m := _ITEM.match(line, at)) and (m[0].strip() or item):
                at, item = m.end(), True
                self.depth = at - base
                if m := re.compile(r"\[[ xX]\] ").match(line, at):
                    at = m.end()
            elif item and (m := _QUOTE.match(line, at)):
                at, quotes = m.end(), quotes + 1
            else:
                return Place(quotes, indent, item, at)

    def close(self, heading: bool = False) -> None:
        if self.open:
            self.block(self.open, heading)
            self.open = []

    def block(self, parts: list[tuple[int, str]], heading: bool) -> None:
        text = "\n".join(t for _, t in parts)
        places: list[int] = []
        for n, (offset, part) in enumerate(parts):
            if n:
                places.append(places[-1] + 1 if places else offset)
            places += range(offset, offset + len(part))
        if heading:
            self.nodes.append(Node("heading", plain(text), None, parts[0][0], parts[-1][0] + len(parts[-1][1])))
        if text:
            self.nodes += Inline(text, places).nodes()


def scan(source: str | None) -> list[dict]:
    """The nodes of a source, in order, with UTF-8 byte offsets, lines and byte columns from 1."""
    source = source or ""
    starts = [0]
    for i, c in enumerate(source):
        if c == "\n":
            starts.append(i + 1)
    ascii_only = source.isascii()
    place = (lambda i: i) if ascii_only else (lambda i: len(source[:i].encode()))
    out = []
    for n, node in enumerate(Blocks(source).run()):
        line = bisect_right(starts, node.start)
        begin = starts[line - 1]
        column = node.start - begin if ascii_only else len(source[begin : node.start].encode())
        out.append({"seq": n, "type": node.type, "value": node.value, "url": node.url, "line": line, "col": column + 1, "start": place(node.start), "end": place(node.end)})
    return out


_NOT_SLUG = regex.compile(NOT_SLUG)


def slugs(titles: list[str]) -> list[str]:
    """Anchors of headings in order; one that is taken gets the next free number."""
    taken: dict[str, int] = {}
    out = []
    for title in titles:
        base = _NOT_SLUG.sub("", title.lower()).replace(" ", "-")
        name = base
        while name in taken:
            taken[base] += 1
            name = f"{base}-{taken[base]}"
        taken[name] = 0
        out.append(name)
    return out


@F.pandas_udf(SCHEMA)
def markdown_nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The nodes of each text, see scan()."""
    for part in texts:
        yield part.map(scan)


@F.pandas_udf(T.ArrayType(T.StringType()))
def heading_anchors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The anchors of each text's headings."""
    for part in texts:
        yield part.map(lambda t: slugs([n["value"] for n in scan(t) if n["type"] == "heading"]))
