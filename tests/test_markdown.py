import pytest

from marginalia.functions.markdown import scan, slugs


def kinds(text):
    return [(n["type"], n["value"], n["url"]) for n in scan(text)]


@pytest.mark.parametrize(
    "text, nodes",
    [
        ("see [a](b.md)", [("link", "a", "b.md")]),
        ("see `x/y`", [("code", "x/y", None)]),
        ("`` a`b ``", [("code", "a`b", None)]),
        ("![a](b.md)", []),
        ("```\n[a](b.md)\n```\n[c](d.md)", [("link", "c", "d.md")]),
        ("    [a](b.md)", []),
        ("[a][b]\n\n[b]: c.md", []),
        ("<div>\n[a](b.md)\n</div>", []),
        ("<!-- [a](b.md) -->", []),
        ("[`a`](b.md)", [("link", "a", "b.md")]),
        ('[a](<b c.md> "t")', [("link", "a", "b c.md")]),
        ("[a](b(c).md)", [("link", "a", "b(c).md")]),
        (r"\[a](b.md)", []),
        ("# T `c`\n", [("heading", "T c", None), ("code", "c", None)]),
        ("T *x*\n===", [("heading", "T x", None)]),
        ("---\nname: x\n---\n", [("heading", "name: x", None)]),
        ("> - [a](b.md)", [("link", "a", "b.md")]),
        ("| a | b |\n|---|---|\n| `x` | [y](z.md) |", [("code", "x", None), ("link", "y", "z.md")]),
        ("<https://x.y/z>", []),
        ("a [b\nc](d.md)", [("link", "b\nc", "d.md")]),
        ("- [ ] [a](b.md)", [("link", "a", "b.md")]),
        ("[a] (b.md)", []),
        ("text[^1]\n\n[^1]: see [a](b.md)\n", [("link", "a", "b.md")]),
        ("[^n]: note\n\n    more [a](b.md)\n\n    ```\n    [x](y.md)\n    ```\n\nend `z/`", [("link", "a", "b.md"), ("code", "z/", None)]),
        ("> quoted [a\nb](c.md) on", [("link", "a\nb", "c.md")]),
        ("> text\n---\nmore", []),
        ("> text\n===\n", []),
        ("- item\n---\n", []),
        ("- item\n  ===\n", [("heading", "item", None)]),
        ("> ```\n> [x](y.md)\nafter [a](b.md)", [("link", "a", "b.md")]),
        ("- a\n\n  ```\n  [x](y.md)\n  ```\n  [c](d.md)", [("link", "c", "d.md")]),
        ("- a\n\n      [x](y.md)\n\n  [c](d.md)", [("link", "c", "d.md")]),
        ("- a\n    - b [c](d.md)\n\n      e `f/`", [("link", "c", "d.md"), ("code", "f/", None)]),
        ("1. a\n\n   > [b](c.md)\n\nd\n\n    [x](y.md)", [("link", "b", "c.md")]),
        ("> <div>\n> [x](y.md)\n\n[a](b.md)", [("link", "a", "b.md")]),
        ("tags:\n  - a\n---\n", []),
    ],
)
def test_nodes(text, nodes):
    assert kinds(text) == nodes


def test_byte_offsets():
    text = "Préface `x/` then [é](y.md)\n"
    for n in scan(text):
        part = text.encode()[n["start"] : n["end"]].decode()
        assert part in ("`x/`", "[é](y.md)")
    assert [(n["line"], n["col"]) for n in scan("a\n  `b`")] == [(2, 3)]


def test_slugs():
    assert slugs(["Testing Guidance", "Testing Guidance", "A & B", "café_x-y"]) == ["testing-guidance", "testing-guidance-1", "a--b", "café_x-y"]
