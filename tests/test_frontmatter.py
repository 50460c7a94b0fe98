import pytest

from marginalia.functions.frontmatter import frontmatter, parse


def fields(block):
    found = parse(f"---\n{block}\n---\nbody")
    assert found.status == "valid", found
    return found.fields


@pytest.mark.parametrize("text", ["", "body", " ---\na: b\n---", "---x\n---", "\ufeff---\na: b\n---", None])
def test_none(text):
    assert parse(text).status == "none"


@pytest.mark.parametrize(
    "text, line",
    [("---", 1), ("---\na: b", 2), ("---\n a: b\n---", 2), ("---\n- x\n---", 2), ("---\n...\n---", 2), ("---\na: 1\na: 2\n---", 3), ("---\n{a}: 1\n---", 2), ("---\na: [1]\n---", 2), ("---\na: |\n---", 2), ("---\na:\n  b:\n---", 3), ("---\na:\n  - x\n    - y\n---", 4), ("---\nnothing\n---", 2), ("---\na:\n  - x\n  -\n---", 4), ("---\n: x\n---", 2)],
)
def test_malformed(text, line):
    found = parse(text)
    assert (found.status, found.line) == ("malformed", line)


def test_values():
    assert fields("a: 1\n# note\n\nb: 'x'\nc: \"y\"\nd: x # kept\ne:\nf:\n  - 1\n  - two\ng:\n  k: v\n  l: 'w'\nh:z") == {"a": "1", "b": "x", "c": "y", "d": "x # kept", "e": "", "f": ["1", "two"], "g": {"k": "v", "l": "w"}, "h": "z"}


@pytest.mark.parametrize(
    "block, value",
    [("d: >\n  text", "text\n"), ("d: >-\n  a\n  b", "a b"), ("d: >+\n  a\n\n\n", "a\n\n\n\n"), ("d: >\n  a\n\n  b", "a\nb\n"), ("d: >-\n  a\n    b\n  c", "a\n  b\nc"), ("d: >", ""), ("d: >-\n  a\ne: f", "a")],
)
def test_folded(block, value):
    assert fields(block)["d"] == value


def test_carriage_returns():
    assert parse("---\r\na: b\r\n---\r\n").fields == {"a": "b"}


def test_column(spark):
    df = spark.createDataFrame([("---\na: b\nc:\n  - d\n---\n",), ("x",), (None,), ("---\n",)], "content string").select(frontmatter("content").alias("f"))
    rows = [r.f for r in df.collect()]
    assert [r.status for r in rows] == ["valid", "none", "none", "malformed"]
    assert [(f.key, f.kind, f.scalar, f.seq) for f in rows[0].fields] == [("a", "scalar", "b", None), ("c", "sequence", None, ["d"])]
