import pytest

from marginalia.operators import fix, lint
from marginalia.operators.references import link_to
from marginalia.plans.config import parse

BACKTICKS = '[[rules]]\npath = "*.md"\nenable = ["unresolved-backtick-path"]\n'
LINKS = '[[rules]]\npath = "docs/"\nenable = ["prefer-links-for-local-paths"]\n'


def found(spark, files, rules="", others=(), count=None):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    paths = spark.createDataFrame([(p,) for p in (*files, *others)], "path string")
    return df, lint.findings(df, paths, parse(rules), count)


OTHERS = ("docs/b.md", "real.md", "dir/x.txt", "openapi.yaml", "docs/read me.md")


def rules_of(spark, texts, rules=""):
    """What is found in each text, as files of one folder."""
    files = {f"docs/case{i}.md": t for i, t in enumerate(texts)}
    _, out = found(spark, files, rules, OTHERS)
    got = {f: [] for f in files}
    for r in lint.ordered(out).collect():
        got[r.file].append((r.rule, r.line, r.column))
    return list(got.values())


def test_links(spark):
    cases = [
        ("[x](b.md)", False), ("[x](missing.md)", True), ("[x](/real.md)", False), ("[x](../real.md)", False), ("[x](../../up.md)", False), ("[x](guide)", False), ("[x](https://a/b.md)", False), ("[x](mailto:a@b)", False), ("[x](ftp://h/x)", True),
        ("[x](tel:1)", False), ("[x](missing/)", False), ("[x](../dir/)", False), ("[x](../dir)", False), ("[x](#nope)", True), ("# Here\n[x](#here)", False), ("[x](../openapi.yaml#/components)", False), ("[x](../dir#a)", True), ("[x](docs/**/*.md)", True),
        ("[x](<read me.md>)", False), ("[r]\n\n[r]: missing.md", False), ("![i](missing.md)", False), ("`missing.md`", False), ("# Café\n[x](#caf%C3%A9)", False), ("---\na: b\n---\n[x](#a-b)", False),
    ]
    got = rules_of(spark, [t for t, _ in cases])
    assert [(t, bool(g)) for (t, _), g in zip(cases, got, strict=True)] == cases


def test_backticks(spark):
    cases = [("`missing.md`", True), ("`real.md`", False), ("`./b.md`", False), ("`./missing.md`", True), ("`docs/b.md`", False), ("`docs/**/*.md`", False), ("`a b.md`", False), ("`missing/`", False), ("`README`", True), ("`x.y`", False), ("`/real.md`", False), ("[`missing.md`](b.md)", False), ("`a//b.md`", False)]
    got = rules_of(spark, [t for t, _ in cases], BACKTICKS)
    assert [(t, g == [("unresolved-backtick-path", 1, 1)]) for (t, _), g in zip(cases, got, strict=True)] == cases


def test_frontmatter_and_budgets(spark):
    rules = '[[rules]]\npath = "*.md"\nmax-lines = 2\nseverity = "warn"\n[rules.frontmatter]\nrequired = ["name", "description"]\n[rules.frontmatter.fields.name]\nmax-chars = 4\n'
    df, out = found(spark, {"a.md": "---\nname: >\n  text\n---\n", "b.md": "---\nname: x\n", "c.md": "x\n", "d.md": "---\nname:\ndescription: x\n---"}, rules)
    got = {}
    for r in lint.ordered(out).collect():
        got.setdefault(r.file, []).append((r.rule, r.severity, r.message))
    assert [x[0] for x in got["a.md"]] == ["max-lines", "frontmatter-field-missing", "frontmatter-field-max-chars"]
    assert "has 5 characters" in got["a.md"][2][2] and got["a.md"][0][1] == "warning"
    assert [x[0] for x in got["b.md"]] == ["frontmatter-malformed"] and "(line 2)" in got["b.md"][0][2]
    assert [x[2] for x in got["c.md"]] == ["Required frontmatter field `name` is missing.", "Required frontmatter field `description` is missing."]
    assert [x[0] for x in got["d.md"]] == ["max-lines"]
    status = lint.status(out).first()
    assert (status.failed, status.fixable, status.rules) == (True, 0, [])


def test_always_on_rules_can_be_switched_off(spark):
    assert rules_of(spark, ["[x](missing.md)"], '[[rules]]\npath = "docs"\ndisable = ["unresolved-link-path"]\n') == [[]]


def test_fix_and_lint_again(spark):
    files = {"docs/guide.md": "Préface `./real.md` and `docs/` and `/docs/real.md`, not `gone.md`.\n", "docs/real.md": "x", "top.md": "`docs/real.md`"}
    df, out = found(spark, files, LINKS)
    new = {r.path: r.content for r in fix.rewrites(df, out).collect()}
    assert new == {"docs/guide.md": "Préface [./real.md](real.md) and [docs/](./) and [/docs/real.md](/docs/real.md), not `gone.md`.\n"}
    assert tuple(fix.summary(out).first()) == (3, ["prefer-links-for-local-paths"])
    assert lint.status(out, fixing=True).first().failed is False
    _, again = found(spark, {**files, **new}, LINKS)
    assert again.collect() == []


def test_edits():
    assert fix.apply("aéb", [(0, 1, "x"), (1, 3, "yy")]) == "xyyb"
    with pytest.raises(fix.OverlapError):
        fix.apply("abcd", [(0, 3, ""), (2, 4, "")])


@pytest.mark.parametrize("args, out", [(("docs/a.md", "docs/b.md", False, False), "b.md"), (("docs/a.md", "b.md", False, False), "../b.md"), (("a.md", "docs", False, True), "docs/"), (("docs/x/a.md", "docs", True, True), "/docs/")])
def test_link_to(args, out):
    assert link_to(*args) == out
