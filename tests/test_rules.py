import pytest
from pyspark.sql import functions as F

from marginalia.plans.config import ConfigError, default, load, parse
from marginalia.sources.globs import compile_patterns, taken, takes


@pytest.mark.parametrize(
    "patterns, path, itself, parents",
    [
        (["*.md"], "a/b.md", True, True),
        (["docs"], "docs/a.md", False, True),
        (["docs/"], "docs/a.md", False, True),
        (["docs/"], "docs", False, False),
        (["docs/references"], "docs/references/x/y.md", False, True),
        (["/a.md"], "a.md", True, True),
        (["/a.md"], "x/a.md", False, False),
        (["a/*.md"], "a/b/c.md", False, False),
        (["a/**/c.md"], "a/c.md", True, True),
        (["a/**/c.md"], "a/b/b/c.md", True, True),
        (["a/**"], "a/b/c.md", True, True),
        (["**/c.md"], "c.md", True, True),
        (["*.md", "!b.md"], "a/b.md", False, False),
        (["a", "!a/b.md"], "a/b.md", False, False),
        (["[ab].md"], "b.md", True, True),
        (["[!ab].md"], "b.md", False, False),
        (["a?.md"], "ab.md", True, True),
        (["\\#a.md"], "#a.md", True, True),
        (["#a.md"], "#a.md", False, False),
        (["x.{md,txt}"], "x.txt", True, True),
    ],
)
def test_patterns(spark, patterns, path, itself, parents):
    compiled = compile_patterns(patterns)
    assert (takes(compiled, path), takes(compiled, path, parents=True)) == (itself, parents)
    row = spark.createDataFrame([(path,)], "p string").select(taken(compiled, F.col("p")), taken(compiled, F.col("p"), parents=True)).first()
    assert tuple(row) == (itself, parents)


def policy(spark, text, path):
    return spark.createDataFrame([(path,)], "p string").select(parse(text).policy(F.col("p")).alias("x")).first().x


def entry(path="*.md", **kw):
    lines = [f'path = "{path}"'] + [f"{k.replace('_', '-')} = {v}" for k, v in kw.items()]
    return "[[rules]]\n" + "\n".join(lines) + "\n"


def test_last_entry_wins(spark):
    text = entry(max_lines=1) + entry(max_lines=1000, severity='"warn"')
    got = policy(spark, text, "a.md")
    assert (got.max_lines, got.max_lines_severity) == (1000, "warning")


def test_inside_an_entry_limits_come_after_disable(spark):
    assert policy(spark, entry(disable='["max-tokens"]', max_tokens=5), "a.md").max_tokens == 5
    assert policy(spark, entry(max_tokens=5) + entry(disable='["max-tokens"]'), "a.md").max_tokens is None


def test_opt_in_rules_come_back_and_others_do_not(spark):
    opt = '["unresolved-backtick-path"]'
    got = policy(spark, entry(disable=opt) + entry(enable=opt, severity='"warn"') + entry(disable='["unresolved-link-path"]'), "a.md")
    assert got.backtick_severity == "warning" and got.ignored == ["unresolved-link-path"]


def test_frontmatter_replaces_and_merges(spark):
    text = entry() + '[rules.frontmatter]\nrequired = ["a"]\n[rules.frontmatter.fields.x]\nmax-chars = 1\n' + entry("docs") + '[rules.frontmatter]\nrequired = ["b"]\n[rules.frontmatter.fields.y]\nmax-chars = 2\n'
    got = policy(spark, text, "docs/a.md")
    assert got.required == ["b"] and [(f.field, f.max_chars) for f in got.field_max_chars] == [("x", 1), ("y", 2)]
    assert policy(spark, text, "a.md").required == ["a"]


@pytest.mark.parametrize(
    "text",
    [
        "nope = 1", entry("  "), entry(reason='" "'), entry(max_lines=0), entry(max_tokens=0), entry(enable='["max-lines"]'), entry(disable='["nope"]'), entry(severity='"bad"'), 'skills-dir = "/x"', 'plans-dir = "a/../b"', 'skills-dir = ""', "[[rules]]\nmax-lines = 1", entry("[a"),
        entry() + '[rules.frontmatter.fields." "]\nmax-chars = 1', entry() + "[rules.frontmatter.fields.a]\nmax-chars = 0", entry(other=1), "[match]\nother = 1", "not toml", entry(max_lines='"1"'),
    ],
)
def test_errors(text):
    with pytest.raises(ConfigError):
        parse(text)


def test_default_and_files(spark, tmp_path):
    got = policy_of_default = spark.createDataFrame([("AGENTS.md",), ("x/SKILL.md",), ("d.md",)], "p string").select(default().policy(F.col("p")).alias("x")).collect()
    assert (got[0].x.max_lines, got[0].x.max_tokens, got[0].x.required) == (100, 1000, [])
    assert (got[1].x.max_lines, got[1].x.required) == (500, ["name", "description"])
    assert policy_of_default[2].x.required == ["description"]
    (tmp_path / "marginalia.toml").write_text("")
    assert load(tmp_path).rules == ()
    assert parse('extend-extensions = ["foo"]\nremove-extensions = [".md"]').extensions >= {".foo"}
    assert ".md" not in parse('remove-extensions = ["md"]').extensions
