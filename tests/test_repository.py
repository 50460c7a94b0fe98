import pytest

from marginalia import cli
from marginalia.plans.config import load
from marginalia.sources import repository as repo

FILES = {
    "harbour.md": "---\nname: Harbour Handbook\ndescription: where ships moor\n---\n",
    "docs/tide-tables.md": "---\nname: tide-tables\ndescription: compute the spring tide for a berth\n---\n",
    "docs/pilotage.md": "---\nname: pilotage\ndescription: guide a ship through the narrows\n---\n",
    "docs/beacons.md": "---\nname: Beacon List\ndescription: lamps and racon codes\n---\n",
    "docs/plain.md": "no front matter\n",
    "docs/wrapped.md": "---\ndescription: >+\n  ropes and knots\n\n---\n",
    "docs/exec-plans/active/dredging.md": "---\ndescription: deepen the basin\n---\n",
    "docs/exec-plans/completed/seawall.md": "---\ndescription: mended masonry\n---\n",
    ".agents/skills/knots/SKILL.md": "---\nname: bowline\ndescription: tie a loop\n---\n",
    "vault/ledger.md": "---\ndescription: dues\n---\n",
    ".gitignore": "vault/\n",
    "notes.txt": "x",
}


@pytest.fixture
def root(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".git").mkdir()
    return tmp_path


def run(spark, root, *argv, cwd=None):
    lines = []
    code = cli.run(list(argv), spark, cwd or root, lines.append)
    return code, lines


def test_walk(root):
    config = load(root)
    found, explicit = repo.discover(root, config)
    assert "vault/ledger.md" not in found and ".agents/skills/knots/SKILL.md" in found and explicit == []
    assert "vault/ledger.md" in repo.discover(root, config, respect_gitignore=False)[0]
    assert repo.discover(root, config, ["."], recurse=False)[0] == ["harbour.md"]
    assert repo.discover(root, config, ["vault/ledger.md"])[1] == ["vault/ledger.md"]
    with pytest.raises(repo.SourceError):
        repo.discover(root, config, ["notes.txt"])
    assert repo.infer_root(["docs"], cwd=root) == root
    (root / "docs/.md").write_text("x")
    assert "docs/.md" not in repo.discover(root, config)[0]


def test_ignore_files(root, tmp_path, monkeypatch):
    """.ignore before .gitignore before the exclude file before the global one; .gitignore only up to .git, .ignore beyond."""
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    monkeypatch.setenv("HOME", str(tmp_path))
    inner = root / "inner"
    for path in ("a.md", "b.md", "c.md", "d.md", "e.md"):
        (inner / path).parent.mkdir(exist_ok=True)
        (inner / path).write_text("x")
    (inner / ".git/info").mkdir(parents=True)
    (root / ".ignore").write_text("a.md\n")
    (root / ".gitignore").write_text("b.md\nvault/\n")
    (inner / ".git/info/exclude").write_text("c.md\n")
    (inner / ".gitignore").write_text("!c.md\n")
    (tmp_path / "conf/git").mkdir(parents=True)
    (tmp_path / "conf/git/ignore").write_text("d.md\n")
    assert list(repo.walk(inner)) == [".gitignore", "b.md", "c.md", "e.md"]
    (tmp_path / ".gitconfig").write_text(f"[core]\n\texcludesFile = {tmp_path}/own\n")
    (tmp_path / "own").write_text("e.md\n")
    assert list(repo.walk(inner)) == [".gitignore", "b.md", "c.md", "d.md"]
    assert len(list(repo.walk(inner, respect_gitignore=False))) == 6


def test_format(spark, root):
    repo.register(spark)
    rows = {r.path: r.content for r in spark.read.format("mdrepo").option("path", str(root)).load().collect()}
    assert rows["docs/plain.md"] == "no front matter\n" and "vault/ledger.md" not in rows
    heads = spark.read.format("mdrepo").option("path", str(root)).option("frontmatterOnly", "true").load()
    docs = {r.path: (r["name"], r.description) for r in repo.documents(heads).collect()}
    assert docs["docs/plain.md"] == ("plain", None) and docs["docs/wrapped.md"] == ("wrapped", "ropes and knots")


@pytest.mark.parametrize("text, head", [("---\na: b\n---\nbody\n", "---\na: b\n---\n"), ("x\n---\n", "x"), ("---\na: b\n", "---\na: b\n"), ("---\r\na: b\r\n---", "---\r\na: b\r\n---"), ("---\na\rb\n----\n---\n", "---\na\rb\n----\n---\n"), ("", "")])
def test_head(text, head):
    assert repo._head(text) == head


def test_match(spark, root):
    code, lines = run(spark, root, "match", "compute", "the", "spring", "tide")
    assert code == 0 and lines[0].startswith("docs/tide-tables.md | tide-tables | compute")
    assert run(spark, root, "m", "racon", "-p") == (0, ["docs/beacons.md"])
    assert run(spark, root, "match", "bowline", "--skills", "-p")[1] == [".agents/skills/knots/SKILL.md"]
    assert run(spark, root, "match", "masonry", "--plans", "-p")[1] == ["docs/exec-plans/completed/seawall.md"]
    explained = run(spark, root, "match", "racon", "--explain")[1]
    assert explained[0].startswith("score | relative") and "100% of top | 1/1 terms | docs/beacons.md" in explained[1]
    assert run(spark, root, "match", "nothingatall") == (0, [])
    assert "\x1b[1mracon\x1b[0m" in run(spark, root, "match", "racon", "--color", "always")[1][0]
    with pytest.raises(ValueError):
        run(spark, root, "match", "the")


def test_list(spark, root):
    assert run(spark, root, "list") == (0, ["harbour.md | Harbour Handbook | where ships moor"])
    assert run(spark, root, "list", "docs/plain.md")[1] == ["docs/plain.md | plain | "]
    assert [x.split(" | ")[0] for x in run(spark, root, "ls", "-R", "docs")[1]] == ["docs/beacons.md", "docs/exec-plans/active/dredging.md", "docs/exec-plans/completed/seawall.md", "docs/pilotage.md", "docs/tide-tables.md", "docs/wrapped.md"]
    assert run(spark, root, "list", "--active-plans")[1] == ["docs/exec-plans/active/dredging.md | dredging | deepen the basin"]


def test_scopes_that_are_no_folders(spark, root):
    (root / "marginalia.toml").write_text('plans-dir = "notes.txt"\nskills-dir = "nowhere"\n')
    assert run(spark, root, "list", "--skills") == (0, [])
    for scope in ("--plans", "--active-plans", "--completed-plans"):
        with pytest.raises(repo.SourceError, match="configured plans-dir path .* is not a directory"):
            run(spark, root, "list", scope)


def test_lint_and_fix(spark, root):
    (root / "marginalia.toml").write_text('[[rules]]\npath = "docs/**"\nenable = ["prefer-links-for-local-paths"]\n')
    (root / "docs/plain.md").write_text("see `./beacons.md`\n")
    code, lines = run(spark, root, "lint")
    assert code == 2 and lines[0].startswith("docs/plain.md:1:5  error  prefer-links-for-local-paths  fixable") and "1 fixable finding" in lines[1]
    assert run(spark, root, "lint", "--color", "always")[1][0].startswith("docs/plain.md:1:5  \x1b[31merror\x1b[0m  prefer")
    assert run(spark, root, "fix")[0] == 0
    assert (root / "docs/plain.md").read_text() == "see [./beacons.md](beacons.md)\n"
    assert run(spark, root, "lint") == (0, [])


def test_stats(spark, root):
    (root / "docs/long.md").write_text("x\n" * 120)
    code, lines = run(spark, root, "stats", "docs")
    assert code == 0 and lines[0].split() == ["path", "lines"] and lines[1].split() == ["docs/beacons.md", "4"]
    assert [x.split()[0] for x in run(spark, root, "stats", "-R", ".", "--min-lines", "100")[1]] == ["path", "docs/long.md"]
    assert "docs/exec-plans/active/dredging.md" in " ".join(run(spark, root, "stats", "-R")[1])
    (root / "marginalia.toml").write_text('[[rules]]\npath = "docs/"\nmax-lines = 100\n')
    assert run(spark, root, "stats", "docs", "--min-lines", "100")[1] == ["path          lines  max-lines", "docs/long.md    120        100"]
    with pytest.raises(ValueError):
        run(spark, root, "stats", "--min-tokens", "5")


def test_what_exists_is_looked_up_on_disk(spark, root):
    """Links, empty folders, ignored files and git's own files are targets; anchors come from files outside the targets too."""
    (root / "real").mkdir()
    (root / "real/a.md").write_text("# Here हिन्दी\n")
    (root / "link.md").symlink_to(root / "real/a.md")
    (root / "empty").mkdir()
    (root / ".git/HEAD").write_text("x")
    good = "[a](link.md) [b](empty) [c](.git/HEAD) [d](vault/ledger.md) [e](link.md#here-हिन्दी) [f](notes.txt#x)"
    (root / "docs/refs.md").write_text(good.replace("](", "](../") + "\n\n[g](../link.md#gone) [h](../nowhere/)\n")
    (root / "marginalia.toml").write_text("")
    code, lines = run(spark, root, "lint", "docs/refs.md")
    assert code == 2 and [x for x in lines if "\n" in x] == ["docs/refs.md:3:1  error  unresolved-link-path\nLocal repository link `[g](../link.md#gone)` does not resolve within the repository."]


def test_unreadable_file(spark, root):
    (root / "docs/bad.md").write_bytes(b"no front matter\n\xff\xfe")
    with pytest.raises(Exception, match=r"failed to read docs/bad\.md"):
        run(spark, root, "list", "-R")
