"""Commands over a folder: match, list, lint, fix and stats. Exit status 2 means violations or an error."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia import render
from marginalia.functions.tokens import O200K, TokenCounter, count_tokens
from marginalia.operators import fix as fixing
from marginalia.operators import lint as linting
from marginalia.operators import listing, ranking
from marginalia.operators import sizes as sizing
from marginalia.plans.config import Config, load
from marginalia.sources import repository as repo
from marginalia.sources.globs import takes


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="marginalia")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, alias: str | None = None) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, aliases=[alias] if alias else [])
        sub.set_defaults(command=name)
        sub.add_argument("--config")
        sub.add_argument("--no-gitignore", action="store_true")
        return sub

    match = command("match", "m")
    match.add_argument("query", nargs="+")
    match.add_argument("-n", "--limit", type=int, default=ranking.LIMIT)
    match.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    form = match.add_mutually_exclusive_group()
    form.add_argument("-p", "--path-only", action="store_true")
    form.add_argument("--explain", action="store_true")
    scope = match.add_mutually_exclusive_group()
    for name in ("skills", "plans"):
        scope.add_argument(f"--{name}", dest="scope", action="store_const", const=name)
    listed = command("list", "ls")
    listed.add_argument("targets", nargs="*")
    listed.add_argument("-R", "--recurse", action="store_true")
    scope = listed.add_mutually_exclusive_group()
    for name in ("skills", "plans", "active-plans", "completed-plans"):
        scope.add_argument(f"--{name}", dest="scope", action="store_const", const=name)
    for name in ("lint", "fix", "stats"):
        sub = command(name)
        sub.add_argument("targets", nargs="*", default=["."])
        if name == "stats":
            sub.add_argument("-R", "--recurse", action="store_true")
            sub.add_argument("--min-lines", type=int)
            sub.add_argument("--min-tokens", type=int)
        else:
            sub.add_argument("--color", choices=("auto", "always", "never"), default="auto")
        sub.add_argument("--vocabulary", help="file in the tiktoken format by which token budgets are checked")
        sub.add_argument("--pattern", default=O200K, help="pattern by which the vocabulary splits texts; that of o200k_base if not given")
    return out


def scoped(root: Path, config: Config, scope: str, respect: bool) -> list[str]:
    """Markdown files of a scope; none if its folder is missing."""
    field, base = ("skills-dir", config.skills_dir) if scope == "skills" else ("plans-dir", config.plans_dir)
    part = base + {"active-plans": "/active", "completed-plans": "/completed"}.get(scope, "")
    for folder in (root / base, root / part):
        if folder.exists() and not folder.is_dir():
            raise repo.SourceError(f"configured {field} path {folder} is not a directory")
    if not (root / part).exists():
        return []
    found, _ = repo.discover(root, config, [part], respect_gitignore=respect)
    return [p for p in found if scope != "skills" or p.rpartition("/")[2] == "SKILL.md"]


def coloured(args) -> bool:
    return args.color == "always" or (args.color == "auto" and sys.stdout.isatty())


def run(argv: list[str] | None = None, spark: SparkSession | None = None, cwd: str | Path = ".", out=print) -> int:
    args = parser().parse_args(argv)
    if args.command == "list" and args.scope and args.targets:
        parser().error("a scope and targets exclude each other")
    if args.command == "match":
        ranking.query_terms(" ".join(args.query))  # before anything is read
    spark = spark or SparkSession.builder.appName("marginalia").getOrCreate()
    targets = [str(Path(cwd, t).resolve()) for t in getattr(args, "targets", [])]
    root = repo.infer_root(targets, args.config, cwd)
    config = load(root, args.config)
    respect = config.respect_gitignore and not args.no_gitignore
    return {"match": _match, "list": _list, "lint": _lint, "fix": _lint, "stats": _stats}[args.command](args, spark, root, config, respect, targets, cwd, out)


def _match(args, spark, root, config, respect, targets, cwd, out) -> int:
    query = " ".join(args.query)
    if args.scope:
        paths = scoped(root, config, args.scope, respect)
    else:
        paths = [p for p in repo.discover(root, config, respect_gitignore=respect)[0] if not takes(config.match_exclude, p)]
    docs = repo.documents(repo.read_files(spark, root, paths, frontmatter_only=True)).persist()
    found = ranking.explain(ranking.build_index(docs), query, args.limit).join(docs.select("path", "name", "description"), "path").orderBy(*ranking.ordering())
    if args.explain:
        out(render.EXPLAIN_HEADER)
    for r in render.match_rows(found, query, coloured(args), args.explain, args.path_only).collect():
        out(r.line)
    return 0


def _list(args, spark, root, config, respect, targets, cwd, out) -> int:
    explicit: list[str] = []
    if args.scope:
        paths = scoped(root, config, args.scope, respect)
    else:
        paths, explicit = repo.discover(root, config, targets or [str(Path(cwd).resolve())], args.recurse, respect)
    docs = repo.documents(repo.read_files(spark, root, paths, frontmatter_only=True))
    for r in listing.list_documents(docs, tuple(explicit)).collect():
        out(render.row(r.path, r["name"], r.description))
    return 0


def _lint(args, spark, root, config, respect, targets, cwd, out) -> int:
    paths, _ = repo.discover(root, config, targets, respect_gitignore=respect)
    files = repo.read_files(spark, root, paths).persist()
    counter = TokenCounter(args.vocabulary, args.pattern) if args.vocabulary else None
    found = linting.findings(files, repo.existing(root), config, count_tokens(counter) if counter else None, repo.bodies(root)).persist()
    for r in render.diagnostics(linting.ordered(found), coloured(args)).collect():
        out(r.text)
    if budgets := linting.token_budgets(files, config):
        out(render.token_note(budgets, counter.name if counter else None))
    fix = args.command == "fix"
    status = linting.status(found, fixing=fix).first()
    if fix:
        fixing.write_back(fixing.rewrites(files, found), root)
    elif hint := render.fix_hint(status.fixable, status.rules, args.targets):
        out(hint)
    return 2 if status.failed else 0


def _stats(args, spark, root, config, respect, targets, cwd, out) -> int:
    paths, _ = repo.discover(root, config, targets, args.recurse, respect)
    counter = TokenCounter(args.vocabulary, args.pattern) if args.vocabulary else None
    if args.min_tokens is not None and counter is None:
        raise ValueError("--min-tokens needs --vocabulary")
    found = sizing.sizes(repo.read_files(spark, root, paths), config, count_tokens(counter) if counter else None, args.min_lines, args.min_tokens)
    for line in render.size_table(found.collect()):
        out(line)
    return 0


def main() -> None:
    try:
        sys.exit(run())
    except (ValueError, RuntimeError, OSError) as bad:
        print(bad, file=sys.stderr)
        sys.exit(2)


if __name__ == "__main__":
    main()
