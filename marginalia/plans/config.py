"""The rule file: a closed TOML schema, its checks, and the policy that it gives each path.

Rules apply in source order and the last writer wins. As there are few, a path's policy is a set of
column expressions, one for each field, that fold over the rules; no join is needed.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.sources.globs import Pattern, compile_patterns, taken

CONFIG_NAME = "marginalia.toml"
#: Rules that a rule file can turn on, that limits turn on, and that are always on.
ENABLED = ("unresolved-backtick-path", "prefer-links-for-local-paths")
BUDGETS = ("max-tokens", "max-lines")
ALWAYS = ("unresolved-link-path", "frontmatter-field-missing", "frontmatter-malformed", "frontmatter-field-max-chars")
RULES = (*ALWAYS[:1], *ENABLED, *BUDGETS, *ALWAYS[1:])
#: Endings and file names that make a bare name a reference.
EXTENSIONS = frozenset(
    ".md .mdx .txt .rst .adoc .html .css .scss .js .jsx .ts .tsx .json .jsonc .yaml .yml .toml .ini .cfg .conf .sh .bash .zsh .fish .ps1 .py .rb .rs .go .java .kt .swift .c .h .cpp .cc .hpp .cs .csproj .fs .sql .tf .tfvars .proto .xml .xsd .svg .dart .elm .ex .exs .php .pl .lua .r .scala .dockerfile .gradle .make .mk".split()
)
FILENAMES = frozenset("README README.md AGENTS.md LICENSE LICENSE.md Cargo.toml Cargo.lock Makefile Justfile Dockerfile .gitignore .editorconfig".split())
TOP = {"skills-dir", "plans-dir", "include", "exclude", "extend-extensions", "remove-extensions", "extend-special-filenames", "remove-special-filenames", "respect-gitignore", "rules", "match"}
ENTRY = {"path", "exclude", "disable", "enable", "max-tokens", "max-lines", "severity", "reason", "frontmatter"}


class ConfigError(ValueError):
    """The rule file can't be used."""


@dataclass(frozen=True)
class RuleEntry:
    """One entry of the rule file; where it applies, and what it sets."""

    path: list[Pattern]
    exclude: list[Pattern]
    disable: tuple[str, ...] = ()
    enable: tuple[str, ...] = ()
    severity: str = "error"
    max_tokens: int | None = None
    max_lines: int | None = None
    required: tuple[str, ...] = ()
    field_max_chars: dict[str, int] = field(default_factory=dict)

    def applies(self, path: Column) -> Column:
        return taken(self.path, path, parents=True) & ~taken(self.exclude, path, parents=True)


@dataclass(frozen=True)
class Config:
    skills_dir: str
    plans_dir: str
    include: list[Pattern]
    exclude: list[Pattern]
    match_exclude: list[Pattern]
    extensions: frozenset[str]
    filenames: frozenset[str]
    respect_gitignore: bool
    rules: tuple[RuleEntry, ...]

    def in_scope(self, path: Column) -> Column:
        """Included and not excluded; a pattern for a folder doesn't reach what is below it."""
        return taken(self.include, path) & ~taken(self.exclude, path)

    def fields(self) -> list[str]:
        """Front matter fields that have a limit anywhere, by name."""
        return sorted({f for r in self.rules for f in r.field_max_chars})

    def policy(self, path: Column) -> Column:
        """A struct: what applies to a path after all entries."""
        off = F.lit(None).cast("string")
        backtick, links = off, F.lit(False)
        limits: dict[str, tuple[Column, Column]] = {b: (F.lit(None).cast("long"), off) for b in BUDGETS}
        ignored = {a: F.lit(False) for a in ALWAYS}
        required = F.array().cast("array<string>")
        most = {f: F.lit(None).cast("long") for f in self.fields()}
        for r in self.rules:
            here = r.applies(path)
            level = F.lit(r.severity)
            if ENABLED[0] in r.enable or ENABLED[0] in r.disable:
                backtick = F.when(here, level if ENABLED[0] in r.enable else off).otherwise(backtick)
            if ENABLED[1] in r.enable or ENABLED[1] in r.disable:
                links = F.when(here, F.lit(ENABLED[1] in r.enable)).otherwise(links)
            for budget, limit in zip(BUDGETS, (r.max_tokens, r.max_lines), strict=True):
                if limit is not None or budget in r.disable:
                    limits[budget] = (
                        F.when(here, F.lit(limit).cast("long")).otherwise(limits[budget][0]),
                        F.when(here, level if limit is not None else off).otherwise(limits[budget][1]),
                    )
            for rule in set(ALWAYS).intersection(r.disable):
                ignored[rule] = ignored[rule] | here
            if r.required:
                required = F.when(here, F.array(*map(F.lit, r.required))).otherwise(required)
            for name, limit in r.field_max_chars.items():
                most[name] = F.when(here, F.lit(limit).cast("long")).otherwise(most[name])
        chars = F.array(*[F.named_struct(F.lit("field"), F.lit(n), F.lit("max_chars"), c) for n, c in most.items()]) if most else F.array().cast("array<struct<field:string,max_chars:bigint>>")
        return F.struct(
            backtick.alias("backtick_severity"),
            links.alias("prefer_links"),
            limits["max-tokens"][0].alias("max_tokens"),
            limits["max-tokens"][1].alias("max_tokens_severity"),
            limits["max-lines"][0].alias("max_lines"),
            limits["max-lines"][1].alias("max_lines_severity"),
            F.filter(F.array(*[F.when(c, F.lit(a)) for a, c in ignored.items()]), lambda x: x.isNotNull()).alias("ignored"),
            required.alias("required"),
            F.filter(chars, lambda x: x["max_chars"].isNotNull()).alias("field_max_chars"),
        )


def _closed(table: dict[str, Any], known: set[str], where: str) -> None:
    if unknown := sorted(set(table) - known):
        raise ConfigError(f"unknown field `{unknown[0]}` in {where}")


def _kind(value: Any, kind: type, name: str) -> Any:
    if not isinstance(value, kind) or (kind is int and (isinstance(value, bool) or value < 0)):
        raise ConfigError(f"{name} has the wrong type")
    return value


def _names(table: dict[str, Any], name: str) -> list[str]:
    return [_kind(x, str, name) for x in _kind(table.get(name, []), list, name)]


def _patterns(lines: list[str], what: str) -> list[Pattern]:
    try:
        return compile_patterns(lines)
    except ValueError as bad:
        raise ConfigError(f"invalid {what}: {bad}") from bad


def _folder(table: dict[str, Any], name: str, default: str) -> str:
    value = _kind(table.get(name, default), str, name).strip()
    if not value:
        raise ConfigError(f"{name} must not be empty")
    if value.startswith("/"):
        raise ConfigError(f"{name} must be a relative path under the repository root")
    if ".." in value.split("/"):
        raise ConfigError(f"{name} must stay under the repository root")
    return str(PurePosixPath(value))


def _limit(entry: dict[str, Any], name: str) -> int | None:
    if name not in entry:
        return None
    if _kind(entry[name], int, name) == 0:
        raise ConfigError(f"{name} must be greater than zero")
    return entry[name]


def _entry(entry: dict[str, Any]) -> RuleEntry:
    _closed(entry, ENTRY, "a rule")
    if "path" not in entry:
        raise ConfigError("missing field `path` in a rule")
    if not _kind(entry["path"], str, "path").strip():
        raise ConfigError("rule path must not be empty")
    if not _kind(entry.get("reason", "-"), str, "reason").strip():
        raise ConfigError("rule reason must not be empty")
    disable, enable = tuple(_names(entry, "disable")), tuple(_names(entry, "enable"))
    if unknown := [r for r in (*disable, *enable) if r not in RULES]:
        raise ConfigError(f"unsupported rule `{unknown[0]}`")
    if wrong := [r for r in enable if r not in ENABLED]:
        raise ConfigError(f"unsupported rule `{wrong[0]}` in `enable`")
    level = entry.get("severity", "error")
    if level not in ("error", "warn"):
        raise ConfigError(f"unknown severity `{level}`")
    front = _kind(entry.get("frontmatter", {}), dict, "frontmatter")
    _closed(front, {"required", "fields"}, "frontmatter")
    most: dict[str, int] = {}
    for name, limits in _kind(front.get("fields", {}), dict, "fields").items():
        if not name.strip():
            raise ConfigError("frontmatter field name must not be empty")
        _closed(_kind(limits, dict, name), {"max-chars"}, f"field `{name}`")
        if (limit := limits.get("max-chars")) is not None:
            if _kind(limit, int, "max-chars") == 0:
                raise ConfigError(f"frontmatter field `{name}` max-chars must be greater than zero")
            most[name] = limit
    return RuleEntry(
        _patterns([entry["path"]], "rule path pattern"),
        _patterns(_names(entry, "exclude"), "rule path pattern"),
        disable,
        enable,
        "warning" if level == "warn" else "error",
        _limit(entry, "max-tokens"),
        _limit(entry, "max-lines"),
        tuple(_names(front, "required")),
        most,
    )


def parse(text: str) -> Config:
    """A rule file's configuration; raises ConfigError."""
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as bad:
        raise ConfigError(str(bad)) from bad
    _closed(table, TOP, "the rule file")
    matching = _kind(table.get("match", {}), dict, "match")
    _closed(matching, {"exclude"}, "match")
    dotted = lambda name: {x if x.startswith(".") else f".{x}" for x in _names(table, name)}
    return Config(
        _folder(table, "skills-dir", ".agents/skills"),
        _folder(table, "plans-dir", "docs/exec-plans"),
        _patterns(_names(table, "include") or ["*.md"], "include pattern"),
        _patterns(_names(table, "exclude"), "exclude pattern"),
        _patterns(_names(matching, "exclude"), "match exclude pattern"),
        (EXTENSIONS | dotted("extend-extensions")) - dotted("remove-extensions"),
        (FILENAMES | set(_names(table, "extend-special-filenames"))) - set(_names(table, "remove-special-filenames")),
        _kind(table.get("respect-gitignore", True), bool, "respect-gitignore"),
        tuple(_entry(_kind(r, dict, "rules")) for r in _kind(table.get("rules", []), list, "rules")),
    )


def default() -> Config:
    """What applies where there is no rule file; an empty rule file has no rules."""
    return parse(resources.files("marginalia.plans").joinpath("default.toml").read_text())


def load(root: str | Path, explicit: str | Path | None = None) -> Config:
    """The explicit file, else the root's own, else the default; files in deeper folders don't count."""
    path = Path(explicit) if explicit else Path(root) / CONFIG_NAME
    if not explicit and not path.exists():
        return default()
    try:
        return parse(path.read_text(encoding="utf-8"))
    except OSError as bad:
        raise ConfigError(f"failed to read {path}") from bad
