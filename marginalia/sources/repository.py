"""A folder of Markdown files as a table.

Spark's own file sources skip names that begin with a dot or an underscore, where agents' skills live,
so the paths are listed by a walk that honours ignore files, and the files are read in tasks. The
source is also registered as the format "mdrepo"; its path must be readable by the workers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.functions import text as X
from marginalia.functions.frontmatter import frontmatter, scalar_field
from marginalia.plans.config import CONFIG_NAME, Config, load
from marginalia.runtime import ship
from marginalia.sources.globs import Pattern, compile_patterns, decide, takes

#: Files that one task reads.
CHUNK = 512


class SourceError(ValueError):
    """A target can't be read as what it was asked for."""


def infer_root(targets: list[str | Path] = (), config: str | Path | None = None, cwd: str | Path = ".") -> Path:
    """The folder of an explicit rule file; else the nearest one above all targets with a rule file or .git; else cwd."""
    if config:
        return Path(config).resolve().parent
    found = [Path(cwd, t).resolve() for t in targets] or [Path(cwd).resolve()]
    common = Path(os.path.commonpath(found))
    start = common if common.is_dir() else common.parent
    for folder in (start, *start.parents):
        if (folder / CONFIG_NAME).is_file() or (folder / ".git").is_dir():
            return folder
    return Path(cwd).resolve()


def _patterns(file: Path) -> list[Pattern]:
    return compile_patterns(file.read_text(encoding="utf-8", errors="replace").splitlines()) if file.is_file() else []


def global_ignores() -> list[Pattern]:
    """The patterns of git's global excludes file: core.excludesFile, or else git/ignore in the user's configuration folder."""
    home = Path.home()
    base = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git"
    for settings in (home / ".gitconfig", base / "config"):
        section = ""
        for line in settings.read_text(encoding="utf-8", errors="replace").splitlines() if settings.is_file() else ():
            line = line.strip()
            if line.startswith("["):
                section = line.strip("[]").strip().lower()
            key, _, value = line.partition("=")
            if section == "core" and key.strip().lower() == "excludesfile":
                return _patterns(Path(value.strip().strip('"')).expanduser())
    return _patterns(base / "ignore")


def walk(root: Path, start: Path | None = None, respect_gitignore: bool = True, recurse: bool = True) -> Iterator[str]:
    """Relative paths of the files below start, sorted; hidden ones too, ignored ones not. Links aren't followed.

    Ignore files count from a path's folder upwards, above the root too; of one kind the nearest that says
    anything decides. The kinds in order: .ignore; .gitignore, up to the folder that holds .git; the exclude
    file of that .git; git's global excludes.
    """
    start = start or root
    known: dict[Path, list[Pattern]] = {}
    everywhere = global_ignores() if respect_gitignore else []

    def verdict(file: str, path: Path, is_folder: bool, inside_git: bool) -> bool | None:
        for folder in path.parents:
            where = folder / file
            if where not in known:
                known[where] = _patterns(where)
            found = decide(known[where], path.relative_to(folder).as_posix(), is_folder)
            if found is not None:
                return found
            if inside_git and (folder / ".git").exists():
                return None
        return None

    def ignored(path: Path, is_folder: bool) -> bool:
        for file, inside_git in ((".ignore", False), (".gitignore", True), (".git/info/exclude", True)):
            found = verdict(file, path, is_folder, inside_git)
            if found is not None:
                return found
        return bool(decide(everywhere, path.relative_to(root).as_posix(), is_folder))

    def below(folder: Path) -> Iterator[str]:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = Path(entry.path)
            if entry.is_symlink() or (entry.name == ".git" and entry.is_dir()):
                continue
            if respect_gitignore and ignored(path, entry.is_dir()):
                continue
            if entry.is_file():
                yield path.relative_to(root).as_posix()
            elif recurse and entry.is_dir():
                yield from below(path)

    yield from below(start)


def discover(root: Path, config: Config, targets: list[str | Path] = (), recurse: bool = True, respect_gitignore: bool | None = None) -> tuple[list[str], list[str]]:
    """(Markdown files in scope, those named explicitly), as sorted relative paths.

    A file that is named bypasses every pattern, but must be a .md file.
    """
    respect = config.respect_gitignore if respect_gitignore is None else respect_gitignore
    found, explicit = set(), set()
    for target in [Path(root, t).resolve() for t in targets] or [root]:
        if target.is_file():
            if not is_markdown(target.name):
                raise SourceError(f"{target} is not a Markdown file; only .md files are supported as explicit targets")
            explicit.add(_below(root, target))
        elif target.is_dir():
            listed = walk(root, target, respect, recurse)
            found.update(p for p in listed if is_markdown(p.rpartition("/")[2]) and takes(config.include, p) and not takes(config.exclude, p))
        else:
            raise SourceError(f"{target} doesn't exist")
    by_component = lambda p: p.split("/")
    return sorted(found | explicit, key=by_component), sorted(explicit, key=by_component)


def is_markdown(name: str) -> bool:
    """Whether a file's name has the extension md; one that is only the extension has none."""
    return name.endswith(".md") and name != ".md"


def _below(root: Path, path: Path) -> str:
    try:
        return path.relative_to(root).as_posix()
    except ValueError as outside:
        raise SourceError(f"{path} is not under {root}") from outside


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RepositoryReader(DataSourceReader):
    """Reads the listed files in chunks; content only up to the front matter if that is all that is asked for."""

    def __init__(self, root: str, paths: list[str], head: bool):
        self.root, self.paths, self.head = root, paths, head

    def partitions(self) -> list[InputPartition]:
        return [Files(self.paths[i : i + CHUNK]) for i in range(0, len(self.paths), CHUNK)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for path in partition.paths:
            try:
                content = Path(self.root, path).read_bytes().decode()
                yield path, _head(content) if self.head else content
            except (OSError, UnicodeDecodeError) as bad:
                raise RuntimeError(f"failed to read {path}: {bad}") from bad


def _head(content: str) -> str:
    """A file's front matter: up to the second line of three hyphens; the first line where there is none."""
    end = re.match(r"---\r?\n(?:.*\n)*?---\r?(?:\n|\Z)", content)
    if end:
        return end[0]
    return content if content.startswith(("---\n", "---\r\n")) else content.partition("\n")[0]


class RepositorySource(DataSource):
    """Format "mdrepo": path, content. Options: path, config, respectGitignore, frontmatterOnly, allFiles."""

    @classmethod
    def name(cls) -> str:
        return "mdrepo"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        root = Path(self.options["path"]).resolve()
        config = load(root, self.options.get("config"))
        respect = self.options.get("respectGitignore", "true").lower() == "true"
        paths, _ = discover(root, config, respect_gitignore=respect and config.respect_gitignore)
        return RepositoryReader(str(root), paths, self.options.get("frontmatterOnly", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RepositorySource)


def read_files(spark: SparkSession, root: Path, paths: list[str], frontmatter_only: bool = False) -> DataFrame:
    """(path, content) of the paths below root, read in tasks of CHUNK files."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // CHUNK)))
    return contents(listed, root, frontmatter_only)


def contents(listed: DataFrame, root: Path, frontmatter_only: bool = False) -> DataFrame:
    """(path, content) of listed (path)."""
    ship(listed.sparkSession)
    reader = RepositoryReader(str(root), [], frontmatter_only)

    def read(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame(list(reader.read(Files(list(batch["path"])))), columns=["path", "content"])

    return listed.mapInPandas(read, "path string, content string")


def existing(root: Path) -> Callable[[DataFrame], DataFrame]:
    """What finds the (target, is_folder) that exist on disk among targets (target): ignored files, folders and links count too."""

    def look(targets: DataFrame) -> DataFrame:
        def find(batches):
            import pandas as pd

            for batch in batches:
                found = [(t, os.path.isdir(os.path.join(root, t))) for t in batch["target"] if os.path.exists(os.path.join(root, t))]
                yield pd.DataFrame(found, columns=["target", "is_folder"])

        ship(targets.sparkSession)
        return targets.mapInPandas(find, "target string, is_folder boolean")

    return look


def bodies(root: Path) -> Callable[[DataFrame], DataFrame]:
    """What reads (path, content) of targets (target) below root."""
    return lambda targets: contents(targets.select(F.col("target").alias("path")), root)


def documents(files: DataFrame) -> DataFrame:
    """path, path_prefix, name, description and body of files (path, content).

    The name is a scalar of the front matter, also an empty one; else the file's stem.
    """
    ship(files.sparkSession)
    parsed = files.withColumn("front", frontmatter("content"))
    path = F.col("path")
    return parsed.select("path", X.path_prefix(path).alias("path_prefix"), F.coalesce(X.trim_breaks(scalar_field("front", "name")), X.file_stem(path)).alias("name"), X.trim_breaks(scalar_field("front", "description")).alias("description"), F.col("content").alias("body"))
