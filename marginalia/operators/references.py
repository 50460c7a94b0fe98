"""Local references: which texts are one, what they point to, and how a link to it is written."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: What a text in backticks may not hold to be a path.
_NOT_CODE = r"//|\.\.\.|[\p{Z}\s\x0B*?\[{:()<>\"']"


def is_external(value: Column) -> Column:
    return value.rlike("^(?:http://|https://|mailto:)")


def path_text(value: Column, link: Column) -> Column:
    """What stands before the first # of a link; all of a text in backticks."""
    return F.when(link, F.substring_index(value, "#", 1)).otherwise(value)


def anchor(value: Column, link: Column) -> Column:
    """What stands after the first # of a link, decoded; null if nothing does."""
    raw = F.regexp_extract(value, "^[^#]*#((?s:.+))$", 1)
    return F.when(link & (raw != ""), T.decode_fragment(raw))


def syntax(path: Column) -> Column:
    return F.when(path.rlike(r"^\.{1,2}/"), "relative").when(F.startswith(path, F.lit("/")), "root").otherwise("standard")


def is_candidate(value: Column, link: Column, extensions: frozenset[str], filenames: frozenset[str]) -> Column:
    """Whether a link's target or a text in backticks is a local reference."""
    path = path_text(value, link)
    ending = F.regexp_extract(T.base_name(path), r".(\.[^.]*)$", 1)
    shaped = F.when(link, path.rlike(r"[/\\]")).otherwise(path.rlike(r"[/\\]$"))
    known = ending.isin(*sorted(extensions)) | path.isin(*sorted(filenames))
    fits = (syntax(path) != "standard") | shaped | (link & value.rlike("(?s)#.")) | known
    return (value != "") & ~is_external(value) & (link | ~value.rlike(_NOT_CODE)) & fits


def target(file: Column, value: Column, link: Column) -> Column:
    """The path that a candidate in a file points to; null where it climbs above the root.

    A link counts from the file's folder unless it begins at the root; a text in backticks counts
    from the root unless it begins with a dot. An anchor alone means the file itself.
    """
    path = path_text(value, link)
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    kind = syntax(path)
    local = F.when(link, kind != "root").otherwise(kind == "relative")
    joined = F.when(local & (T.path_prefix(file) != ""), F.concat(T.path_prefix(file), F.lit("/"), plain)).otherwise(plain)
    return F.when(link & (path == ""), file).otherwise(T.normalize(joined))


def is_folder_like(value: Column, link: Column) -> Column:
    return path_text(value, link).rlike(r"[/\\]$")


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)(?:[^/]+\.(?:md|markdown|mdown)|readme)$")


def link_to(file: str, target_path: str, from_root: bool, is_folder: bool) -> str:
    """The destination of a link from a file to a path, from the root or from the file's folder."""
    if from_root:
        return f"/{target_path}" + "/" * is_folder
    return posixpath.relpath("/" + target_path, posixpath.dirname("/" + file)) + "/" * is_folder
