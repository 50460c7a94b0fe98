"""Column functions over paths, rows and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a heading's anchor leaves out: all but letters with their marks, numbers, connectors, hyphens and blanks.
NOT_SLUG = r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]"


def repo_relative(path: Column, root: str) -> Column:
    """A path below root with forward slashes; null if it isn't below root."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(prefix)), F.substring(plain, len(prefix) + 1, 1 << 30))


def path_prefix(path: Column) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name less its last extension; a name that begins with its only dot is kept."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def components(path: Column) -> Column:
    """Sorts paths by component, where the plain text sorts by character."""
    return F.split(path, "/")


def trim_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+\z", "")


def row_field(text: Column) -> Column:
    """A field of an output row: no line breaks, bars escaped."""
    return F.replace(F.regexp_replace(text, r"[\r\n]", " "), F.lit("|"), F.lit("\\|"))


def count_lines(text: Column) -> Column:
    """Lines of a text; a final line break begins no line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def decode_fragment(text: Column) -> Column:
    """Percent-decoded UTF-8; the text itself where that fails. A plus sign is no blank."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def normalize(path: Column) -> Column:
    """A relative path without '.' and '..'; null if it climbs above its root or nothing is left."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("inside"))

    def step(state: Column, part: Column) -> Column:
        parts, size = state["parts"], F.size(state["parts"])
        up = F.struct(F.slice(parts, 1, F.greatest(size - 1, F.lit(0))).alias("parts"), (state["inside"] & (size > 0)).alias("inside"))
        down = F.struct(F.array_append(parts, part).alias("parts"), state["inside"].alias("inside"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(down)

    done = F.aggregate(F.split(path, "/"), start, step)
    return F.when(done["inside"] & (F.size(done["parts"]) > 0), F.array_join(done["parts"], "/"))


def shell_escape(text: str) -> str:
    """POSIX quoting for a command to show; plain names stay as they are."""
    import re

    return text if re.fullmatch(r"[A-Za-z0-9./_-]+", text) else "'" + text.replace("'", "'\"'\"'") + "'"


def slug(title: Column) -> Column:
    """A heading's anchor before repeats are numbered: lower case, punctuation gone, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(title), NOT_SLUG, ""), F.lit(" "), F.lit("-"))
