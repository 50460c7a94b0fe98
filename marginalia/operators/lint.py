"""Path rules over a corpus of Markdown files: a finding for each violation, and edits that mend some.

Inputs are tables: files (path, content), and what exists, folders and other kinds of file too, since a
reference may point to any of them: a table of all paths, or a function that looks up the targets asked
for. A file's policy is a struct of column expressions. Files are parsed once for their front matter and
once for their references; what is found in a row is an array of findings. References meet the existing
paths, and links with an anchor the headings of their target, by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as X
from marginalia.functions.frontmatter import frontmatter
from marginalia.functions.markdown import heading_anchors, markdown_nodes
from marginalia.operators import references as R
from marginalia.plans.config import Config
from marginalia.runtime import ship

#: Findings: where, how grave, which rule, what; edits say what to replace.
COLUMNS = ("file", "line", "column", "severity", "rule", "message", "fixable")
EDIT = "struct<start:int,end:int,replacement:string>"


def existing_paths(paths: DataFrame) -> DataFrame:
    """(path, is_folder) of all paths (path) of files, and the folders above them."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    files = paths.select("path", F.lit(False).alias("is_folder"))
    return files.union(paths.select(F.explode(above).alias("path"), F.lit(True).alias("is_folder"))).distinct()


def _found(severity: Column, rule: str, group: int, message: Column, order: Column | None = None, line: Column | None = None, column: Column | None = None, edit: Column | None = None) -> Column:
    """A finding as a struct; those with an edit can be mended."""
    one = F.lit(1)
    return F.struct(
        F.coalesce(line if line is not None else one, one).cast("int").alias("line"),
        F.coalesce(column if column is not None else one, one).cast("int").alias("column"),
        severity.alias("severity"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
        F.lit(edit is not None).alias("fixable"),
        F.struct(F.lit(group).alias("group"), (order if order is not None else F.lit("")).cast("string").alias("order")).alias("seq"),
        (edit if edit is not None else F.lit(None).cast(EDIT)).alias("edit"),
    )


def _rows(df: DataFrame, found: Column) -> DataFrame:
    """A row for each finding of the array found that the policy doesn't ignore."""
    kept = F.filter(found, lambda x: ~F.array_contains("policy.ignored", x["rule"]))
    return df.select(F.col("path").alias("file"), F.explode(kept).alias("x")).select("file", *(F.col(f"x.{c}") for c in (*COLUMNS[1:], "seq", "edit")))


def _none() -> Column:
    return F.array().cast(f"array<struct<line:int,column:int,severity:string,rule:string,message:string,fixable:boolean,seq:struct<group:int,order:string>,edit:{EDIT}>>")


def _when(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(_none())


def with_policy(files: DataFrame, config: Config) -> DataFrame:
    ship(files.sparkSession)
    return files.withColumn("policy", config.policy(F.col("path")))


def token_findings(files: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    df = files.where("policy.max_tokens is not null").withColumn("n", count(F.col("content"))).where("n > policy.max_tokens")
    text = F.format_string("File has %d tokens, which exceeds configured max-tokens = %d.", "n", "policy.max_tokens")
    return _rows(df, F.array(_found(F.col("policy.max_tokens_severity"), "max-tokens", 0, text)))


def token_budgets(files: DataFrame, config: Config) -> int:
    """How many of the files have a token budget."""
    return with_policy(files, config).where("policy.max_tokens is not null").count()


def line_findings(files: DataFrame) -> DataFrame:
    df = files.where("policy.max_lines is not null").withColumn("n", X.count_lines(F.col("content"))).where("n > policy.max_lines")
    text = F.format_string("File has %d lines, which exceeds configured max-lines = %d.", "n", "policy.max_lines")
    return _rows(df, F.array(_found(F.col("policy.max_lines_severity"), "max-lines", 1, text)))


def frontmatter_findings(files: DataFrame) -> DataFrame:
    """Malformed blocks, which hide the other two; required fields that are missing; scalars that are too long."""
    error = F.lit("error")
    df = files.where("size(policy.required) > 0 or size(policy.field_max_chars) > 0").withColumn("front", frontmatter("content"))
    broken = F.format_string("Frontmatter block is malformed or uses unsupported YAML constructs (line %d).", "front.malformed_line")
    malformed = F.col("front.status") == "malformed"
    keys = F.transform("front.fields", lambda f: f["key"])
    gone = F.filter("policy.required", lambda r: ~F.array_contains(keys, r))
    missing = F.transform(gone, lambda r, n: _found(error, "frontmatter-field-missing", 3, F.format_string("Required frontmatter field `%s` is missing.", r), F.lpad(n.cast("string"), 6, "0")))

    def size_of(limit: Column) -> Column:
        hit = F.filter("front.fields", lambda f: (f["key"] == limit["field"]) & (f["kind"] == "scalar"))
        return F.length(F.try_element_at(hit, F.lit(1))["scalar"])

    message = "Frontmatter field `%s` has %d characters, which exceeds configured max-chars = %d."
    over = F.filter("policy.field_max_chars", lambda m: F.coalesce(size_of(m) > m["max_chars"], F.lit(False)))
    long = F.transform(over, lambda m: _found(error, "frontmatter-field-max-chars", 4, F.format_string(message, m["field"], size_of(m), m["max_chars"]), m["field"]))
    found = F.when(malformed, F.array(_found(error, "frontmatter-malformed", 2, broken))).otherwise(F.concat(missing, long))
    return _rows(df, found)


def reference_candidates(files: DataFrame, config: Config) -> DataFrame:
    """A row for each link and code span that is a local reference inside the root, with its target."""
    nodes = files.select("path", "policy", F.inline(markdown_nodes("content"))).where("type in ('link', 'code')")
    link = F.col("type") == "link"
    nodes = nodes.withColumn("is_link", link).withColumn("ref", F.trim(F.when(link, F.col("url")).otherwise(F.col("value"))))
    ref, is_link = F.col("ref"), F.col("is_link")
    found = nodes.where(R.is_candidate(ref, is_link, config.extensions, config.filenames))
    return found.select(
        "*", R.target(F.col("path"), ref, is_link).alias("target"), R.anchor(ref, is_link).alias("anchor"), R.is_folder_like(ref, is_link).alias("folder_like"), R.syntax(R.path_text(ref, is_link)).alias("syntax")
    ).where("target is not null")


@F.pandas_udf(T.StringType())
def _destinations(file: pd.Series, target: pd.Series, from_root: pd.Series, is_folder: pd.Series) -> pd.Series:
    return pd.Series([R.link_to(*row) for row in zip(file, target, from_root, is_folder, strict=True)])


#: A table of all paths, or what finds the (target, is_folder) that exist among targets (target).
Existing = DataFrame | Callable[[DataFrame], DataFrame]


def reference_findings(files: DataFrame, existing: Existing, config: Config, bodies: Existing | None = None) -> DataFrame:
    """Links and code spans whose target or anchor is missing, and code spans that should be links.

    bodies: (path, content) of all Markdown files that links may point to, or what reads those among
    targets; files where not given.
    """
    # any spelling of a target's case counts as its own path; folders answer for links without an anchor
    refs = reference_candidates(files, config)
    paths = existing(refs.select("target").distinct()) if callable(existing) else existing_paths(existing).select(F.col("path").alias("target"), "is_folder")
    refs = refs.join(paths, "target", "left")
    asks = F.col("is_link") & (F.col("is_folder") == F.lit(False)) & F.col("anchor").isNotNull() & R.is_markdown(F.col("target"))
    if callable(bodies):
        bodies = bodies(refs.where(asks).select("target").distinct())
    anchors = (bodies if bodies is not None else files).select(F.col("path").alias("target"), F.explode(heading_anchors("content")).alias("anchor")).distinct()
    refs = refs.withColumn("asks", F.coalesce(asks, F.lit(False))).join(anchors.withColumn("asks", F.lit(True)).withColumn("answered", F.lit(True)), ["target", "anchor", "asks"], "left")

    is_link, found, folder = F.col("is_link"), F.col("is_folder").isNotNull(), F.coalesce("is_folder", F.lit(False))
    absent = ~found & ~F.col("folder_like")
    spot = {"order": F.lpad(F.col("seq").cast("string"), 8, "0"), "line": F.col("line"), "column": F.col("col")}
    lost = _found(F.col("policy.backtick_severity"), "unresolved-backtick-path", 5, F.format_string("Local repository path `%s` does not resolve within the repository.", "ref"), **spot)
    edit = F.struct("start", "end", F.format_string("[%s](%s)", "ref", _destinations("path", "target", F.col("syntax") == "root", folder)).alias("replacement")).cast(EDIT)
    unlinked = _found(F.lit("error"), "prefer-links-for-local-paths", 5, F.format_string("Local repository path `%s` should use Markdown link syntax.", "ref"), edit=edit, **spot)
    dead = _found(F.lit("error"), "unresolved-link-path", 5, F.format_string("Local repository link `[%s](%s)` does not resolve within the repository.", "value", "ref"), **spot)
    bad = absent | (folder & F.col("anchor").isNotNull()) | (F.col("asks") & F.col("answered").isNull())
    out = F.concat(
        _when(~is_link & absent & F.col("policy.backtick_severity").isNotNull(), lost),
        _when(~is_link & found & F.col("policy.prefer_links"), unlinked),
        _when(is_link & bad, dead),
    )
    return _rows(refs, out)


def findings(files: DataFrame, existing: Existing, config: Config, count: Callable[[Column], Column] | None = None, bodies: Existing | None = None) -> DataFrame:
    """All findings with seq and edit; without a token counter token budgets aren't looked at."""
    known = with_policy(files, config)
    out = line_findings(known).union(frontmatter_findings(known)).union(reference_findings(known, existing, config, bodies))
    return out.union(token_findings(known, count)) if count else out


def ordered(found: DataFrame) -> DataFrame:
    """Findings in output order: files by path component, then as they were met."""
    return found.orderBy(X.components(F.col("file")), "seq.group", "seq.order", "rule").select(*COLUMNS)


def status(found: DataFrame, fixing: bool = False) -> DataFrame:
    """One row: errors, warnings, fixable, rules (of fixable findings), failed. Mended findings don't fail a fix."""
    counts = F.col("severity") == "error"
    return found.agg(
        F.count_if(counts).alias("errors"),
        F.count_if(~counts).alias("warnings"),
        F.count_if("fixable").alias("fixable"),
        F.array_sort(F.collect_set(F.when(F.col("fixable"), F.col("rule")))).alias("rules"),
        F.coalesce(F.bool_or(counts & ~F.col("fixable") if fixing else counts), F.lit(False)).alias("failed"),
    )
