"""The catalogue: documents with a description, in the order of their path's components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.plans.config import Config


def list_documents(docs: DataFrame, explicit: tuple[str, ...] = (), scope: str | None = None, config: Config | None = None, folder: str | None = None, recurse: bool = True) -> DataFrame:
    """path, name and description of documents that have a description, or were asked for by path.

    A scope, or a folder with what is below it or itself only, leaves out the other paths.
    """
    path = F.col("path")
    kept = docs.where(in_scope(path, scope, config)) if scope else docs
    if folder is not None:
        kept = kept.where(F.startswith(path, F.lit(f"{folder}/" if folder else "")) if recurse else shallow(path, folder))
    described = F.col("description").isNotNull()
    kept = kept.where(described | path.isin(*explicit) if explicit else described)
    return kept.orderBy(T.components(path)).select("path", "name", "description")


def shallow(path: Column, folder: str = "") -> Column:
    """Whether a path lies in the folder itself."""
    return T.path_prefix(path) == folder


def in_scope(path: Column, scope: str | None, config: Config) -> Column:
    """Whether a path belongs to a scope: skills, plans, active-plans, completed-plans, or all."""
    under = lambda folder: F.startswith(path, F.lit(f"{folder}/"))
    plans = config.plans_dir
    if scope == "skills":
        return under(config.skills_dir) & (T.base_name(path) == "SKILL.md")
    if scope == "plans":
        return under(plans)
    if scope in ("active-plans", "completed-plans"):
        return under(f"{plans}/{scope.removesuffix('-plans')}")
    if scope is not None:
        raise ValueError(f"unknown scope {scope}")
    return F.lit(True)


def rows(found: DataFrame) -> DataFrame:
    """One column, row: path | name | description, as text."""
    fields = [T.row_field(F.coalesce(c, F.lit(""))) for c in ("path", "name", "description")]
    return found.select(F.concat_ws(" | ", *fields).alias("row"))
