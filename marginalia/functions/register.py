"""The library's functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text
from marginalia.functions.analyzer import analyze_path, analyze_text
from marginalia.functions.frontmatter import frontmatter
from marginalia.functions.markdown import heading_anchors, markdown_nodes
from marginalia.functions.porter2 import stem
from marginalia.runtime import ship


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: analyze_text(t or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _path_terms(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: analyze_path(p or ""))


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


#: Functions that Spark has no expression for, by their names in SQL.
PYTHON = {"md_frontmatter": frontmatter, "md_nodes": markdown_nodes, "md_anchors": heading_anchors, "md_terms": _terms, "md_path_terms": _path_terms, "md_stem": _stem}
#: Functions of one text that are expressions, with their result type.
EXPRESSIONS = {
    "md_slug": (text.slug, "STRING"),
    "md_count_lines": (text.count_lines, "BIGINT"),
    "md_path_prefix": (text.path_prefix, "STRING"),
    "md_file_stem": (text.file_stem, "STRING"),
    "md_row_field": (text.row_field, "STRING"),
    "md_decode_fragment": (text.decode_fragment, "STRING"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL in this session; returns their names."""
    ship(spark)
    for name, function in PYTHON.items():
        spark.udf.register(name, function)
    for name, (expression, result) in EXPRESSIONS.items():
        body = spark.range(1).select(F.lit("x").alias("value")).select(expression(F.col("value")).alias("r"))
        sql = body._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS {result} RETURN {sql}")
    return [*PYTHON, *EXPRESSIONS]
