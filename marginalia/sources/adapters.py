"""Tables as corpora: path, path_prefix, name, description, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table whose texts take time, on all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def corpus(df: DataFrame, path: Column, name: Column, description: Column, body: Column) -> DataFrame:
    out = df.select(path.alias("path"), name.alias("name"), description.alias("description"), body.alias("body"))
    return out.select("path", T.path_prefix(F.col("path")).alias("path_prefix"), F.coalesce("name", T.file_stem(F.col("path"))).alias("name"), T.trim_breaks(F.col("description")).alias("description"), "body")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file in a folder of its source and language, named by its first line."""
    text = F.col("text")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return corpus(wide(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), path, F.substring_index(text, "\n", 1), text, text)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a file at its URL's path, named by its title and described by its text without tags."""
    html = F.col("html")
    path = F.concat(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/+$", ""), F.lit("/page_"), F.col("page_id").cast("string"), F.lit(".md"))
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    return corpus(wide(spark, sf_dir, "pages", "page_id", "url", "html"), path, F.when(title != "", title), F.regexp_replace(html, "<[^>]*>", " "), html)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a file in its brand's folder, named by its name and described by its type."""
    path = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return corpus(table(spark, sf_dir, "part"), path, F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"))
