"""Following a corpus as it grows: new files are indexed and checked as they arrive.

A stream of files (path, content) runs in micro-batches. Postings are appended as Parquet, a folder
for each batch, so a batch that runs again after a failure replaces its own and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import lint
from marginalia.operators.ranking import build_index
from marginalia.plans.config import Config


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of a stream of documents (path, name, description) below path."""

    def write(batch: DataFrame, number: int) -> None:
        build_index(batch).postings.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(docs: DataFrame, path: str):
    """The index that index_stream() wrote; of a path that came twice the later batch counts."""
    from marginalia.operators.ranking import Index

    rows = docs.sparkSession.read.parquet(path)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    postings = rows.join(last, ["path", "batch"], "left_semi").drop("batch")
    return Index(docs, postings, postings.groupBy("path").agg(F.sum("f").alias("len")), True)


def line_findings_stream(files: DataFrame, config: Config, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings about lines and front matter of a stream of files (path, content)."""

    def write(batch: DataFrame, number: int) -> None:
        known = lint.with_policy(batch, config)
        lint.line_findings(known).union(lint.frontmatter_findings(known)).select(*lint.COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
