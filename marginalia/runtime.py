"""What a session needs to run this package's Python functions on its workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the Arrow batches that workers get, unless the session says otherwise.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for a session's context; Spark serves the file.

    Batches get one bound in bytes for all plans, so that wide rows fit a worker; a session's own is kept.
    """
    context = spark.sparkContext
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    if getattr(context, "_marginalia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted((*root.rglob("*.py"), *root.rglob("*.toml"))):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._marginalia_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt to all cores if it has fewer splits than there are; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder for working tables: spark.checkpoint.dir, which all executors share.

    Where it is unset, a session in one process gets a temporary folder, any other the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        path = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marginalia"
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a working table in the shared folder and read it again, which cuts its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
