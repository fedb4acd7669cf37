"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import write_once

#: A side of a join of up to so many rows, narrow ones only, is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where that is unset in one local process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a cut in the lineage that outlives executors.

    With a ``path`` from ``shared_folder`` the caller can ``discard`` the table when nothing reads it any more.  What the
    job shuffled is removed when it ends: else it stays until the driver happens to collect garbage.
    """
    path = path or shared_folder(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(docs: DataFrame, stored: bool) -> DataFrame:
    """``docs`` with ``_locator`` (file, row), from a table of files: its own if ``stored``, else one written now.

    ``stored`` says that ``docs`` is what ``spark.read.parquet`` gives, one row for each row of its files.
    """
    if not stored:
        docs = spool(docs, "content")
    place = docs.metadataColumn("_metadata")
    return docs.withColumn("_locator", F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")))


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables of the shared folder that later steps have replaced."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
