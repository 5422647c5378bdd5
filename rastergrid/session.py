"""Session helpers: the shared work folder and stored intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default filesystem where it names none, so tasks
    that open files themselves mean the same place as Spark does."""
    if ":" in path.split("/")[0]:
        return path
    bare = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bare.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(bare).toString()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the current run folder, or under the shared checkpoint folder.

    The folder is the one ``spark.checkpoint.dir`` names, or the context's own checkpoint folder. On
    a single machine without either it is a fresh temporary folder; on a cluster that is an error,
    since every executor would write to its own disk.
    """
    name = f"rastergrid-{uuid.uuid4().hex}"
    if _runs:
        return f"{_runs[-1]}/{name}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return qualified(spark, f"{base.rstrip('/')}/{name}")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:" + tempfile.mkdtemp(prefix="rastergrid-")


_runs: list[str] = []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what it holds, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables stored inside the block; it is deleted at the end, so results must be
    written or collected before."""
    folder = shared_dir(spark)
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        remove(spark, folder)


def swap_in(spark: SparkSession, draft: str, folder: str) -> None:
    """Put a finished draft folder in the place of ``folder``. Its old content is set aside under a name
    with ``.old`` at the end until the new one is there, and then goes."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (draft, folder))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(source)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.{uuid.uuid4().hex}.old")
    had = system.exists(target) and system.rename(target, aside)
    if not system.rename(source, target):
        if had:
            system.rename(aside, target)
        raise OSError(f"cannot put {draft} in the place of {folder}")
    if had:
        system.delete(aside, True)


def materialize(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None,
                ) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage before a result that several plans use; a lost executor costs nothing that
    was already written.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark) + "/table"
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)
