"""File listings as relations; file contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastergrid.functions.scalars import has_extension, size_in_units


def list_files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """``path, length, modificationTime`` of the regular files in a folder."""
    files = (spark.read.format("binaryFile").load(folder)
             .select("path", "length", "modificationTime"))
    return files if extensions is None else files.where(has_extension(F.col("path"), extensions))


def file_sizes(spark: SparkSession, folder: str, power: float) -> DataFrame:
    """File sizes in units of 1024^power."""
    return list_files(spark, folder).select("path", size_in_units(F.col("length"), power).alias("size"))
