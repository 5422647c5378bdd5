"""From raw documents to packed training sequences, in four stages.

Each stage takes the rows its predecessor kept, as a stored table. The first three return the columns
of ``documents``; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rastergrid
from rastergrid.llm import langid, packing, secrets, simhash
from rastergrid.session import materialize

# Tasks get the code by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(rastergrid)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with letters and a language that explains the text better than equally likely pieces do; all
    rows where none has a language to learn from."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: three-word shingles, three bits."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by the kind of secret."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, as pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, F.crc32("ids").alias("ids_crc32"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("best_fit_packing", best_fit_packing)]

#: SQL has neither the language model nor the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
