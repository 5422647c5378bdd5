"""A reproducible shuffle of all rows into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import texts_of
from rastergrid.session import materialize

ROUNDS = 6
SEED = 42


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser over half blocks."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed % (1 << 64))
    return [int(k) for k in keys]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """Permute 0..n-1: a Feistel network over the next even power of two, repeated for what leaves
    the range until it comes back into it."""
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def place_of(rows: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers of a table of ``n`` rows."""
    at = _walk(np.asarray(rows), n, seed, back=False)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """Row numbers that stand at these places: the inverse of ``place_of``."""
    return _walk(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def number_rows(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with their global number ``row`` in the order of the given columns, stored, and their
    count. Tasks number their range; the driver adds up one count per range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("part", F.spark_partition_id())
                         .withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = np.zeros(max(counts, default=-1) + 1, np.int64)
    for part, n in counts.items():
        sizes[part] = n
    bases = np.cumsum(sizes) - sizes

    @F.pandas_udf("long")
    def number(part: pd.Series, local: pd.Series) -> pd.Series:
        return pd.Series(bases[part.to_numpy()] + local.to_numpy())

    return stored.withColumn("row", number("part", "local")).drop("part", "local"), int(sizes.sum())


def shard_rows(docs: DataFrame, *digests: Column, shards: int = 8, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``digests`` (columns over ``doc_id, text``), ``row, shard, slot``; one row for each
    row of ``docs``.

    Rows are numbered in the order of doc_id (nulls first) and a hash of the text, and the number is
    permuted; shard and slot are remainder and quotient of the permuted number. So shard sizes differ
    by one row at most, slots have no gap, and both can be computed from the row number alone
    (``place_of``, ``row_at``). Texts never move: only ids and digests are sorted.

    Null texts are empty texts. Repeated rows are equal in every sorted column, so it does not
    matter which of them has which place. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    slim = texts_of(docs).select("doc_id", *digests, F.xxhash64("text").alias("tie"))
    numbered, n = number_rows(slim, "doc_id", "tie")

    @F.pandas_udf("shard int, slot long")
    def place(row: pd.Series) -> pd.DataFrame:
        shard, slot = place_of(row.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return (numbered.withColumn("place", place("row")).drop("tie")
            .select("*", "place.shard", "place.slot").drop("place"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, seed: int = SEED) -> None:
    """The texts themselves, one folder ``shard=<n>`` per shard, in slot order. A shard is written by
    many tasks, each with a range of its slots."""
    rows = shard_rows(docs, F.col("text"), shards=shards, seed=seed)
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(folder))
