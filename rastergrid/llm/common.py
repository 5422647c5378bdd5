"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, text`` and nothing else, so that further columns of the table cannot clash; a null
    text counts as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python objects exist for few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_runs(batches: Iterable[pa.RecordBatch], rows: int = 1024, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most ``rows`` texts; a run ends with the text that reaches ``most`` bytes, so
    what exists for each token at a time does not grow with the length of the texts."""
    for batch in slices(batches, rows):
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // most)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(start, end - start)


def by_key(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` of sorted integer batches, as tables of whole groups.

    Several groups may come in one table; no group is cut. Only the group that is still open is
    carried over.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            if held:
                change[0] |= column[0] != held[-1].column(k)[-1].as_py()
        cuts = np.flatnonzero(change)
        if held and len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])])
            held = []
            if len(cuts) > 1:
                yield pa.Table.from_batches([batch.slice(cuts[0], cuts[-1] - cuts[0])])
            batch = batch.slice(cuts[-1])
        elif len(cuts):
            yield pa.Table.from_batches([batch.slice(0, cuts[-1])])
            batch = batch.slice(cuts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass        # another C library, which has no such call


def relieved(batches: Iterable[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The batches; memory that is free goes back to the system after every few of them."""
    for i, batch in enumerate(batches):
        if i and i % every == 0:
            release()
        yield batch


def tidy(run):
    """A batch function that gives its memory back to the system when the task ends: workers are kept
    for the next stage, and what they hold would stand against those that work."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return whole


def slice_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The slice, of ``n`` ranges of about equal width, of each 64-bit key."""
    half = np.uint64(32)
    return (((keys >> half) * np.uint64(n)) >> half).astype(np.int64)


def pack_sorted(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys and further columns in little space: steps between keys, and each byte
    position of each column for itself."""
    columns = [np.diff(keys, prepend=np.uint64(0)), *more]
    return zstandard.compress(b"".join(
        np.ascontiguousarray(c).view(np.uint8).reshape(len(keys), -1).T.tobytes() for c in columns), 1)


def unpack_sorted(raw: bytes, size: int, *kinds) -> list[np.ndarray]:
    """The columns of ``pack_sorted``; ``kinds`` are the types of the further ones."""
    flat, at, out = np.frombuffer(zstandard.decompress(raw), np.uint8), 0, []
    for kind in (np.uint64, *kinds):
        end = at + size * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at:end].reshape(-1, size).T).view(kind).ravel())
        at = end
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of many runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
