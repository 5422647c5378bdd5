"""Vector best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastergrid.llm.common import relieved, text_runs, texts_of, tidy
from rastergrid.llm.encoding import TextEncoder, read_spec
from rastergrid.session import materialize, shared_dir

END_ID = 0
RANK_BITS = 42


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048


def plan_bins(counts: dict[int, int], capacity: Capacity = Capacity(),
              weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces of each length, as runs of equal treatment.

    Pieces of one length are alike, so bins with equal contents are kept as one group with a
    multiplicity, and the work depends on the number of lengths, not of pieces. Among the groups
    that have room in every dimension, ``rule`` "norm" takes the least weighted norm of what would
    be left, "dot" the largest weighted dot product of piece and room. Columns of the result:
    length, first rank, pieces in a bin, first bin, offset; sorted by length and rank.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    caps = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    scale = np.array(weights, float)
    room = np.empty((0, 3), np.int64)
    number, first = np.empty(0, np.int64), np.empty(0, np.int64)
    opened, runs = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        item = np.array([length, 1, length * length], np.int64)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room >= item).all(axis=1))
            if len(fits):
                spare = room[fits]
                if rule == "norm":
                    score = (scale * ((spare - item) / caps) ** 2).sum(axis=1)
                else:
                    score = -(scale * (item / caps) * (spare / caps)).sum(axis=1)
                at = fits[np.argmin(score)]
                have, start, n = room[at], first[at], number[at]
            else:
                at, have, start, n = None, caps.astype(np.int64), opened, left
            each = min(int((have // item).min()), left)
            bins = min(int(n), left // each)
            runs.append((length, rank, each, start, capacity.tokens - have[0]))
            rank, left = rank + bins * each, left - bins * each
            rest = have - each * item
            if at is None:
                opened += bins
            elif bins < n:
                first[at] += bins
                number[at] -= bins
            else:
                keep = np.arange(len(first)) != at
                room, number, first = room[keep], number[keep], first[keep]
            if rest.min() > 0:
                room = np.vstack([room, rest])
                number, first = np.append(number, bins), np.append(first, start)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokens: int, spec: str) -> DataFrame:
    """``doc_id, piece, start, length, part, rank, ids``: the encoded texts, each with a closing id,
    longer ones cut. ``rank`` counts the pieces of one length in one task (``part``)."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        encoder, part = TextEncoder(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        for batch in relieved(text_runs(batches), 4):
            ids, sizes = encoder.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            sizes = sizes + 1
            doc_start = np.cumsum(sizes) - sizes
            pieces = -(-sizes // tokens)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * tokens
            length = np.minimum(sizes[doc] - start, tokens)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            run_start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            run_size = np.diff(np.append(run_start, len(ordered)))
            rank = np.empty(len(length), np.int64)
            rank[order] = (np.arange(len(ordered)) - np.repeat(run_start, run_size)) + seen[ordered]
            seen[ordered[run_start]] += run_size
            cuts = np.append((doc_start[doc] + start) * 4, len(ids) * 4)
            binary = pa.Array.from_buffers(pa.large_binary(), len(length), [
                None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "part": pa.array(np.full(len(length), part), pa.int32()),
                "rank": pa.array(rank, pa.int64()), "ids": binary})

    return texts_of(docs).mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, part int, rank long, ids binary")


def _place(runs: np.ndarray):
    """Column function from length and rank to sequence and offset."""
    keys = (runs[:, 0] << RANK_BITS) | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), rank.to_numpy()
        run = runs[np.searchsorted(keys, (size << RANK_BITS) | at, "right") - 1]
        ahead = at - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + ahead // run[:, 2],
                             "offset": run[:, 4] + ahead % run[:, 2] * size})

    return place


def pack(docs: DataFrame, *digests: Column, capacity: Capacity = Capacity(),
         weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm",
         tokenizer: str | None = None, store: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, part, rank, sequence_id, offset``, one row for each piece of
    ``docs``; ``part`` and ``rank`` name a stored piece of a length.

    Every document is encoded whole and closed with id 0; only documents longer than a sequence are
    cut. All pieces of the table are packed together: tasks number the pieces of each length, a
    histogram of at most ``capacity.tokens`` lengths goes to the driver, and each piece finds its
    place from its length and its number. The pieces with their ids are stored as Parquet in
    ``store`` (by default in the shared folder); ``digests`` are columns over that table to be
    carried along, and ``sequences`` puts the ids of whole sequences together.

    Null and empty texts are one piece of one token. Repeated rows and null ids are packed like any
    other row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = store or shared_dir(spark) + "/pieces"
    cut = cut_pieces(docs, capacity.tokens, read_spec(tokenizer))
    cut.write.mode("overwrite").option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(cut.schema).parquet(path)
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("length", "part",
                                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    slim = pieces.select("doc_id", "piece", "start", "length", "part", "rank", *digests)
    ranked = slim.join(bases, ["length", "part"])
    placed = ranked.withColumn(
        "place", _place(plan_bins(total, capacity, weights, rule))("length", F.col("base") + F.col("rank")))
    return placed.select(*slim.columns, "place.sequence_id", "place.offset")


def sequences(placed: DataFrame, store: str) -> DataFrame:
    """``sequence_id, ids, lengths``: the little-endian ids of each sequence and the lengths of the
    pieces in it, from ``pack`` and the ``store`` it wrote. Pieces are known by the task that cut
    them and their number there, so null and repeated ids come out as often as they went in."""
    name = ["part", "length", "rank"]
    pieces = placed.sparkSession.read.parquet(store).select(*name, "ids")
    whole = (placed.select(*name, "sequence_id", "offset").join(pieces, name)
             .groupBy("sequence_id")
             .agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("rows")))
    joined = F.aggregate("rows", F.lit(b""), lambda all_, r: F.concat(all_, r["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.col("rows.length").alias("lengths"))
