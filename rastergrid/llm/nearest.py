"""Nearest neighbours by a block matrix join over int8 codes, with exact recomputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastergrid.llm.common import by_key
from rastergrid.llm.vectors import FINITE, answers, prepare, runs, tiles

EXACT_DIMS = 1024  # 1024 products of 127 * 127 stay below 2^24, so float32 sums them exactly
STRIPE = 128
SLACK = 1e-7
CODE = "id long, dim int, code binary, scale double, error double, norm double"


def _quantise(batches):
    """int8 codes, one scale per vector, and the length of what the code leaves out."""
    for batch in batches:
        out = {name: [] for name in ("code", "scale", "error", "norm")}
        for v in batch.column("v"):
            x = v.values.to_numpy(zero_copy_only=False).astype(float)
            scale = np.abs(x).max() / 127
            q = np.clip(np.rint(x / scale), -127, 127)
            out["code"].append(q.astype(np.int8).tobytes())
            out["scale"].append(scale)
            out["error"].append(float(np.sqrt(((x - scale * q) ** 2).sum())))
            out["norm"].append(float((q * q).sum()))
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "dim": batch.column("dim"), "code": pa.array(out["code"], pa.binary()),
            **{k: pa.array(out[k], pa.float64()) for k in ("scale", "error", "norm")}})


def _codes(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)


def _survivors(keep: int):
    """For each query of a tile, the vectors whose least possible distance does not exceed the
    ``keep``-th least of the largest possible distances."""

    def run(batches):
        schema = pa.schema([("asked", pa.int64()), ("node", pa.int64()), ("lower", pa.float64()),
                            ("upper", pa.float64())])
        for table in by_key(batches, ["qb", "cb", "dim"]):
            for queries, vectors, _ in runs(table, ["qb", "cb", "dim"]):
                dim = queries.column("dim")[0].as_py()
                left, right = _codes(queries, dim), _codes(vectors, dim).T
                ids = [t.column("id").to_numpy() for t in (queries, vectors)]
                scale, error, norm = ([t.column(c).to_numpy() for t in (queries, vectors)]
                                      for c in ("scale", "error", "norm"))
                long = [s * s * n for s, n in zip(scale, norm)]
                for at in range(0, len(left), STRIPE):
                    some = slice(at, at + STRIPE)
                    dot = np.zeros((len(left[some]), right.shape[1]))
                    for d in range(0, dim, EXACT_DIMS):
                        dot += left[some, d:d + EXACT_DIMS] @ right[d:d + EXACT_DIMS]
                    about = long[0][some, None] + long[1] - 2 * scale[0][some, None] * scale[1] * dot
                    about = np.sqrt(np.maximum(about, 0))
                    off = (error[0][some, None] + error[1]
                           + SLACK * (np.sqrt(long[0])[some, None] + np.sqrt(long[1])))
                    lower, upper = about - off, about + off
                    cut = (np.partition(upper, keep - 1, axis=1)[:, keep - 1:keep]
                           if upper.shape[1] > keep else np.full((len(upper), 1), np.inf))
                    row, col = np.nonzero(~(lower > cut))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[0][some][row]), pa.array(ids[1][col]), pa.array(lower[row, col]),
                        pa.array(upper[row, col])], schema=schema)

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, q_rows: int = 1024,
            c_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each query (ids divisible by
    ``every``) among all other rows, by Euclidean distance in double precision, ties to the smaller id.

    Equal vectors are searched once. Tiles multiply int8 codes exactly; what the codes leave out
    bounds the error of each distance, so a tile drops only pairs that cannot be among the nearest.
    The ``k + 1``-th least upper bound over all tiles cuts the rest, the surviving pairs are
    recomputed from the original vectors, and the first ``k`` are merged per query. Bounds are safe,
    so the result is exact.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    rows without an id. Vectors of different dimensions never meet. Repeated rows count once. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"))
    search = prepare(rows.where(f"{FINITE} and exists(v, x -> x <> 0)"), every, k + 1)
    queries = search.queries.select(F.col("asked").alias("id"), "dim", "v").mapInArrow(_quantise, CODE)
    classes = search.classes.select(F.col("node").alias("id"), "dim", "v").mapInArrow(_quantise, CODE)
    pairs = (tiles(queries, classes, search, q_rows, c_rows, "dim")
             .mapInArrow(_survivors(k + 1), "asked long, node long, lower double, upper double"))
    by_upper = Window.partitionBy("asked").orderBy("upper")
    first = pairs.withColumn("nth", F.row_number().over(by_upper)).where(F.col("nth") <= k + 1)
    cut = first.groupBy("asked").agg(F.max("upper").alias("cut"))
    left = pairs.join(cut, "asked").where("not lower > cut").select("asked", "node")
    gap = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), double(0), (s, x) -> s + x)"
    scored = (left.join(search.queries.select("asked", F.col("v").alias("a")), "asked")
              .join(search.classes.select("node", F.col("v").alias("b")), "node")
              .select("asked", "node", F.sqrt(F.expr(gap)).alias("score")))
    return answers(scored, search, k, best_first=False)
