"""Exact top-k by inner product with a three-phase uniform threshold over dimension segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastergrid.llm.common import by_key
from rastergrid.llm.vectors import FINITE, answers, prepare, runs, tiles
from rastergrid.session import materialize

EXACT = float(1 << 53)
STRIPE = 128
LONG = (-(1 << 63), (1 << 63) - 1)


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((table.num_rows, 0), np.int64)
    flat = table.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: floats while every sum stays below 2^53, Python integers beyond."""
    top = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    if top[0] * top[1] * max(1, a.shape[1]) < EXACT:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def _longs(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object:
        scores = np.array([min(max(int(s), LONG[0]), LONG[1]) for s in scores], np.int64)
    return pa.array(scores.astype(np.int64), pa.int64())


def _scores(batches):
    """Partial scores of all tiles, a stripe of queries at a time: ``queries, vectors, first row, scores``."""
    keys = ["qb", "cb", "seg", "whole", "dim"]
    for table in by_key(batches, keys):
        for queries, vectors, _ in runs(table, keys):
            dim = queries.column("dim")[0].as_py()
            left, right = _matrix(queries, "v", dim), _matrix(vectors, "v", dim)
            for at in range(0, len(left), STRIPE):
                yield queries, vectors, at, _products(left[at:at + STRIPE], right)


def _best(keep: int):
    """The ``keep`` largest partial scores of each query in a tile."""

    def run(batches):
        schema = pa.schema([("asked", pa.int64()), ("node", pa.int64()), ("whole", pa.int32()),
                            ("seg", pa.int32()), ("partial", pa.int64())])
        for queries, vectors, at, score in _scores(batches):
            seg, whole = (queries.column(c)[0].as_py() for c in ("seg", "whole"))
            if score.shape[1] <= keep:
                row, col = np.nonzero(np.ones(score.shape, bool))
            else:
                col = (np.argpartition(-score, keep - 1, axis=1) if score.dtype != object
                       else np.argsort(-score, axis=1, kind="stable"))[:, :keep].ravel()
                row = np.repeat(np.arange(len(score)), keep)
            asked, node = (t.column("id").to_numpy() for t in (queries, vectors))
            yield pa.RecordBatch.from_arrays([
                pa.array(asked[at:at + STRIPE][row]), pa.array(node[col]),
                *(pa.array(np.full(len(row), x), pa.int32()) for x in (whole, seg)), _longs(score[row, col])], schema=schema)

    return run


ENTRIES = "qb int, cb int, id long, dim int, seg int, nodes binary, partials binary"


def _entries(segments: int):
    """Of each query and tile one row with all vectors whose partial score reaches a ``segments``-th of the
    query's threshold, and may reach the threshold with what the other segments can add: no more than
    the product of the lengths of both vectors there."""

    def run(batches):
        schema = pa.schema([("qb", pa.int32()), ("cb", pa.int32()), ("id", pa.int64()), ("dim", pa.int32()),
                            ("seg", pa.int32()), ("nodes", pa.binary()), ("partials", pa.binary())])
        for queries, vectors, at, score in _scores(batches):
            own = queries.slice(at, STRIPE)
            least = [None if t is None else (t, -(-t // segments)) for t in own.column("threshold").to_pylist()]
            rest = np.outer(own.column("rest").to_numpy(), vectors.column("rest").to_numpy()) * (1 + 1e-9) + 1
            asked, node = own.column("id").to_pylist(), vectors.column("id").to_numpy()
            rows = []
            for i, bound in enumerate(least):
                kept = np.arange(len(node))
                if bound is not None:
                    kept = np.flatnonzero((score[i] >= bound[1]) & (score[i].astype(float) * (1 + 1e-15) + rest[i] >= bound[0]))
                if len(kept):
                    some = np.asarray(_longs(score[i, kept]))
                    rows.append((asked[i], node[kept].tobytes(), some.tobytes()))
            if rows:
                place = [own.column(c)[0].as_py() for c in ("qb", "cb", "whole", "seg")]
                qb, cb, whole, seg = ([x] * len(rows) for x in place)
                ids, nodes, partials = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    (qb, cb, ids, whole, seg, nodes, partials), schema)], schema=schema)

    return run


def _settle(keep: int, segments: int):
    """Exact scores in a tile of what the segments have sent and may still reach the threshold: of each
    query those that reach its ``keep``-th best there (all of equal score)."""

    def run(batches):
        schema = pa.schema([("asked", pa.int64()), ("node", pa.int64()), ("score", pa.int64())])
        keys = ["qb", "cb", "dim"]
        for table in by_key(batches, keys):
            for queries, vectors, entries in runs(table, keys):
                if not entries.num_rows:
                    continue
                dim = queries.column("dim")[0].as_py()
                left, right = _matrix(queries, "v", dim), _matrix(vectors, "v", dim)
                ids = vectors.column("id").to_numpy()
                order = np.argsort(ids)
                sent = {}
                for asked, nodes, partials in zip(*(entries.column(c).to_pylist() for c in ("id", "nodes", "partials"))):
                    sent.setdefault(asked, []).append((np.frombuffer(nodes, np.int64), np.frombuffer(partials, np.int64)))
                bounds = zip(queries.column("id").to_pylist(), queries.column("threshold").to_pylist())
                for row, (asked, bound) in enumerate(bounds):
                    if asked not in sent:
                        continue
                    nodes, partials = (np.concatenate(x) for x in zip(*sent[asked]))
                    nodes, back, n = np.unique(nodes, return_inverse=True, return_counts=True)
                    if bound is not None:
                        # a segment that has not sent a vector has less than its share of it, or no use for it
                        seen = np.zeros(len(nodes), float)
                        np.add.at(seen, back, partials.astype(float))
                        upper = seen + (segments - n) * float(-(-bound // segments) - 1)
                        nodes = nodes[upper + np.abs(upper) * 1e-12 + 1 >= bound]
                    if not len(nodes):
                        continue
                    at = order[np.searchsorted(ids, nodes, sorter=order)]
                    scores = _pair_products(((left, np.full(len(at), row)), (right, at)))
                    if len(scores) > keep:
                        best = scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep]
                        nodes, scores = nodes[best], scores[best]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(nodes), asked)), pa.array(nodes), pa.array(scores)], schema=schema)

    return run


def _resolve(keep: int):
    """Exact scores of the asked pairs of a tile, from its whole vectors: of each query those that
    reach its ``keep``-th best (all of equal score), since no other pair of the tile can matter."""

    def run(batches):
        schema = pa.schema([("asked", pa.int64()), ("node", pa.int64()), ("score", pa.int64())])
        for table in by_key(batches, ["qb", "cb", "dim"]):
            for queries, vectors, asks in runs(table, ["qb", "cb", "dim"]):
                if not asks.num_rows:
                    continue
                dim, sides = queries.column("dim")[0].as_py(), []
                for rows, column in ((queries, "id"), (vectors, "other")):
                    ids, wanted = rows.column("id").to_numpy(), asks.column(column).to_numpy()
                    order = np.argsort(ids)
                    sides.append((_matrix(rows, "v", dim), order[np.searchsorted(ids, wanted, sorter=order)]))
                scores = _pair_products(sides)
                asked, node = asks.column("id").to_numpy(), asks.column("other").to_numpy()
                order = np.lexsort((-scores, asked))
                first = np.flatnonzero(np.append(True, asked[order][1:] != asked[order][:-1]))
                size = np.diff(np.append(first, len(order)))
                cut = scores[order][first + np.minimum(size, keep) - 1]
                kept = order[scores[order] >= np.repeat(cut, size)]
                yield pa.RecordBatch.from_arrays([pa.array(asked[kept]), pa.array(node[kept]),
                                                  pa.array(scores[kept])], schema=schema)

    return run


def _pair_products(sides, step: int = 1 << 16) -> np.ndarray:
    """Products of chosen rows, some at a time."""
    (a, rows), (b, others) = sides
    top = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    small = top[0] * top[1] * max(1, a.shape[1]) < EXACT
    out = []
    for at in range(0, len(rows), step):
        x, y = a[rows[at:at + step]], b[others[at:at + step]]
        if small:
            out.append(np.einsum("ij,ij->i", x, y))
        else:
            exact = (x.astype(object) * y.astype(object)).sum(axis=1)
            out.append(np.array([min(max(int(s), LONG[0]), LONG[1]) for s in exact], np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def top_scores(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, segments: int = 2,
               q_rows: int = 1024, c_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (ids divisible by ``every``) the ``k`` rows
    with the highest inner product of the vectors ``floor(scale * x)``, ties to the smaller id.

    The dimensions are dealt to ``segments``, each of which only knows its part of every score.
    Phase one gathers the largest partial scores of each segment and the exact scores of these
    candidates; the (k+1)-th of them is a safe threshold. In phase two the threshold goes to every
    segment, which sends the entries that reach its uniform share: a vector below the share in every
    segment is below the threshold. A vector that cannot reach the threshold whatever the other
    segments add stays at home too. Entries travel as one list for each query and block of vectors.
    Phase three drops vectors whose upper bound stays below and computes the remaining scores
    exactly where query and vectors meet.

    Equal vectors are searched once. Vectors that are null or hold a null or non-finite component
    take no part, nor do rows without an id; products beyond the long range count as its ends.
    Vectors of different dimensions never meet; empty vectors score 0 among themselves. Repeated
    rows count once. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v")).where(FINITE)
    whole = rows.select("vec_id", F.expr(f"transform(v, x -> cast(floor({scale} * x) as long))").alias("v"))
    search = prepare(whole, every, k + 1)

    def cut(side: DataFrame, name: str, *more: str) -> DataFrame:
        step = f"cast(ceil(dim / {segments}) as int)"
        part = side.select(F.col(name).alias("id"), F.col("v").alias("full"), "dim", *more,
                           F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("seg"))
        own = part.withColumn("v", F.expr(f"slice(full, seg * {step} + 1, {step})"))
        square = "aggregate({}, 0D, (s, x) -> s + double(x) * double(x))"
        # the length of the other segments' part, rounded up
        rest = f"sqrt(greatest({square.format('full')} * 1.000000001D - {square.format('v')}, 0D))"
        return own.select("id", "seg", "dim", *more, "v", F.expr(rest).alias("rest"))

    def segment_tiles(queries: DataFrame) -> DataFrame:
        left = cut(queries, "asked", "threshold")
        right = cut(search.classes, "node").withColumn("threshold", F.lit(None).cast("long"))
        # a segment's rows are as wide as its slice; ``whole`` keeps apart what differs elsewhere
        both = [x.withColumn("whole", F.col("dim")).withColumn("dim", F.size("v")) for x in (left, right)]
        return tiles(*both, search, q_rows, c_rows, "seg", "whole", "dim")

    def exact(pairs: DataFrame) -> DataFrame:
        left = search.queries.select(F.col("asked").alias("id"), "v", "dim")
        right = search.classes.select(F.col("node").alias("id"), "v", "dim")
        asks = pairs.select(F.col("asked").alias("id"), F.col("node").alias("other"), F.col("whole").alias("dim"))
        other = F.lit(None).cast("long").alias("other")
        return (tiles(left.select("*", other), right.select("*", other), search, q_rows, c_rows, "dim", asks=asks)
                .mapInArrow(_resolve(k + 1), "asked long, node long, score long"))

    local = Window.partitionBy("asked", "seg").orderBy(F.col("partial").desc())
    lists = segment_tiles(search.queries.withColumn("threshold", F.lit(None).cast("long"))).mapInArrow(
        _best(k + 1), "asked long, node long, whole int, seg int, partial long")
    lists = lists.withColumn("nth", F.row_number().over(local)).where(F.col("nth") <= k + 1)
    known = exact(lists.select("asked", "node", "whole").distinct())
    best = Window.partitionBy("asked").orderBy(F.col("score").desc())
    known = known.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k + 1)
    threshold = materialize(known.select("asked", F.col("score").alias("threshold")))
    armed = search.queries.join(threshold, "asked", "left")
    entries = segment_tiles(armed).mapInArrow(_entries(segments), ENTRIES)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("seg", "int"), ("nodes", "binary"), ("partials", "binary"))]
    left = armed.select(F.col("asked").alias("id"), "v", "dim", "threshold", *none)
    right = search.classes.select(F.col("node").alias("id"), "v", "dim", F.lit(None).cast("long").alias("threshold"), *none)
    settled = (tiles(left, right, search, q_rows, c_rows, "dim", placed=entries)
               .mapInArrow(_settle(k + 1, segments), "asked long, node long, score long"))
    return answers(settled, search, k, best_first=True)
