"""Vector tables for the searches: distinct vectors with their least ids, and blocks of both sides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastergrid.session import materialize

FINITE = "v is not null and forall(v, x -> x is not null and abs(x) < double('Infinity'))"


@dataclass(frozen=True)
class Search:
    """``classes``: ``node, v, dim, ids`` with the least ids of each distinct vector; ``queries``:
    ``asked, v, dim``; ``members``: ``query_id, asked``; all stored. And the rows of the first two."""

    classes: DataFrame
    queries: DataFrame
    members: DataFrame
    n_classes: int
    n_queries: int


def prepare(rows: DataFrame, every: int, keep: int) -> Search:
    """Reduce ``vec_id, v`` to distinct vectors. Equal vectors have equal scores, and ties go to the
    smaller id, so the ``keep`` least ids of a vector are all that one answer can need, however many
    rows share it. Repeated rows count once; rows without an id take no part. Queries are the ids
    divisible by ``every``; each distinct query vector is searched once."""
    rows = rows.where("vec_id is not null").groupBy("vec_id", "v").agg(F.lit(1)).select("vec_id", "v")
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    classes = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                          .select(F.monotonically_increasing_id().alias("node"), "v",
                                  F.size("v").alias("dim"), "ids"))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = materialize(asked.select("v").distinct()
                          .select(F.monotonically_increasing_id().alias("asked"), "v", F.size("v").alias("dim")))
    members = materialize(asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "asked"))
    return Search(classes, queries, members, classes.count(), queries.count())


def tiles(queries: DataFrame, classes: DataFrame, search: Search, q_rows: int, c_rows: int,
          *keys: str, asks: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Both sides dealt to a grid of tiles: every block of queries meets every block of vectors once.
    Columns of both: ``id`` and the payload; ``side`` 0 is the query. Sorted by tile and side. Rows
    of ``asks`` (``id`` a query, ``other`` a vector) go to the tile where the two meet, as side 2, and
    so do rows of ``placed``, which name their tile (``qb, cb``)."""
    n_q, n_c = max(1, -(-search.n_queries // q_rows)), max(1, -(-search.n_classes // c_rows))

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qb"),
                          blocks(n_c).alias("cb"), F.lit(0).alias("side"), "*")
    right = classes.select(blocks(n_q).alias("qb"),
                           F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int").alias("cb"),
                           F.lit(1).alias("side"), "*")
    order = ["qb", "cb", *keys]
    both = left.unionByName(right)
    if asks is not None:
        both = both.unionByName(asks.select(
            F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qb"),
            F.pmod(F.xxhash64("other"), F.lit(n_c)).cast("int").alias("cb"), F.lit(2).alias("side"), "*"),
            allowMissingColumns=True)
    if placed is not None:
        both = both.unionByName(placed.withColumn("side", F.lit(2)), allowMissingColumns=True)
    return both.repartition(*order).sortWithinPartitions(*order, "side")


def runs(table: pa.Table, keys: list[str]):
    """The whole tiles of a table, each split into its query, its vector and its asked part."""
    columns = [table.column(k).to_numpy() for k in keys]
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    side = table.column("side").to_numpy()
    for start, end in zip(np.append(0, cuts), np.append(cuts, len(side))):
        middle, last = (start + int(np.searchsorted(side[start:end], s)) for s in (1, 2))
        if start < middle < last:
            yield (table.slice(start, middle - start), table.slice(middle, last - middle),
                   table.slice(last, end - last))


def answers(scored: DataFrame, search: Search, k: int, best_first: bool) -> DataFrame:
    """``query_id, rank, vec_id, score`` from exact scores ``asked, node, score`` of vectors: the
    first ``k + 1`` vectors are expanded to their ids, the query's own id goes, and ``k`` stay."""
    score = F.col("score").desc() if best_first else F.col("score")
    lead = Window.partitionBy("asked").orderBy(score, F.col("ids")[0])
    near = (scored.join(search.classes.select("node", "ids"), "node")
            .withColumn("nth", F.row_number().over(lead)).where(F.col("nth") <= k + 1)
            .select("asked", "score", F.explode("ids").alias("vec_id")))
    top = Window.partitionBy("asked").orderBy(score, "vec_id")
    near = near.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth")
    each = near.join(search.members, "asked").where("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return (each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
