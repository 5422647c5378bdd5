"""SimHash near-duplicates: block keys, verified bit distance, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import by_key, fresh, slices, texts_of
from rastergrid.llm.components import components
from rastergrid.session import materialize

BITS = 64
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of one UTF-8 text: a bit is set if over half the hashes set it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = len(words) - shingle + 1
    ends = (starts + sizes)[shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist())),
                         np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        some = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row: words are lower-cased in A-Z and split at ASCII white
    space; texts shorter than a shingle count as one, null and empty texts give 0."""

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    rows = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks(distance: int, blocks: int) -> list[int]:
    """Masks over ``blocks - distance`` of ``blocks`` bit blocks, as signed longs. Two fingerprints
    that differ in at most ``distance`` bits agree under one of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sums]


def _connect(fps: np.ndarray, distance: int, links: list) -> None:
    """Links that connect what is within ``distance``, at most one for each fingerprint: a search
    that never looks again at what it has reached."""
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                hit = rest[near]
                links.append((np.full(len(hit), at), hit))
                todo.extend(hit)
                rest = rest[~near]


def near_links(fps: DataFrame, distance: int = 3, blocks: int = 5, tile: int = 4096) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect exactly what pairs
    within ``distance`` bits connect.

    Close pairs share one of the block keys. The members of a key meet in one group and are verified
    there. A key with more than ``tile`` members is dealt into tiles, and each pair of tiles is a
    group of its own, so a group never has more than about two tiles of rows. A group gives at most
    one link per member, not its pairs.
    """
    masks = _masks(distance, blocks)
    keyed = fps.select(F.posexplode(F.array(*[F.expr(f"fp & {m}L") for m in masks])).alias("c", "v"), "fp")
    busy = materialize(keyed.groupBy("c", "v").count().where(F.col("count") > tile))
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tile).cast("int")
    dealt = (keyed.join(busy, ["c", "v"], "left").withColumn("parts", parts)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("c", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "fp"))

    def verify(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in by_key(batches, ["c", "v", "i", "j"]):
            keys = [table.column(k).to_numpy() for k in ("c", "v", "i", "j")]
            fp = table.column("fp").to_numpy().view(np.uint64)
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance] if len(two) else two
            links = [(fp[two], fp[two + 1])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                _connect(fp[s:s + n], distance, links)
            a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    order = ["c", "v", "i", "j"]
    return (dealt.repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 5,
                    tile: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id, keeper, text_hash``, one row for each row of ``docs``.

    Fingerprints with at most ``distance`` differing bits are linked; ``component_id`` is the least
    doc_id that links reach. Equal fingerprints are one node, whatever their number. ``keeper``
    marks the (doc_id, text) that stands for its component: the least doc_id, then the least hash
    of its text.

    Null texts are empty texts. Rows with a null doc_id are linked too; they come last as keepers,
    and a component of null ids only has a null ``component_id``. Repeated rows stay repeated. An
    empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle))
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = materialize(prints.groupBy("fp").agg(F.min(me).alias("first")))
    found = components(near_links(nodes.select("fp"), distance, blocks, tile))
    found = materialize(found.join(nodes, found["node"] == nodes["fp"]).select("fp", "component", "first"))
    heads = found.groupBy("component").agg(F.min("first").alias("head"))
    linked = found.join(heads, "component").select("fp", "head")
    labels = (nodes.join(linked, "fp", "left")
              .select("fp", F.coalesce("head", "first").alias("head")))
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"), (me == F.col("head")).alias("keeper"), "text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each; all columns stay."""
    digest, key = fresh(docs, "digest"), fresh(docs, "key")
    chosen = near_duplicates(docs, **options).where("keeper").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct()
    hashed = docs.withColumn(digest, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    held = hashed.join(chosen, hashed["doc_id"].cast("long").eqNullSafe(chosen[key])
                       & (hashed[digest] == chosen[digest]), "left_semi")
    return held.dropDuplicates(["doc_id", digest]).drop(digest)
