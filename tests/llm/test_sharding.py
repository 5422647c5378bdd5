import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.llm import sharding

import edge


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 42])
def test_permutation_and_inverse(n, seed):
    shard, slot = sharding.place_of(np.arange(n), n, 8, seed)
    at = slot * 8 + shard
    assert sorted(at.tolist()) == list(range(n))
    assert sharding.row_at(shard, slot, n, 8, seed).tolist() == list(range(n))


def test_seeds_differ_and_repeat():
    one, two = (sharding.place_of(np.arange(1000), 1000, 8, s)[1].tolist() for s in (1, 2))
    assert one != two and one == sharding.place_of(np.arange(1000), 1000, 8, 1)[1].tolist()
    neighbours = np.abs(np.diff(sharding._walk(np.arange(1000), 1000, 1, False)))
    assert np.median(neighbours) > 100


def test_edge_rows(spark):
    docs = edge.documents(spark)
    rows = [sharding.shard_rows(d, (F.octet_length("text") + 1).cast("long").alias("size"),
                                F.crc32(F.col("text").cast("binary")).alias("crc")).collect()
            for d in (docs, docs.repartition(7))]
    got = rows[0]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))
    assert sorted((str(r.doc_id), r.size, r.crc) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge.ROWS)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    n = len(got)
    for r in got:
        assert sharding.row_at([r.shard], [r.slot], n, 8)[0] == r.row
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.row)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_rows(spark):
    assert sharding.shard_rows(edge.documents(spark).limit(0)).count() == 0


def test_written_shards_hold_the_texts_in_slot_order(spark, tmp_path):
    sharding.write_shards(edge.documents(spark), str(tmp_path / "s"), 4)
    rows = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((i, t or "")) for i, t, *_ in edge.ROWS)
    assert {r.shard for r in rows} == {0, 1, 2, 3}
