import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rastergrid.llm import simhash
from rastergrid.llm.components import components

import edge


def brute_print(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=3):
    """Label of each fingerprint: the least index reachable."""
    labels, f = list(range(len(prints))), np.array(prints, np.uint64)
    while True:
        new = [min(labels[j] for j in np.flatnonzero(np.bitwise_count(f ^ x) <= distance)) for x in f]
        if new == labels:
            return labels
        labels = new


@pytest.mark.parametrize("text", [r[1] for r in edge.ROWS if r[1] is None or len(r[1]) < 1000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode(), 3) == brute_print(text)


def test_hash_is_spark_hash(spark):
    words = ["", "a", "ab cd ef", "é 日本 x", "y" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_edge_rows(spark):
    got = simhash.near_duplicates(edge.documents(spark)).collect()
    assert len(got) == len(edge.ROWS)
    rows = sorted(((i, t) for i, t, *_ in edge.ROWS), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_print(t) for _, t in rows]
    labels = brute_groups(prints)
    want = sorted(str((i, "%016x" % p, rows[k][0])) for (i, _), p, k in zip(rows, prints, labels))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = {(r.component_id, r.doc_id, r.text_hash) for r in got if r.keeper}
    assert len(kept) == len(set(labels))


def test_small_tiles_and_chains(spark):
    rng = np.random.default_rng(5)
    middle = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = {m ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for m in middle for _ in range(120)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    for tile, blocks in ((16, 5), (4096, 4)):
        links = simhash.near_links(rows, 3, blocks, tile)
        found = {r.node % 2**64: r.component for r in components(links).collect()}
        groups = {}
        for p, k in zip(prints, brute_groups(prints)):
            groups.setdefault(k, set()).add(found.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert simhash.near_links(rows, 3, 5, 16).count() < 30 * len(prints)


def test_links_stay_linear_in_a_hot_group(spark):
    """Thousands of fingerprints within three bits of one: spanning links, not pairs."""
    near = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    rows = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in near], "fp long")
    links = simhash.near_links(rows, 3, 5, 512)
    assert links.count() < 60 * len(near) < len(near) ** 2 / 20
    assert {r.component for r in components(links).collect()} == {-2**63}


def test_long_chain_components(spark):
    edges = spark.range(0, 3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = components(edges).agg(F.min("component"), F.max("component"), F.countDistinct("node")).first()
    assert tuple(got) == (0, 0, 3001)


def test_keep_one_and_empty(spark):
    docs = edge.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    labels = {brute_print(r.text) for r in rows}
    assert len(rows) == len(set(brute_groups(sorted({brute_print(t) for _, t, *_ in edge.ROWS}))))
    assert len(labels) == len(rows)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
