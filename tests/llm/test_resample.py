import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.llm import resample

import edge


def brute_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return own, own + [f"{a} {b}" for a, b in zip(own, own[1:])]


def bucket(feature, buckets=10000):
    return zlib.crc32(feature.encode()) % buckets


def brute(rows, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, brute_features(text)[1]))
    for text in target:
        t.update(map(bucket, brute_features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, text, *_ in rows:
        own, features = brute_features(text)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = rank + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_awkward_rows(spark):
    target = [edge.PROSE[0], None, "", "Words_and-more 12ab é日本 " + "y" * 100 + " z"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    rows = [*edge.ROWS, (30, "Words_and-more 12ab é日本 " + "y" * 100 + " z " + "w" * 70 + " " + "w" * 64 + " " + "w" * 65, "en", "a")]
    for least, percent in ((3, 50), (1, 100), (20, 25), (10**6, 25), (2, 0)):
        got = resample.resample(edge.documents(spark, rows), frame, percent=percent, least_words=least)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, target, percent, least), key=key)


def test_whole_table(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resample.resample(docs, target)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, [r.text for r in target.collect()]), key=key)


def test_forgetting_changes_nothing(spark, monkeypatch):
    texts = [t.encode() for t in ("a b c d e", "c d e f g h", "e f a b", "long" * 30 + " a " + "long" * 30)] * 3
    want = [x.tolist() for x in resample.Features(97).of(texts)]
    monkeypatch.setattr(resample, "FLUSH_WORDS", 2)
    features = resample.Features(97)
    parts = [features.of([t]) for t in texts]
    assert [x for p in parts for x in p[0].tolist()] == want[0] and [x for p in parts for x in p[2].tolist()] == want[2]


@pytest.mark.parametrize("n", [1, 2, 50, 1000])
def test_quickselect(spark, n):
    rng = np.random.default_rng(n)
    data = sorted((int(a), int(b)) for a, b in zip(rng.integers(-3, 3, n), rng.permutation(n)))
    frame = spark.createDataFrame(data, "a long, b long").repartition(5)
    for k in {1, n, (n + 1) // 2, max(1, n // 3)}:
        assert resample.kth_key(frame, ["a", "b"], k, pivots=3) == data[k - 1]
    with pytest.raises(ValueError):
        resample.kth_key(frame, ["a", "b"], n + 1, pivots=3)


def test_repeated_rows_fill_the_draw_exactly(spark):
    frame = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score"))
    got = resample.draw(frame, "score", "doc_id", 37)
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 38)) and got.count() == 100


def test_draw_leans_to_the_target(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "one two three four ") * 8, "en", "a") for i in range(400)]
    frame = spark.createDataFrame([(0, "alpha beta gamma delta " * 500)], "item_id long, text string")
    won = resample.resample(edge.documents(spark, rows), frame).where("rank is not null")
    assert won.count() == 100 and won.where("doc_id % 2 = 1").count() > 80


def test_empty(spark):
    docs = edge.documents(spark)
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, none).count() == docs.count()
