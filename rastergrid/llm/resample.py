"""Importance resampling towards a target: hashed features, array-scored weights, distributed quickselect."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import slices, tidy
from rastergrid.llm.encoding import _Index
from rastergrid.llm.sharding import number_rows
from rastergrid.session import materialize

BUCKETS = 10_000
FLUSH_WORDS = 300_000
PIVOTS = 31
SHORT = 64      # words of up to so many bytes are appended to a checksum by table
POLYNOMIAL = 0xEDB88320
#: A-Z lower-cased; all other ASCII but 0-9 and a-z becomes a space.
LETTERS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _zero_bytes() -> np.ndarray:
    """``[n, k, b]``: what byte ``k`` with value ``b`` of a CRC-32 becomes when ``n`` zero bytes follow;
    a checksum is linear in its bytes."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(1, SHORT + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


class Features:
    """Buckets of the words and word pairs of texts. The CRC-32 of a pair follows from those of its
    two words, so strings are hashed once for each distinct word of a task."""

    def __init__(self, buckets: int):
        self.buckets, self.shift = np.uint32(buckets), _zero_bytes().reshape(-1)
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.crc, self.spaced, self.size = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _learn(self) -> None:
        new, self.index.fresh = self.index.fresh, []
        crc = [zlib.crc32(w) for w in new]
        self.crc = np.append(self.crc, np.array(crc, np.uint32))
        self.spaced = np.append(self.spaced, np.fromiter((zlib.crc32(b" ", c) for c in crc), np.uint32, len(crc)))
        self.size = np.append(self.size, np.fromiter(map(len, new), np.int64, len(new)))

    def _pair_crc(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        before, size = self.spaced[first], self.size[second]
        at = np.minimum(size, SHORT) * 1024
        out = self.crc[second].copy()
        for k in range(4):
            out ^= self.shift[at + 256 * k + ((before >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
        long = np.flatnonzero(size > SHORT)
        if len(long):
            names = list(self.index)
            out[long] = [zlib.crc32(names[w], c) for w, c in zip(second[long].tolist(), before[long].tolist())]
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words and the texts they belong to, then those of all pairs."""
        if len(self.index) > FLUSH_WORDS:
            self._forget()
        own, counts = [], []
        for text in texts:
            some = words_of(text)
            counts.append(len(some))
            own += some
        ids = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
        if self.index.fresh:
            self._learn()
        text = np.repeat(np.arange(len(texts)), counts)
        pair = np.flatnonzero(text[1:] == text[:-1])
        pairs = self._pair_crc(ids[pair], ids[pair + 1])
        return ((self.crc[ids] % self.buckets).astype(np.int64), text,
                (pairs % self.buckets).astype(np.int64), text[pair])


def _raw(texts: DataFrame) -> DataFrame:
    return texts.select(F.coalesce(texts["text"].cast("string"), F.lit("")).alias("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has. Tasks and driver get one number a bucket."""
    def run(batches):
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, 256):
            one, _, two, _ = features.of(batch.column("text").cast(pa.binary()).to_pylist())
            total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    rows = _raw(texts).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` for each bucket."""
    n = len(source)
    whole_s, whole_t = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * whole_s / ((s + 1) * whole_t)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        features = Features(len(gain))
        for batch in slices(batches, 256):
            one, text, two, pair = features.of(batch.column("text").cast(pa.binary()).to_pylist())
            m = batch.num_rows
            n_words = np.bincount(text, minlength=m)
            n = n_words + np.bincount(pair, minlength=m)
            total = np.zeros(m, np.int64)
            np.add.at(total, text, gain[one])
            np.add.at(total, pair, gain[two])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, total // np.maximum(n, 1)))],
                names=["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), WEIGHED)


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> tuple:
    """The ``k``-th least (from 1) of the keys, which must differ from row to row, by quickselect.

    Each round takes the keys with the least hashes of what is left as pivots, counts exactly what
    lies between, at and beyond them in one aggregate of ``2 * pivots + 1`` rows, and goes on with
    the gap that holds the k-th key. Rows stay where they are.
    """
    def key(values=None):
        return F.struct(*(F.lit(v).alias(c) for c, v in zip(keys, values))) if values else F.struct(*keys)

    low = high = None
    number = 0
    while True:
        number += 1
        left = rows
        if low is not None:
            left = left.where((F.col(keys[0]) >= low[0]) & (key() > key(low)))
        if high is not None:
            left = left.where((F.col(keys[0]) <= high[0]) & (key() < key(high)))
        chosen = left.orderBy(F.xxhash64(*keys, F.lit(number)), *keys).limit(pivots).select(*keys).collect()
        at = sorted(tuple(r) for r in chosen)
        if not at:
            raise ValueError("fewer keys than asked for")
        place = sum(((key() > key(p)).cast("int") + (key() >= key(p)).cast("int") for p in at), F.lit(0))
        counts = {r["place"]: r["n"] for r in left.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        # place 2i lies between pivots i-1 and i, place 2i+1 is pivot i
        for i in range(2 * len(at) + 1):
            if k <= counts.get(i, 0):
                break
            k -= counts.get(i, 0)
        else:
            raise ValueError("fewer keys than asked for")
        if i % 2:
            return at[i // 2]
        low, high = (at[i // 2 - 1] if i else low), (at[i // 2] if i // 2 < len(at) else high)


def draw(rows: DataFrame, score: str, ident: str, k: int) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``k`` for the highest scores, ties to the smaller ``ident`` (null
    last) and then in any one order; null for all others."""
    taken = {c.lower() for c in rows.columns}
    if {"down", "no_id", "id_", "at"} & taken:
        raise ValueError("the columns down, no_id, id_ and at must be free")
    keys = ["down", "no_id", "id_", "at"]
    stored = materialize(rows.select(
        "*", (-F.col(score)).alias("down"), F.col(ident).isNull().cast("int").alias("no_id"),
        F.coalesce(F.col(ident), F.lit(0)).cast("long").alias("id_"), F.monotonically_increasing_id().alias("at")))
    last = kth_key(stored, keys, k)
    won = F.struct(*keys) <= F.struct(*(F.lit(v).alias(c) for c, v in zip(keys, last)))
    winners, _ = number_rows(stored.where(won), *keys)
    ranked = winners.withColumn("rank", F.col("row") + 1).drop("row")
    lost = stored.where(~won).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(lost).drop(*keys)


def noise(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))`` for a uniform u from the SHA-256 of ``seed:doc_id``; a null id is empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``, one row for each row of ``docs``.

    Features are words and pairs of neighbouring words. ``weight`` says how much more often the
    target has them: the floored mean of ``bucket_gains``. ``score`` adds Gumbel noise, so the highest scores are
    a draw without replacement with probabilities that follow the weights. Of the rows with
    ``least_words`` or more, ``percent`` per cent (floored) get a rank; the others have none.

    Null and empty texts have no features and weight 0. A null doc_id comes last among ties; rows
    with equal ids and scores are drawn in any one order. An empty target teaches that all features are
    alike but for their number; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weighed(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored)
    eligible = scored.where(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    none = F.lit(None).cast("long")
    out = draw(eligible, "score", "doc_id", k) if k else eligible.withColumn("rank", none)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", none)
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
