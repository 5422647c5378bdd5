import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.llm import lm

import edge


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows):
    seen = Counter(t for i, text, *_ in rows if not held(i) for t in tokens_of(text))
    n, v = sum(seen.values()), len(seen)
    return n, [(i, held(i), len(w := tokens_of(t)), sum(seen[x] > 0 for x in w),
                sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for i, t, *_ in rows]


@pytest.mark.parametrize("options", [{}, {"head_words": 3}, {"slice_bytes": 2000, "segment_bytes": 3000, "head_words": 5}])
def test_base_scores_are_exact(spark, options):
    got = lm.learn_and_score(edge.documents(spark), **options).collect()
    n, want = brute_base(edge.ROWS)
    assert {r.train_tokens for r in got} == {n}
    key = lambda r: (str(r[0]), r[2], r[4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_segments_score_like_one_filter(spark):
    docs = edge.documents(spark)
    counts = lm.learn(docs, slice_bytes=2000)
    assert counts.slices > 5 and len(counts.segments(500)) > 3 and len(counts.segments()) == 1
    one, many = ({(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, counts, segment_bytes=b).collect()}
                 for b in (lm.SEGMENT_BYTES, 500))
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-12) for k in one)


def test_scores_follow_the_exact_counts(spark):
    """Scores from the filter against the levels of exact counts; they differ only where it errs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one, two = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            own = tokens_of(text)
            one.update(own)
            two.update(zip(["\n", *own], own))
    total, words = sum(one.values()), len(one)

    def levels(counts, keys, base):
        n = np.array([counts[k] for k in keys], float)
        return np.where(n > 0, lm.levels_of(np.maximum(n, 1), base), 0)

    got = {r.doc_id: r.score for r in lm.learn_and_score(docs).collect()}
    near = 0
    for i, text in rows:
        own = tokens_of(text)
        before = ["\n", *own[:-1]]
        want = lm.log_probabilities(levels(one, own, lm.BASES[0]), levels(one, before, lm.BASES[0]),
                                    levels(two, list(zip(before, own)), lm.BASES[1]), total, words, lm.STRENGTH).sum()
        assert got[i] == pytest.approx(want, rel=0.02)
        near += got[i] == pytest.approx(want, rel=2e-3)
    assert near > 0.9 * len(rows)


def test_filter_never_reads_too_little():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    levels = np.minimum(rng.geometric(0.4, 20_000), 12)
    bits = lm.filter_slice(keys, levels)
    whole = lm.Segment(1, 0, np.array([0]), np.array([8 * len(bits)], np.uint64), bits)
    got = whole.levels(keys, keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (whole.levels(other, other) > 0).mean() < 0.02


def test_levels():
    for base in lm.BASES:
        counts = np.arange(1, 5000)
        levels = lm.levels_of(counts, base)
        assert (base ** (levels - 1.0) <= counts * (1 + 1e-6)).all() and (counts < base ** levels.astype(float) * (1 + 1e-6)).all()


def test_probabilities_sum_to_at_most_one(spark):
    """The model over its own vocabulary, after several words before."""
    rows = [(i, t, "en", "a") for i, t in enumerate(["a b a b c", "b a b", "c c a", "a b", "d e a b"] * 5)]
    counts = lm.learn(edge.documents(spark, rows))
    segment = counts.segment(0, counts.slices)
    words = lm.Words()
    vocabulary = [b"a", b"b", b"c", b"d", b"e"]
    at, _ = words.tokens(vocabulary)
    ids = np.array(sorted(set(at.tolist())))
    level = segment.levels(words.keys, lm._mix(words.keys))
    for before in ids:
        pairs = lm.pair_keys(np.full(len(ids), words.keys[before]), words.keys[ids])
        logs = lm.log_probabilities(level[ids], np.full(len(ids), level[before]), segment.levels(pairs, pairs),
                                    counts.tokens, counts.words, 2.0)
        assert 0.3 < (10 ** logs).sum() <= 1 + 1e-9


def test_model_beats_single_words_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.learn_and_score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_nothing_to_learn(spark):
    docs = edge.documents(spark)
    assert lm.learn_and_score(docs.limit(0)).count() == 0
    rows = [r for r in edge.ROWS if held(r[0])] or [(next(i for i in range(99) if held(i)), "a b", "en", "a")]
    got = lm.learn_and_score(edge.documents(spark, rows)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def test_packed_heads_count_exactly_in_little_space():
    """Each worker holds the frequent words: arrays, with words that decide where keys agree."""
    head = {b"w%d" % i: i + 1 for i in range(20_000)}
    packed = lm.packed_head(head)
    assert sum(x.nbytes for x in packed) < 30 * len(head)
    words = [b"w7", b"none", b"\n", b"w19999", b"w0"]
    keys = np.fromiter(map(lm.xxhash.xxh3_64_intdigest, words), np.uint64)
    assert lm.head_counts(packed, words, keys).tolist() == [8, 0, 0, 20_000, 1]
    other = [b"another", *words[1:]]      # the key of w7, but not the word
    assert lm.head_counts(packed, other, keys).tolist() == [0, 0, 0, 20_000, 1]
    assert lm.head_counts(lm.packed_head({}), words, keys).tolist() == [0] * 5


def test_long_texts_are_scored_in_short_runs():
    """Tokens of a run are held at once: a run is bounded by bytes as well as by rows."""
    texts = ["ab " * 1000] * 40 + ["x"] * 700 + ["y" * 5_000_000, "", "z"]
    batch = lm.pa.RecordBatch.from_pydict({"text": texts})
    runs = [r.column("text").to_pylist() for r in lm.text_runs([batch], most=30_000)]
    assert [t for r in runs for t in r] == texts
    assert all(len(r) <= lm.SCORE_ROWS and sum(map(len, r[:-1])) < 30_000 for r in runs) and len(runs) > 4
    assert list(lm.text_runs([batch.slice(0, 0)])) == []


def test_tokens_are_told_apart_as_arrays():
    """Words of a column equal those of the texts, and keys exist once for each distinct word, over several
    columns; only those are looked up."""
    class Asked(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    texts = ["", " ", "the cat The CAT\t\x0b\x0c\r\n the", "\n\x1c a\u00a0b \u2003 ", "É İ ß 日本語 Straße", "the"] * 200
    words = lm.Words()
    words.index = Asked(words.index)
    for some in (texts, texts[:3], [], texts):
        at, counts = words.tokens(lm.pa.array(["skipped", *some], lm.pa.string()).slice(1))
        names, want = list(words.index), [[w.encode() for w in tokens_of(t)] for t in some]
        assert counts.tolist() == [len(w) for w in want]
        assert [names[i] for i in at.tolist()] == [w for own in want for w in own]
    assert words.keys.tolist() == [lm.xxhash.xxh3_64_intdigest(w) for w in names]
    assert words.index.n == 3 * len(names[1:]) - len([w for w in names[1:] if w not in (b"the", b"cat")])


def test_entries_are_looked_up_in_small_groups(monkeypatch):
    """What a look-up holds for each entry is bounded, and groups do not change what is found."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bits = lm.filter_slice(keys, rng.integers(1, 9, 5000))
    whole = lm.Segment(1, 0, np.array([0]), np.array([8 * len(bits)], np.uint64), bits)
    asked = np.concatenate([keys, rng.integers(0, 2**63, 5000).astype(np.uint64)])
    sizes, single = [], lm._hashes
    monkeypatch.setattr(lm, "_hashes", lambda entries, level: sizes.append(len(entries)) or single(entries, level))
    want = whole.levels(asked, asked)
    monkeypatch.setattr(lm, "PROBED", 64)
    sizes.clear()
    assert (whole.levels(asked, asked) == want).all() and max(sizes) <= 64


def test_known_levels_are_not_looked_up(monkeypatch):
    """Entries with exact counts begin at their own level, whatever it is, and the levels found are the same."""
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    levels = rng.integers(1, 120, 4000)
    bits = lm.filter_slice(keys, levels)
    whole = lm.Segment(2, 0, np.array([0]), np.array([8 * len(bits)], np.uint64), bits)    # half of the keys
    asked, probed, single = np.append(keys, keys[:9] + np.uint64(1)), [], lm._hashes
    least = np.append(np.where(np.arange(4000) % 4 > 0, levels, 0), np.zeros(9, np.int64))
    want = whole.levels(asked, asked)
    assert 0 < (want > 0).sum() < 4000 and (want[:4000][want[:4000] > 0] >= levels[want[:4000] > 0]).all()
    monkeypatch.setattr(lm, "_hashes", lambda entries, level: probed.append(len(entries)) or single(entries, level))
    assert (whole.levels(asked, asked, least) == want).all()
    assert sum(probed) < 0.3 * (want.sum() + len(want))
