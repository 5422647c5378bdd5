import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastergrid.llm import langid
from rastergrid.llm.common import fold_of

import edge

PIECES = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca"]


def brute(word, prob):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        head = word[:n]
        p = prob.get(head, langid.UNKNOWN if n == 1 else 0.0)
        if p:
            total += p * brute(word[n:], prob)
    return total


@pytest.mark.parametrize("words", [["▁abcab", "▁", "▁zzz", "▁abcabcaz", "▁c"]])
def test_forward_sums_all_segmentations(words):
    rng = np.random.default_rng(1)
    table = rng.random((len(PIECES) + 2, 3))
    table[0], table[-1] = 0, langid.UNKNOWN
    got = langid.log_scores(words, langid.PieceIndex(PIECES), table)
    for k in range(3):
        prob = dict(zip(PIECES, table[1:-1, k]))
        np.testing.assert_allclose(got[:, k], [np.log(brute(w, prob)) for w in words], rtol=1e-9)


def test_expected_counts_are_the_posterior():
    words, prob = ["▁abc", "▁ab"], np.full(len(PIECES), 1 / len(PIECES))
    table = np.concatenate([[0], prob, [langid.UNKNOWN]])[:, None]
    got = langid.expected(words, np.zeros(2, int), np.array([2.0, 3.0]), langid.PieceIndex(PIECES), table)[0]

    def segmentations(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in PIECES:
                for rest in segmentations(word[n:]):
                    yield [word[:n], *rest]

    want = np.zeros(len(PIECES) + 2)
    for word, n in zip(words, (2.0, 3.0)):
        ways = list(segmentations(word))
        weight = np.array([np.prod([1 / len(PIECES)] * len(w)) for w in ways])
        for way, p in zip(ways, weight / weight.sum()):
            for piece in way:
                want[PIECES.index(piece) + 1] += n * p
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_piece_index_finds_all_and_only_pieces():
    pieces = langid.vocabulary()
    index = langid.PieceIndex(pieces)
    grid = langid.lattice(["▁theatre", "▁日本語", "▁" + "x" * 31], index)
    numbers = {p: i + 1 for i, p in enumerate(pieces)}
    word = "▁theatre"
    for j in range(1, len(word) + 1):
        for n in range(1, index.longest + 1):
            want = numbers.get(word[j - n:j], len(pieces) + 1 if n == 1 else 0) if n <= j else 0
            assert grid.ids[0, j, n - 1] == want


def test_words():
    assert langid.words_of("L'État-2x_y") == ["▁l", "▁état", "▁x", "▁y"]
    assert [len(w) for w in langid.words_of("a" * 70)] == [33, 33, 7]
    assert langid.words_of("12 !?") == []


def test_edge_rows(spark):
    rows = langid.identify(edge.documents(spark)).collect()
    assert len(rows) == len(edge.ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for i in (5, 6, 7, 8):
        assert [(r.lang_pred, r.score) for r in by_id[i]] == [("und", 0.0)]
    learned = {lang for i, _, lang, _ in edge.ROWS
               if lang and zlib.crc32((str(i) if i is not None else "").encode()) % 4 != 2}
    assert {r.lang_pred for r in rows} <= learned | {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert [by_id[1][0].lang_pred, by_id[2][0].lang_pred, by_id[4][0].lang_pred] == ["en", "de", "en"]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in rows)


def test_keeps_clean_rows_and_columns(spark):
    docs = edge.documents(spark)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, 9, 15} <= set(ids) and not {5, 6, 7, 8} & set(ids)
    assert ids.count(13) == 2


def test_nothing_to_learn(spark):
    docs = edge.documents(spark)
    assert langid.identify(docs.limit(0)).count() == 0
    rows = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_without_labels_no_row_is_lost(spark):
    docs = edge.documents(spark)
    for none in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        assert langid.keep_identified(none).count() == none.count()


def test_many_like_labels_cost_no_clean_text(spark):
    """Forty labels of the same language share the posterior; the text is as clear as before."""
    rows = [(i, edge.PROSE[i % 2], f"x{i % 40}", "a") for i in range(200)]
    docs = edge.documents(spark, rows)
    assert langid.identify(docs).agg(F.max("score")).first()[0] < 0.5
    assert langid.keep_identified(docs).count() == 200


def test_keeps_the_rows_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert kept <= lettered and len(kept) >= 0.99 * len(lettered)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_fold_is_crc32(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 77, 10**12, None)], "doc_id long")
    got = [r[0] for r in df.select(fold_of(df["doc_id"], 7)).collect()]
    assert got == [zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i in (0, 1, 77, 10**12, None)]
