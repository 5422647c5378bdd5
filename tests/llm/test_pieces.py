import itertools
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rastergrid.llm import pieces

import edge

ODD = ["", "  ", "a", "  a  b ", "\n\n", "tab\tx", "日本語 テキスト。", "emoji 😀 x", "a" * 40, "hello    world   ",
       "ＡＢＣ ﬁ", "1234567890 3.14159", "def f(x):\n    return x+1", "<s> </s> <unk> <0x41>", "▁▁ x▁y", "========------",
       "http://www.example.com/a?b=c&d=e", "the The THE theatre theatrical", "don't stop. now,", "x²."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())


def test_ids_equal_the_library(library):
    encoder = pieces.Encoder(pieces.read_model(), limit=10)
    texts = ODD + [t or "" for _, t, *_ in edge.ROWS]
    for at in range(0, len(texts), 7):
        ids, sizes = encoder.encode(texts[at:at + 7])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library.encode(texts[at:at + 7])


def test_random_words_equal_the_library(library):
    rng = np.random.default_rng(4)
    vocabulary = pieces.Vocabulary.load(pieces.read_model())
    some = [p.replace("▁", "") for p in list(vocabulary.ids)[:8000]]
    words = ["▁" + "".join(rng.choice(some, rng.integers(1, 6))) for _ in range(2000)]
    words = [w for w in words if w != "▁"]
    search = pieces.Viterbi(vocabulary)
    for at, found in search.segment(words):
        assert [i for p in found for i in search.ids_of(p)] == library.encode(words[at][1:])


def best_by_hand(word, scores):
    """Largest sum over all ways to cut the word."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in scores for p in parts):
            total = sum(scores[p] for p in parts)
            best = total if best is None else max(best, total)
    return best


def test_unigram_scores_are_the_best_over_all_cuts():
    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(25)} | {"a", "b"})
    scores = dict(zip(names, (-rng.random(len(names)) * 5).tolist()))
    vocabulary = pieces.Vocabulary(["<unk>", *names], [0.0, *scores.values()], {0})
    words = ["".join(w) for n in range(1, 9) for w in itertools.product("ab", repeat=n)][::3]
    for at, found in pieces.Viterbi(vocabulary, "unigram").segment(words):
        assert "".join(found) == words[at]
        assert sum(scores[p] for p in found) == pytest.approx(best_by_hand(words[at], scores))


def test_edge_rows_and_round_trip(spark, library):
    docs = edge.documents(spark)
    coded = pieces.encode(docs)
    got = coded.select("doc_id", "n_ids", F.crc32("ids").alias("crc"),
                       pieces.decoded(spark, F.col("ids")).alias("text")).collect()
    want = [(i, t or "", np.array(library.encode(t or ""), "<u4")) for i, t, *_ in edge.ROWS]
    assert sorted((str(r.doc_id), r.n_ids, r.crc) for r in got) == sorted(
        (str(i), len(x), zlib.crc32(x.tobytes())) for i, _, x in want)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), library.decode(x.tolist())) for i, _, x in want)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_many_words_go_without_a_python_step_for_each_character(library, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("aehinrstéñ"), rng.integers(2, 12))) for _ in range(300)) for _ in range(8)]
    seen, one = [], pieces.Viterbi._merged
    monkeypatch.setattr(pieces.Viterbi, "_merged", lambda self, word, *more: (seen.append(word), one(self, word, *more)))
    ids, sizes = pieces.Encoder(pieces.read_model()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library.encode(texts)
    assert len(seen) < pieces.FEW


@pytest.mark.parametrize("run", [1 << 20, 50])
@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_prefixes_by_depth_give_what_words_one_by_one_give(kind, run, monkeypatch):
    monkeypatch.setattr(pieces, "RUN_CHARS", run)
    monkeypatch.setattr(pieces, "FEW", 4)
    rng = np.random.default_rng(9)
    for letters in ("ab", "abcé日"):
        names = sorted({"".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(60)} - {"é"})
        # few scores, so that sums are often equal
        search = pieces.Viterbi(pieces.Vocabulary(names, (-rng.integers(1, 6, len(names)) / 4).tolist(), set()), kind)
        words = ["".join(rng.choice([*letters, "?", "😀"], rng.integers(0, 14))) for _ in range(700)] + ["ab" * 40, ""]
        found = dict(search.segment(words))
        assert [found[at] for at in range(len(words))] == [
            own for _, own in sorted(search._one_by_one(words))]


def test_words_end_where_the_library_cuts_or_no_piece_goes_on(library):
    rng = np.random.default_rng(10)
    some = ["▁", "▁▁", " ", "  ", "\n", "\n\n", "\t", "a", "Z", "é", "ÿ", "×", "÷", "Ã", "ß", "Ā", "1", ".", "(", "~", "@", "日", "😀", "\x00", "\x7f",
            "the", "ing", "://", "..."]
    texts = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(3000)]
    ids, sizes = pieces.Encoder(pieces.read_model()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library.encode(texts)


def test_tables_find_what_was_put_in():
    rng = np.random.default_rng(11)
    keys = np.unique(rng.integers(0, 1 << 50, 5000))
    table = pieces._Table()
    assert table.get(keys[:3]).tolist() == [-1, -1, -1]
    for at in range(0, len(keys), 700):
        table.put(keys[at:at + 700], np.arange(at, min(at + 700, len(keys))).astype(np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys[:-1] + 1)[np.diff(keys) > 1] == -1).all()
