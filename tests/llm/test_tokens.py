import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rastergrid.llm import packing, tokenfiles
from rastergrid.llm.encoding import TextEncoder, read_spec
from pyspark.sql import functions as F

import edge

ODD = ["", "  ", "á b", "It's 'Stop'll we'LL x", "<|endoftext|> a<|ENDOFTEXT|>b", "tab\tx\x0by\x1cz q", "Ω ΣΑΣ ς",
       "12,345.67!!! ... a.,b", "ﬁ İstanbul K", "日本語 テキスト。", "éa", "x'S. don't", "a\r\nb", "$$,,. .,a;;:b",
       "İ, aİ. İ İx", "größe ÄHRE ǅ ªº 한글 \u1112\u1161\u11ab e\u0301a, x\u0345y"]


def library(texts):
    found = Tokenizer.from_str(read_spec()).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found]


@pytest.mark.parametrize("limit", [700_000, 3])
def test_encoder_equals_library(limit):
    texts = ODD + [r[1] or "" for r in edge.ROWS]
    encoder = TextEncoder(read_spec(), limit)
    assert encoder.by_word
    for _ in range(2):
        for at in range(0, len(texts), 5):
            ids, sizes = encoder.encode(texts[at:at + 5])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts[at:at + 5])


def test_random_texts_equal_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abİıßÄäᾳﬁǅ한ª۰1'sS.,!?<|日本ー\u0301\u200d\t\n  \u00a0\u2009\u212b", k=rng.randint(0, 30)))
             for _ in range(4000)]
    ids, sizes = TextEncoder(read_spec()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts)


def test_words_and_punctuation_equal_library():
    """Words of plain letters take a shorter way to the model; punctuation of all kinds is cut off."""
    import string

    rng = random.Random(11)
    letters = "abcxyzéßöøÿÉÜŒœǰKİıſΣςж×÷ªµ日"
    words = ["".join(rng.choices(letters, k=rng.randint(0, 6))) + "".join(rng.choices(string.punctuation, k=rng.randint(0, 3)))
             + "".join(rng.choices(["", "", "s", "'ll", "\u030c", "\u0338", "|>", "7"], k=1)) for _ in range(20_000)]
    texts = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)] + ["J\u030c j\u030c J\u030c. x<|endoftext|>y, a<| <|",
                                                                       "A\u0958! \u09dc. \ufb1d, a\u0130! b\u0a5e."]
    ids, sizes = TextEncoder(read_spec()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts)


def test_only_distinct_words_become_objects():
    """A column is cut and its words told apart as an array; the memory is asked once for each distinct word,
    and the library gets a word without its punctuation and in one case."""
    import pyarrow as pa

    class Asked(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    class Watched(TextEncoder):
        seen = 0

        def _library(self, texts, *more):
            self.seen += sum(len(t.split()) for t in texts)
            return super()._library(texts, *more)

    encoder = Watched(read_spec())
    encoder.words = Asked()
    texts = ["the cat, The cat&&& THE *** Cat! größe größe---\nthe"] * 500
    ids, sizes = encoder.encode(pa.array(["", *texts]).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts)
    assert encoder.words.n == 9 and encoder.seen == 3 + 5


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    encoder = TextEncoder(read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    assert not encoder.by_word
    ids, sizes = encoder.encode(["a  b", ""])
    assert sizes.tolist() == [len(ids), 0]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files_round_trip(spark, tmp_path):
    docs = edge.documents(spark).repartition(5)
    folder = tokenfiles.write_token_files(docs, str(tmp_path / "t"))
    got = sorted(tokenfiles.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    want = [(i, ids + [2]) for (i, *_), ids in zip(edge.ROWS, library([r[1] or "" for r in edge.ROWS]))]
    assert [r.doc_id for r in got] == [i for i, _ in in_order(want)]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_one_document_is_read_alone(spark, tmp_path):
    folder = tokenfiles.write_token_files(edge.documents(spark).coalesce(1), str(tmp_path / "t"))
    import json
    import os

    name = json.load(open(os.path.join(folder[5:], tokenfiles.MANIFEST)))["files"][0]["file"]
    dictionary = open(os.path.join(folder[5:], tokenfiles.DICTIONARY), "rb").read()
    file = tokenfiles.TokenFile(f"{folder}/{name}", dictionary)
    for i in range(file.documents):
        assert tokenfiles.read_document(folder, name, i).tolist() == file.ids(i).tolist()
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.TokenFile(f"{folder}/{name}", b"other content")


def test_small_tables_have_a_dictionary(spark):
    for rows in (edge.ROWS[:3], edge.ROWS[:1], edge.ROWS):
        folder = tokenfiles.write_token_files(edge.documents(spark, rows))
        assert len(tokenfiles._content(f"{folder}/{tokenfiles.DICTIONARY}")) >= 8


def test_samples_are_bounded_without_blanks(spark):
    rows = [(i, "x" * 200_000, "en", "a") for i in range(4)]
    samples = tokenfiles.sample_ids(edge.documents(spark, rows), read_spec(), 3, 100)
    assert len(samples) == 3 and max(map(len, samples)) <= 4 * 800


@pytest.mark.parametrize("every", [1, 100, 400])
def test_samples_are_the_least_hashes(spark, every):
    rows = [(i, f"word{i} of {i % 7}" if i % every == 0 else "", "en", "a") for i in range(3000)]
    rows += rows[:every + 1] * 5
    docs = edge.documents(spark, rows)
    ranked = docs.where("text <> ''").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("long"), "text")).limit(16)
    expected = [np.array(ids, "<u4").tobytes() for ids in library([r.text for r in ranked.collect()])]
    assert tokenfiles.sample_ids(docs, read_spec(), 16, 100) == expected


def test_no_documents(spark, tmp_path):
    folder = tokenfiles.write_token_files(edge.documents(spark).limit(0), str(tmp_path / "t"))
    assert tokenfiles.read_token_files(spark, folder).count() == 0
    assert packing.pack(edge.documents(spark).limit(0)).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.documents
        assert sum(n * n for _, n in parts) <= capacity.cost
    return bins


def test_packing(spark, tmp_path):
    store = str(tmp_path / "pieces")
    rows = packing.pack(edge.documents(spark), F.crc32("ids").alias("crc"), store=store).collect()
    want = []
    for (i, *_), ids in zip(edge.ROWS, library([r[1] or "" for r in edge.ROWS])):
        ids = np.array(ids + [0], "<u4")
        want += [(str(i), p // 2048, p, len(ids[p:p + 2048]), zlib.crc32(ids[p:p + 2048].tobytes()))
                 for p in range(0, len(ids), 2048)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.crc) for r in rows) == sorted(want)
    bins = check_bins(rows, packing.Capacity())
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)


def test_sequences_hold_the_ids(spark, tmp_path):
    few = [(i, "word " * (300 * i), "en", "a") for i in range(1, 12)]
    store = str(tmp_path / "pieces")
    placed = packing.pack(edge.documents(spark, few), store=store)
    total = sum(len(r.ids) // 4 for r in packing.sequences(placed, store).collect())
    assert total == sum(300 * i + 1 for i in range(1, 12))
    for r in packing.sequences(placed, store).collect():
        assert sum(r.lengths) * 4 == len(r.ids) <= 2048 * 4


def one_by_one(lengths, capacity, weights):
    """Best fit of single pieces, each bin on its own."""
    caps = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    bins = []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n])
        fits = [b for b in bins if (b >= item).all()]
        if fits:
            best = min(fits, key=lambda b: (np.array(weights) * ((b - item) / caps) ** 2).sum())
            best -= item
        else:
            bins.append(caps.astype(np.int64) - item)
    return len(bins)


def test_sequences_hold_null_and_repeated_ids(spark, tmp_path):
    store = str(tmp_path / "pieces")
    placed = packing.pack(edge.documents(spark), store=store)
    packed = packing.sequences(placed, store).collect()
    lengths = [n for r in packed for n in r.lengths]
    assert sorted(lengths) == sorted(r.length for r in placed.collect())
    assert all(len(r.ids) == 4 * sum(r.lengths) <= 4 * 2048 for r in packed)


@pytest.mark.parametrize("capacity", [packing.Capacity(100, 100, 10_000), packing.Capacity(100, 5, 10_000),
                                      packing.Capacity(100, 8, 4_000)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(capacity, rule):
    rng = np.random.default_rng(3)
    top = min(100, int(capacity.cost ** 0.5))
    lengths = np.minimum(rng.geometric(0.05, 4000), top)
    sizes, n = np.unique(lengths, return_counts=True)
    runs = packing.plan_bins(dict(zip(sizes.tolist(), n.tolist())), capacity, rule=rule)
    used = {}
    for size, count in zip(sizes.tolist(), n.tolist()):
        own = runs[runs[:, 0] == size]
        for rank in range(count):
            run = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            ahead = rank - run[1]
            used.setdefault(run[3] + ahead // run[2], []).append((run[4] + ahead % run[2] * size, size))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.documents
        assert sum(s * s for _, s in parts) <= capacity.cost
    if rule == "norm":
        assert len(used) <= one_by_one(lengths.tolist(), capacity, (1.0, 1e-3, 1e-3)) * 1.02 + 1


def test_too_large_a_piece_raises():
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan_bins({10: 1}, packing.Capacity(10, 1, 50))
