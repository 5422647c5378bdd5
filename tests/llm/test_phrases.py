import re
from collections import Counter

import numpy as np
import pytest

from rastergrid.llm import phrases

import edge


def brute_counts(rows, longest):
    seen, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(own)
            for n in range(1, longest + 1):
                for i in range(len(own) - n + 1):
                    seen[lang, tuple(own[i:i + n])] += 1
    return seen, total


def brute(rows, longest=4, least=30, share=80, top=2000):
    seen, total = brute_counts(rows, longest)
    found = {k: a for k, a in seen.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        if any(g == lang and len(w) > len(words) and 100 * f >= share * a
               and any(w[i:i + len(words)] == words for i in range(len(w)))
               for (g, w), f in found.items()):
            continue
        cuts = [(2000000 * a // (seen[lang, words[:k]] + seen[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(words), seen[lang, words[:k]], seen[lang, words[k:]]))
    rows = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))
        rows += [(lang, i + 1, p, a, l, r, total[lang], s) for i, (_, s, a, p, l, r) in enumerate(own[:top])]
    return sorted(rows)


def same(got, want):
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("options", [{"least": 2}, {"least": 3, "longest": 3, "share": 50}, {"least": 2, "longest": 2, "top": 3}])
def test_awkward_rows(spark, options):
    rows = [r for r in edge.ROWS if r[0] != 9] + [
        (20, "A a a a a, a a\tb  b. New York; NEW YORK new york city: new york City", "en", "a"),
        (21, "la la la\x0bla la\x0cla \x1cla", "en", "a"), (22, "ÄÖ äö ÄÖ äö ÄÖ äö", "de", "a"), (23, "a a a", "und", "a"),
        (24, "a a a", None, "a"), (25, "..", "en", "a")]
    got = phrases.collocations(edge.documents(spark, rows), **options)
    want = brute(rows, **options)
    assert want
    same(got, want)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    same(phrases.collocations(docs), brute(rows))


def test_flushes_and_slices(spark, sf, monkeypatch):
    """Many small runs of words, small slices, a crowded filter: the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute(rows, least=8)
    monkeypatch.setattr(phrases, "FLUSH_TOKENS", 500)
    monkeypatch.setattr(phrases, "PART_BYTES", 20_000)
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    monkeypatch.setattr(phrases, "BLOCK_BITS", 4)
    same(phrases.collocations(docs, least=8), want)


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a base of 1 a fingerprint is a mere sum: every order of the same words collides."""
    monkeypatch.setattr(phrases, "BASE", 1)
    rows = [(i, "x y z. y x z. z y x y. x z y" if i % 3 else "y x, z y x", "en", "a") for i in range(40)]
    same(phrases.collocations(edge.documents(spark, rows).repartition(7), least=5), brute(rows, least=5))
    # and with the same text in every task, some of it in one order only
    rows = [(i, "x y. x z" if i < 20 else "y x. z x", "en", "a") for i in range(40)]
    same(phrases.collocations(edge.documents(spark, rows).repartitionByRange(8, "doc_id"), least=5), brute(rows, least=5))


def test_fingerprints_are_polynomials():
    corpus = phrases.Corpus()
    corpus.add(np.array([5, 9]), ["en", "de"], [b"a b c. d", b"a b  c"])
    grams = corpus.close()
    assert grams.whole(3).tolist() == [0, 4] and grams.whole(2).tolist() == [0, 1, 4, 5]
    two = grams.fingerprints(grams.whole(2), 2).tolist()
    assert len(set(two)) == 4
    import xxhash
    a, b = (xxhash.xxh3_64_intdigest(x) for x in (b"a", b"b"))
    assert two[0] == (xxhash.xxh3_64_intdigest(b"en", 1) * phrases.BASE ** 2 + a * phrases.BASE + b) % (1 << 64)


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    row = spark.sql("SELECT cast(2000000 * cast(a AS decimal(30, 0)) AS decimal(38, 0)) div (cast(l AS decimal(20, 0)) + r) AS s "
                    "FROM VALUES (9000000000000000000L, 9000000000000000000L, 9000000000000000001L) AS t(a, l, r)").first()
    assert row.s == 2000000 * 9 * 10**18 // (18 * 10**18 + 1)


def test_empty(spark):
    docs = edge.documents(spark)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("doc_id = 10")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
