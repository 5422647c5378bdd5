"""Phrase collocations from Rabin-Karp fingerprints of all word n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastergrid.llm.common import by_key, pack_sorted, slice_of, slices, tidy, unpack_sorted
from rastergrid.llm.encoding import _Index
from rastergrid.session import materialize

LONGEST = 4
LEAST = 30
#: A-Z lower-cased, ``.,;:!?`` and line ends one mark, tabs as spaces.
MARKS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
BASE = 0x9E3779B97F4A7C15
SECOND = 0xD6E8FEB86659FD93     # base of the second polynomial, by which colliding fingerprints are told apart
FLUSH_TOKENS, FLUSH_WORDS = 1_500_000, 300_000
PART_BYTES = 16 << 20      # text behind one task that adds up fingerprints
SLICES = 4                 # slices of such a task
FILTER_BITS, BLOCK_BITS = 27, 21


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a line end where a piece ends; empty strings stand between spaces."""
    return text.translate(MARKS).replace(b"\n", b" \n ").split(b" ")


def words(text: bytes) -> list[bytes]:
    """The words alone: those of ``tokens`` that can be part of a phrase."""
    return [w for w in tokens(text) if w and w != b"\n"]


class Corpus:
    """Words of texts as numbers, with their piece, row and place; and the prefix polynomials over
    them. A fingerprint is a polynomial in ``BASE`` modulo 2^64 whose coefficients are the hashes of
    the language and of the words, so it tells languages and lengths apart too."""

    def __init__(self):
        self.index = _Index()
        self.index[b""], self.index[b"\n"]
        self.langs = _Index()
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = self.pieces = 0

    def add(self, rows: np.ndarray, langs: list[str], texts: list[bytes]) -> None:
        own, counts = [], []
        for text in texts:
            some = tokens(text)
            some.append(b"\n")
            counts.append(len(some))
            own += some
        ids = np.fromiter(map(self.index.__getitem__, own), np.int32, len(own))
        lang = np.fromiter(map(self.langs.__getitem__, langs), np.int16, len(langs))
        at = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        piece = self.pieces + np.cumsum(ids == 1, dtype=np.int32)
        self.pieces = int(piece[-1])
        kept = ids > 1
        ids, at, piece = ids[kept], at[kept], piece[kept]
        n = np.bincount(at, minlength=len(counts))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        self.found.append((ids, lang[at], piece, rows[at], place.astype(np.uint32)))
        self.size += len(ids)

    def full(self) -> bool:
        return self.size > FLUSH_TOKENS or len(self.index) > FLUSH_WORDS

    def close(self) -> Grams:
        columns = [np.concatenate(x) for x in zip(*self.found)]
        names, langs = list(self.index), [x.encode() for x in self.langs]
        hashes = [Polynomial(columns[0], *(np.fromiter((digest(x, seed) for x in some), np.uint64, len(some))
                                           for some, seed in ((names, 0), (langs, 1))), base)
                  for digest, base in ((xxhash.xxh3_64_intdigest, BASE), (xxhash.xxh64_intdigest, SECOND))]
        return Grams(columns, *hashes)


class Polynomial:
    """Prefix polynomials over the hashes of a sequence of words, modulo 2^64."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, langs: np.ndarray, base: int):
        self.base, self.langs = base, langs
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(ids), base, np.uint64)))
        falling = np.full(len(ids), pow(base, -1, 1 << 64), np.uint64)
        falling[:1] = 1
        self.prefix = np.append(np.uint64(0), np.cumsum(words[ids] * np.cumprod(falling)))

    def of(self, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
        """Hashes of the ``n`` words from each place on, with their language in front."""
        own = (self.prefix[at + n] - self.prefix[at]) * self.powers[at + n - 1]
        return own + self.langs[lang] * np.uint64(pow(self.base, n, 1 << 64))


class Grams:
    """The n-grams of closed ``Corpus`` texts."""

    def __init__(self, columns: list[np.ndarray], first: Polynomial, second: Polynomial):
        self.ids, self.lang, self.piece, self.rows, self.places = columns
        self.first, self.second = first, second

    def whole(self, n: int) -> np.ndarray:
        """Starts of the runs of ``n`` words inside one piece."""
        last = self.piece[n - 1:]
        return np.flatnonzero(self.piece[:len(last)] == last).astype(np.int32)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.first.of(at, n, self.lang[at])

    def tally(self, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Fingerprint, count, first place (row, word) and check of each distinct n-gram that starts ``at``.
        Equal fingerprints are compared word by word: what differs has entries of its own. The check is
        half of the second polynomial."""
        fps = self.fingerprints(at, n)
        order = np.argsort(fps, kind="stable")
        fps, at = fps[order], at[order]
        del order
        new = np.ones(len(at), bool)
        new[1:] = (fps[1:] != fps[:-1]) | (self.lang[at[1:]] != self.lang[at[:-1]])
        for i in range(n):
            word = self.ids[at + i]
            new[1:] |= word[1:] != word[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(at)))
        at = at[first]
        check = (self.second.of(at, n, self.lang[at]) >> np.uint64(32)).astype(np.uint32)
        return fps[first], counts.astype(np.uint32), self.rows[at], self.places[at], check


PARTIAL = pa.schema([("slice", pa.int32()), ("n", pa.int32()), ("lang", pa.string()), ("total", pa.int64()),
                     ("size", pa.int32()), ("entries", pa.binary())])
PARTIAL_SQL = "slice int, n int, lang string, total long, size int, entries binary"


def _in_slices(n: int, columns: tuple[np.ndarray, ...], n_slices: int) -> pa.RecordBatch:
    """Sorted entries cut at the slices of the fingerprint; rows count from the least of them."""
    fps, counts, rows, places, check = columns
    cuts = np.searchsorted(slice_of(fps, n_slices), np.arange(n_slices + 1)).tolist()
    some = [i for i in range(n_slices) if cuts[i] < cuts[i + 1]]
    least = rows.min() if len(rows) else 0
    columns = (fps, counts, (rows - least).astype(np.uint64), places, check)
    return pa.RecordBatch.from_arrays([
        pa.array(some, pa.int32()), pa.array([n] * len(some), pa.int32()),
        pa.nulls(len(some), pa.string()), pa.array([least] * len(some), pa.int64()),
        pa.array([cuts[i + 1] - cuts[i] for i in some], pa.int32()),
        pa.array([pack_sorted(*(c[cuts[i]:cuts[i + 1]] for c in columns)) for i in some], pa.binary())], schema=PARTIAL)


def _partials(n_slices: int, lengths: tuple[int, ...], filter_bits=None):
    """Entries of the n-grams of a task, a few million words at a time, and its words per language
    (``slice`` -1). With ``filter_bits`` only n-grams all of whose word pairs may be frequent."""

    def run(batches):
        corpus = Corpus()

        def out():
            grams = corpus.close()
            if filter_bits is None:
                n = np.bincount(grams.lang, minlength=len(corpus.langs))
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1] * len(n), pa.int32()), pa.array([0] * len(n), pa.int32()),
                    pa.array(list(corpus.langs), pa.string()), pa.array(n, pa.int64()),
                    pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=PARTIAL)
            else:
                pairs = np.zeros(len(grams.ids), bool)
                at = grams.whole(2)
                pairs[at] = may_hold(filter_bits.value, grams.fingerprints(at, 2))
            for length in lengths:
                at = grams.whole(length)
                if filter_bits is not None:
                    at = at[np.logical_and.reduce([pairs[at + i] for i in range(length - 1)])]
                yield _in_slices(length, grams.tally(at, length), n_slices)

        for batch in slices(batches, 256):
            corpus.add(batch.column("row").to_numpy(), batch.column("lang").to_pylist(),
                       batch.column("text").cast(pa.binary()).to_pylist())
            if corpus.full():
                yield from out()
                corpus = Corpus()
        if corpus.found:
            yield from out()

    return run


ENTRY = pa.schema([("n", pa.int32()), ("fp", pa.int64()), ("count", pa.int64()), ("row", pa.int64()),
                   ("place", pa.int64()), ("lang", pa.string())])
ENTRY_SQL = "n int, fp long, count long, row long, place long, lang string"


def _frequent(least: int):
    """The n-grams that come up ``least`` times or more in all tasks together, each with one of its
    places; and the numbers of words (``n`` 0), which go through. Entries of one fingerprint whose checks
    differ have collided and are added up apart."""

    def run(batches):
        for table in by_key(batches, ["slice", "n"]):
            numbers = [table.column(c).to_numpy() for c in ("slice", "n")]
            cuts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in numbers], axis=0)))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), table.num_rows]):
                own = table.slice(start, end - start)
                if not numbers[1][start]:
                    none = pa.nulls(own.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        own.column("n").combine_chunks(), none, own.column("total").combine_chunks(), none, none,
                        own.column("lang").combine_chunks()], schema=ENTRY)
                    continue
                parts = [unpack_sorted(raw, size, np.uint32, np.uint64, np.uint32, np.uint32) for raw, size in zip(
                    own.column("entries").to_pylist(), own.column("size").to_pylist())]
                fps, counts, rows, places, check = (np.concatenate(x) for x in zip(*parts))
                rows = rows.astype(np.int64) + np.repeat(own.column("total").to_numpy(), [len(p[0]) for p in parts])
                order = np.argsort(fps, kind="stable")
                same = fps[order][1:] == fps[order][:-1]
                if (same & (check[order][1:] != check[order][:-1])).any():
                    order = np.lexsort((check, fps))
                fps, check = fps[order], check[order]
                first = np.flatnonzero(np.append(True, (fps[1:] != fps[:-1]) | (check[1:] != check[:-1])))
                total = np.add.reduceat(counts[order].astype(np.int64), first)
                kept = total >= least
                at = order[first[kept]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), numbers[1][start]), pa.int32()), pa.array(fps[first[kept]].view(np.int64)),
                    pa.array(total[kept]), pa.array(rows[at]), pa.array(places[at].astype(np.int64)),
                    pa.nulls(len(at), pa.string())], schema=ENTRY)

    return run


def may_hold(bits: np.ndarray, fps: np.ndarray) -> np.ndarray:
    at = (fps >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def pair_filter(entries: DataFrame) -> np.ndarray:
    """One bit for each value of the upper ``FILTER_BITS`` bits of a fingerprint, set where a frequent
    word pair has it. Tasks fill blocks of bits; the size (16 MiB) does not depend on the table. A
    crowded filter lets more n-grams be counted, and never loses one."""
    size = 1 << BLOCK_BITS

    def fill(batches):
        for table in by_key(batches, ["block"]):
            block, fps = table.column("block").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            for b in np.unique(block).tolist():
                bits = np.zeros(size, bool)
                bits[((fps[block == b] >> np.uint64(64 - FILTER_BITS)) & np.uint64(size - 1)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array(
                    [np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    blocks = 1 << (FILTER_BITS - BLOCK_BITS)
    pairs = entries.where("n = 2").select("fp").distinct().withColumn(
        "block", F.shiftrightunsigned("fp", 64 - FILTER_BITS + BLOCK_BITS).cast("int"))
    filled = (pairs.repartition(blocks, "block").sortWithinPartitions("block")
              .mapInArrow(fill, "block int, bits binary"))
    out = np.zeros((blocks, size // 8), np.uint8)
    for r in filled.collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _texts_at(batches):
    """The phrase that each entry points to."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    for batch in slices(batches, 64):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        lists = batch.column("entries")
        sizes = lists.value_lengths().to_pylist()
        inner = lists.flatten()
        n, place = (inner.field(c).to_pylist() for c in ("n", "place"))
        phrases, at = [], 0
        for text, size in zip(texts, sizes):
            own = words(text)
            phrases += [b" ".join(own[p:p + k]) for k, p in zip(n[at:at + size], place[at:at + size])]
            at += size
        yield pa.RecordBatch.from_arrays([
            pa.array([x for x, size in zip(langs, sizes) for _ in range(size)], pa.string()), inner.field("n"),
            pa.array(phrases, pa.binary()).cast(pa.string()), inner.field("count")], schema=schema)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, n, phrase, f``: runs of 1 to ``longest`` words that occur ``least`` times or more in
    their language; and ``lang, n``: all its words.

    Tasks hash every n-gram by differences of prefix polynomials and send, for ranges of the
    fingerprint, packed arrays of fingerprints with counts, one occurrence and a check each; what adds
    up to ``least`` stays. Longer n-grams are counted in a second pass, where all their word pairs may
    be frequent: no other can be.

    Collisions: a task compares equal fingerprints word by word in its texts; those of different
    tasks collide unnoticed only if 32 further bits of an independent polynomial are equal too.
    Only what is frequent is looked up in the text, at one occurrence.
    """
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def entries(lengths, filter_bits=None):
        partials = rows.mapInArrow(tidy(_partials(SLICES * parts, lengths, filter_bits)), PARTIAL_SQL)
        return materialize(partials.repartition(parts, "slice").sortWithinPartitions("slice", "n")
                           .mapInArrow(tidy(_frequent(least)), ENTRY_SQL))

    short = entries(tuple(range(1, min(longest, 2) + 1)))
    found = short.where("n > 0").drop("lang")
    if longest > 2:
        shared = docs.sparkSession.sparkContext.broadcast(pair_filter(short))
        found = found.unionByName(entries(tuple(range(3, longest + 1)), shared).drop("lang"))
        shared.unpersist()
    # stored, so that the planner knows its size: mostly a small part of the texts have a first place
    asked = materialize(found.groupBy("row").agg(F.collect_list(F.struct("n", "place", "count")).alias("entries")))
    grams = materialize(rows.join(asked, "row").select("lang", "text", "entries")
                        .mapInArrow(tidy(_texts_at), "lang string, n int, phrase string, f long"))
    return grams, short.where("n = 0").groupBy("lang").agg(F.sum("count").alias("n"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = 80,
                 top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Candidates have 2 to ``longest`` words and a frequency ``a`` of ``least`` or more. Each cut into a
    first part and a rest of frequencies l and r scores ``floor(2000000 * a / (l + r))``; the lowest
    counts, of equal ones that with the shorter first part. A candidate goes if a longer one holds it
    that has ``share`` per cent of its frequency or more. Order: score, a (both from the top), phrase
    in the order of its bytes. ``n`` counts all words of the language.

    Null texts are empty, a null language is ``und``. Repeated rows count as often as they come. An
    empty table, or one without a frequent phrase, gives no rows.
    """
    grams, totals = frequent_phrases(docs, longest, least)
    split = grams.where("n > 1").withColumn("w", F.split("phrase", " "))
    part = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("f_part"))
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
                       F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    sides = (cuts.join(part.withColumnsRenamed({"part": "first", "f_part": "l"}), ["lang", "first"])
             .join(part.withColumnsRenamed({"part": "rest", "f_part": "r"}), ["lang", "rest"]))
    exact = F.expr("cast(2000000 * cast(a AS decimal(30, 0)) AS decimal(38, 0)) div (cast(l AS decimal(20, 0)) + r)")
    lowest = F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = sides.groupBy("lang", "phrase", "a").agg(lowest)
    inner = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), "
                   "s -> array_join(slice(w, s, m), ' '))))")
    over = (split.where("n > 2").select("lang", F.explode(inner).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    free = scored.join(over, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * cast(longer AS decimal(30, 0)) < {share} * cast(a AS decimal(30, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
