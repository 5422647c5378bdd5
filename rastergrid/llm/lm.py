"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts are quantised to levels of a geometric scale, and an n-gram is put into the filter once for
each level up to its own. A query probes level after level until one is missing, so it never reads
too low a count, and too high a one only as often as a Bloom filter errs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import (
    by_key, fold_of, pack_sorted, relieved, slice_of, slices, text_runs, texts_of, tidy, unpack_sorted)
from rastergrid.llm.encoding import listed, numbered
from rastergrid.session import materialize

HELD_OUT, FOLDS = 2, 7
END = b"\n"  # no word holds a line end; it closes a text and stands before the first word
BITS_PER_ENTRY, PROBES = 12, 6
PROBED = 1 << 14            # entries looked up at once, so that what is known of them stays in the cache
BASES = (1.1, 1.5)  # quantisation of word counts and of pair counts
SALT = np.uint64(0xD6E8FEB86659FD93)
SEGMENT_BYTES = 192 << 20
SLICE_BYTES = 4 << 20
SLICES_PER_TASK = 8
HEAD_WORDS, HEAD_CHARS = 150_000, 64
FLUSH_TOKENS = 2_000_000
FLUSH_WORDS = 300_000
SCORE_ROWS = 1024           # texts whose word pairs are looked up at once
SCORE_BYTES = 2 << 20       # bytes of text after which such a run of texts ends
LOG_TOKENS = 1 << 16        # tokens whose probabilities are worked out at once
STRENGTH = 500.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of word pairs from the keys of the words."""
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def _hashes(entries: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first probe of an entry at a level, and the step to the next ones."""
    start = _mix(entries + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return start, _mix(start + SALT) | np.uint64(1)


def _places(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits below ``sizes`` (less than 2^32) that the upper halves of the hashes stand for."""
    half = np.uint64(32)
    out = hashes >> half
    out *= sizes
    out >>= half
    return out.view(np.int64)


def filter_slice(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Bits of one slice, as bytes; its size follows the number of entries."""
    entries = np.repeat(keys, levels)
    each = np.arange(len(entries)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    size = np.uint64(max(64, -(-len(entries) * BITS_PER_ENTRY // 8) * 8))
    bits = np.zeros(int(size), bool)
    at, step = _hashes(entries, each)
    for _ in range(PROBES):
        bits[_places(at, size)] = True
        at = at + step
    return np.packbits(bits, bitorder="little")


@dataclass(frozen=True)
class Segment:
    """Slices ``first`` to ``first + len(sizes) - 1`` of all ``slices``, one after the other."""

    slices: int
    first: int
    starts: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray

    def levels(self, keys: np.ndarray, entries: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """Levels of filter entries, 0 for what is not there; the keys name the slices, and entries of
        other segments are 0 as well. ``least``: levels that entries were put in with at least, from exact
        counts; the filter never loses one, so they need no look-up and the levels found are the same."""
        out = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), PROBED):
            some = np.s_[i:i + PROBED]
            out[some] = self._levels(keys[some], entries[some], None if least is None else least[some])
        return out

    def _levels(self, keys: np.ndarray, entries: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        own = slice_of(keys, self.slices) - self.first
        out = np.zeros(len(keys), np.int64)
        left = np.flatnonzero((own >= 0) & (own < len(self.sizes)))
        left = left[self.sizes[own[left]] > 0]
        entries, sizes, starts = entries[left], self.sizes[own[left]], self.starts[own[left]]
        level = np.ones(1, np.int64)
        if least is not None:
            out[left] = least[left]
            level = out[left] + 1
        while len(left):
            at, step = _hashes(entries, level)
            hits, size, start = None, sizes, starts
            for probe in range(PROBES):
                bit = _places(at, size)
                bit += start
                shift = bit.astype(np.uint8)
                shift &= 7
                bit >>= 3
                byte = self.bits.take(bit)
                byte >>= shift
                byte &= 1
                found = np.flatnonzero(byte.view(bool))
                if len(found) < len(at):    # else all are there, as most are at the lower levels
                    hits = found if hits is None else hits.take(found)
                    at, step, size, start = (x.take(found) for x in (at, step, size, start))
                    if not len(at):
                        break
                at += step
            if hits is not None:
                left, entries, sizes, starts = left.take(hits), entries.take(hits), size, start
                level = level if least is None else level.take(hits)
            out[left] = level
            level += 1
        return out


class Words:
    """Tokens of texts as numbers of distinct words, with their 64-bit keys."""

    def __init__(self):
        self.index, self.keys = {END: 0}, np.array([xxhash.xxh3_64_intdigest(END)], np.uint64)

    def tokens(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, and of each text how many: its words and one end. Texts are cut and
        their words told apart as an array; objects exist for distinct words only."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = cut.flatten().cast(pa.binary()).dictionary_encode()
        # white space at the ends of a text leaves empty words
        full = pc.binary_length(found.dictionary).to_numpy() > 0
        names = found.dictionary.filter(pa.array(full))
        numbers = np.zeros(len(full), np.int64)
        numbers[full], new = numbered(self.index, names)
        self.keys = np.append(self.keys, np.fromiter(
            map(xxhash.xxh3_64_intdigest, listed(names.take(pa.array(new)))), np.uint64, len(new)))
        at = found.indices.to_numpy()
        kept = full[at]
        counts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        before = np.append(0, np.cumsum(kept))
        counts = before[ends] - before[ends - counts]
        return np.insert(numbers[at[kept]], np.cumsum(counts), self.index[END]), counts + 1

    def pairs(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens before, and the keys of the pairs."""
        before = np.empty_like(rows)
        before[1:] = rows[:-1]
        before[np.cumsum(counts) - counts] = self.index[END]
        return before, pair_keys(self.keys[before], self.keys[rows])


COUNTS = pa.schema([("slice", pa.int64()), ("size", pa.int32()), ("pairs", pa.binary()),
                    ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
COUNTS_SQL = "slice long, size int, pairs binary, words array<binary>, n array<long>"


def count_grams(texts: DataFrame, n_slices: int) -> DataFrame:
    """``slice, size, pairs, words, n``: for each slice of the key what a task has counted, in one row:
    packed keys and counts of word pairs, and words with their counts."""
    def pair_rows(keys, n):
        cuts = np.searchsorted(slice_of(keys, n_slices), np.arange(n_slices + 1)).tolist()
        some = [i for i in range(n_slices) if cuts[i] < cuts[i + 1]]
        packed = [pack_sorted(keys[cuts[i]:cuts[i + 1]], n[cuts[i]:cuts[i + 1]].astype(np.uint32)) for i in some]
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int64()), pa.array([cuts[i + 1] - cuts[i] for i in some], pa.int32()),
            pa.array(packed, pa.binary()), pa.nulls(len(some), COUNTS.field("words").type),
            pa.nulls(len(some), COUNTS.field("n").type)], schema=COUNTS)

    def word_rows(words, n):
        own = slice_of(words.keys, n_slices)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(n_slices + 1))
        some = np.flatnonzero(ends[1:] > ends[:-1])
        cuts = pa.array(np.append(ends[some], len(order)), pa.int32())
        names = pa.array(list(words.index), pa.binary()).take(pa.array(order))
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()),
            pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(n[order], pa.int64()))],
            schema=COUNTS)

    def run(batches):
        words, single, pairs, held = Words(), np.zeros(0, np.int64), [], 0
        for batch in slices(batches):
            tokens, counts = words.tokens(batch.column("text"))
            pairs.append(words.pairs(tokens, counts)[1])
            more = np.bincount(tokens, minlength=len(words.index))
            more[:len(single)] += single
            single, held = more, held + len(tokens)
            if held > FLUSH_TOKENS:
                yield pair_rows(*np.unique(np.concatenate(pairs), return_counts=True))
                pairs, held = [], 0
            if len(single) > FLUSH_WORDS:
                yield word_rows(words, single)
                words, single = Words(), np.zeros(0, np.int64)
        if pairs:
            yield pair_rows(*np.unique(np.concatenate(pairs), return_counts=True))
        if len(single):
            yield word_rows(words, single)

    return texts.select("text").mapInArrow(tidy(run), COUNTS_SQL)


def _build(batches):
    """Add up the counts of whole slices; one row with the bits of each, and one for each word."""
    schema = pa.schema([("slice", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("bits", pa.binary())])
    for table in by_key(batches, ["slice"]):
        numbers = table.column("slice").to_numpy()
        cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(numbers)]):
            own = table.slice(start, end - start)
            number = own.column("slice")[0].as_py()
            listed = own.filter(own.column("words").is_valid())
            single = pa.table({"word": listed.column("words").combine_chunks().flatten(),
                               "n": listed.column("n").combine_chunks().flatten()})
            single = single.group_by("word").aggregate([("n", "sum")])
            double = own.filter(own.column("pairs").is_valid())
            parts = [unpack_sorted(raw, size, np.uint32) for raw, size in zip(
                double.column("pairs").to_pylist(), double.column("size").to_pylist())]
            keys, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, n, len(keys))
            names, n_one = single.column("word").to_pylist(), single.column("n_sum").to_numpy()
            one = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            bits = filter_slice(np.concatenate([keys, _mix(one)]),
                                np.concatenate([levels_of(n, BASES[1]), levels_of(n_one, BASES[0])]))
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([None], pa.binary()), pa.array([None], pa.int64()),
                pa.array([bits.tobytes()], pa.binary())], schema=schema)
            for part in single.to_batches(max_chunksize=1 << 16):
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, number)), part.column("word"), part.column("n_sum"),
                    pa.nulls(m, pa.binary())], schema=schema)


@dataclass(frozen=True)
class Counts:
    """Stored ``slice, word, n, bits``; the tokens and distinct words learned from."""

    table: DataFrame
    slices: int
    tokens: int
    words: int

    def segments(self, most: int = SEGMENT_BYTES) -> list[tuple[int, int]]:
        """Ranges of slices whose bits have at most ``most`` bytes together (a slice at least)."""
        sizes = {r["slice"]: r["size"] for r in
                 self.table.where("bits is not null").select("slice", F.octet_length("bits").alias("size")).collect()}
        cuts, held = [0], 0
        for i in range(self.slices):
            if held and held + sizes.get(i, 0) > most:
                cuts.append(i)
                held = 0
            held += sizes.get(i, 0)
        return list(zip(cuts, [*cuts[1:], self.slices]))

    def segment(self, first: int, end: int) -> Segment:
        own = self.table.where(F.col("bits").isNotNull() & F.col("slice").between(first, end - 1))
        parts = {r["slice"]: r["bits"] for r in own.select("slice", "bits").toLocalIterator()}
        sizes = np.array([8 * len(parts.get(i, b"")) for i in range(first, end)], np.uint64)
        starts = (np.cumsum(sizes) - sizes).astype(np.int64)
        bits = np.frombuffer(b"".join(parts.get(i, b"") for i in range(first, end)), np.uint8)
        return Segment(self.slices, first, starts, sizes, bits)

    def head(self, most: int = HEAD_WORDS) -> dict[bytes, int]:
        """Exact counts of the most frequent words; ``most`` words of bounded length."""
        few = self.table.where(F.col("word").isNotNull() & (F.octet_length("word") <= HEAD_CHARS))
        rows = few.select("word", "n").orderBy(F.desc("n"), "word").limit(most).toArrow()
        return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def learn(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> Counts:
    """Count the words and word pairs of all texts of ``docs`` and build the filter, in slices by the
    key: each slice is built in one step from about ``slice_bytes`` of text, whatever the table's size."""
    texts = texts_of(docs)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_slices = max(1, -(-size // slice_bytes))
    parts = -(-n_slices // SLICES_PER_TASK)
    table = materialize(count_grams(texts, n_slices).repartition(parts, "slice").sortWithinPartitions("slice")
                        .mapInArrow(tidy(_build), "slice long, word binary, n long, bits binary"))
    total = table.where("word is not null").agg(F.sum("n"), F.count("*")).first()
    return Counts(table, n_slices, total[0] or 0, total[1])


def packed_head(head: dict[bytes, int]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Keys in order, words and counts of ``head`` in a tenth of its space; each worker holds a copy."""
    words = pa.array(list(head), pa.binary())
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, head), np.uint64, len(head))
    order = np.argsort(keys, kind="stable")
    return keys[order], words.take(pa.array(order)), np.fromiter(head.values(), np.int64, len(head))[order]


def head_counts(head: tuple[np.ndarray, pa.Array, np.ndarray], words: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Counts of words by a packed head, 0 for those it does not hold; where keys agree, the words decide."""
    known, listed, counts = head
    out = np.zeros(len(keys), np.int64)
    if len(known) and len(keys):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hits = np.flatnonzero(known[at] == keys)
        own = pa.array([words[i] for i in hits.tolist()], pa.binary())
        same = pc.equal(listed.take(pa.array(at[hits])), own).to_numpy(zero_copy_only=False).astype(bool)
        out[hits[same]] = counts[at[hits[same]]]
    return out


SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()),
    ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
PASSED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_()), ("levels", pa.binary())])
SQL_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary",
             pa.string(): "string", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def log_probabilities(word: np.ndarray, before: np.ndarray, pair: np.ndarray, tokens: int, words: int,
                      strength: float) -> np.ndarray:
    """log10 of P(word | word before) from the levels of the word, the word before and the pair.

    The pair's count is smoothed with ``strength`` imagined counts that follow the words' own add-one
    probabilities. Counts above the bar are read as the least of their level, those below as the
    most, so the probabilities of all words add up to at most 1 (but for errors of the filter).
    """
    def least(levels, base):
        return np.where(levels > 0, base ** (levels - 1.0), 0.0)

    alone = (least(word, BASES[0]) + 1) / (tokens + words + 1)
    context = np.where(before > 0, BASES[0] ** before.astype(float), 0.0)
    together = np.minimum(least(pair, BASES[1]), context)
    return np.log10((together + strength * alone) / (context + strength))


def _score_pass(shared, tokens: int, words_seen: int, strength: float, last: bool):
    """One pass over the texts with one segment. Earlier passes hand on the levels found so far; the
    last one has them all. Words with exact counts are looked up from their own level on: frequent ones
    have a hundred and more, and the more the larger the corpus."""

    def run(batches):
        parts, head = shared.value
        segment, names = Segment(*parts), []
        words, part, row = Words(), TaskContext.get().partitionId(), 0
        level, count = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        for batch in relieved(text_runs(batches, SCORE_ROWS, SCORE_BYTES), 4):
            if len(words.index) > FLUSH_WORDS:
                words, level, count, names = Words(), np.zeros(0, np.uint16), np.zeros(0, np.int64), []
            at, counts = words.tokens(batch.column("text"))
            fresh = words.keys[len(level):]
            names += islice(words.index, len(names), None)
            count = np.append(count, head_counts(head, names[len(count):], fresh))
            exact = count[len(level):]
            least = np.where(exact > 0, levels_of(np.maximum(exact, 1), BASES[0]), 0)
            level = np.append(level, segment.levels(fresh, _mix(fresh), least).astype(np.uint16))
            distinct, back = np.unique(words.pairs(at, counts)[1], return_inverse=True)
            one, two = level[at], segment.levels(distinct, distinct).astype(np.uint16)[back]
            del distinct, back
            firsts = np.cumsum(counts) - counts
            if "levels" in batch.schema.names:
                known = np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint16).reshape(-1, 2)
                one, two = one | known[:, 0], two | known[:, 1]
            if not last:
                both = np.stack([one, two], axis=1)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in ("doc_id", "text", "held_out")),
                    pa.array([both[a:a + n].tobytes() for a, n in zip(firsts.tolist(), counts.tolist())],
                             pa.binary())], schema=PASSED)
                continue
            # the word before the first of a text is the end, as at the last place of any text
            ahead = np.empty_like(one)
            ahead[1:] = one[:-1]
            ahead[firsts] = one[firsts + counts - 1]
            logs = np.empty(len(at))
            for i in range(0, len(at), LOG_TOKENS):
                some = np.s_[i:i + LOG_TOKENS]
                logs[some] = log_probabilities(one[some], ahead[some], two[some], tokens, words_seen, strength)
            del ahead, two
            exact = count[at]
            left = np.flatnonzero((exact == 0) & (one > 0))
            text = np.repeat(np.arange(len(counts)), counts)[left]
            both, often = np.unique(text * len(names) + at[left], return_counts=True)
            cuts = pa.array(np.searchsorted(both, np.arange(len(counts) + 1) * len(names)), pa.int32())
            rare = pa.ListArray.from_arrays(cuts, pa.array([names[w] for w in (both % len(names)).tolist()], pa.binary()))
            times = pa.ListArray.from_arrays(cuts, pa.array(often, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + row + np.arange(len(counts))), batch.column("doc_id"),
                batch.column("held_out"), pa.array(counts),
                pa.array(np.add.reduceat((exact > 0).astype(np.int64), firsts)),
                pa.array(np.add.reduceat(np.log10(exact + 1.0), firsts)),
                pa.array(np.add.reduceat(logs, firsts)),
                rare, times], schema=SCORED)
            row += len(counts)

    return run


def score(docs: DataFrame, counts: Counts, strength: float = STRENGTH, segment_bytes: int = SEGMENT_BYTES,
          head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The filter goes to the workers in segments of at most ``segment_bytes``, one pass over the texts
    for each, so what is broadcast never grows with the corpus; with one segment there is one pass.
    ``score`` sums the smoothed log10 probabilities of all tokens; at each place those of all words
    add up to 1 or less. ``base_score`` needs exact word
    counts: the ``head_words`` most frequent words are broadcast, all others are joined; words that
    the filter has never seen cannot match and stay at home.

    Null texts are empty texts of one token, the end. A null doc_id is not held out. Repeated rows
    are scored alike. Without any training text all counts are 0.
    """
    spark = docs.sparkSession
    held = fold_of(docs["doc_id"], FOLDS) == HELD_OUT
    rows = texts_of(docs, held.alias("held_out"))
    ranges, head = counts.segments(segment_bytes), packed_head(counts.head(head_words))
    for i, (first, end) in enumerate(ranges):
        last = i == len(ranges) - 1
        # parts of the segment, not the segment: a broadcast names classes and does not carry them
        parts = tuple(vars(counts.segment(first, end)).values())
        shared = spark.sparkContext.broadcast((parts, head))
        run = _score_pass(shared, counts.tokens, counts.words, strength, last)
        rows = materialize(rows.mapInArrow(tidy(run), _ddl(SCORED if last else PASSED)))
        shared.unpersist()
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    known = counts.table.where("word is not null").select("word", "n")
    found = (rare.join(known, "word").groupBy("row")
             .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs")))
    whole = float(np.log10(counts.tokens + counts.words + 1))
    return rows.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score")


def learn_and_score(docs: DataFrame, strength: float = STRENGTH, segment_bytes: int = SEGMENT_BYTES,
                    head_words: int = HEAD_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``score`` of all rows by a model of those whose fold is not held out."""
    training = docs.where(fold_of(docs["doc_id"], FOLDS) != HELD_OUT)
    return score(docs, learn(training, slice_bytes), strength, segment_bytes, head_words)
