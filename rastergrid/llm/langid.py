"""Language ID by unigram piece models: all segmentations of a word are summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import fold_of, fresh, slices, texts_of, tidy
from rastergrid.llm.encoding import _Index
from rastergrid.session import materialize

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
WORD_CHARS = 32  # longer runs of letters are several words, so that products stay above the least double
UNKNOWN = 1e-8
BATCH = 4096
MOST_LANGUAGES = 1024
HELD_OUT, FOLDS = 2, 4


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-case letter pieces of a public SentencePiece vocabulary, with and without word mark."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip))
    return [p for p in pieces if p == MARK or (p.lstrip(MARK).isalpha() and p == p.lower() and MARK not in p[1:])]


def words_of(token: str) -> list[str]:
    """Marked lower-case words: the runs of letters of a token, long ones in parts."""
    return [MARK + run[i:i + WORD_CHARS] for run in LETTERS.findall(token.lower())
            for i in range(0, len(run), WORD_CHARS)]


@dataclass(frozen=True)
class Lattice:
    """Piece numbers of all substrings. ``ids[b, j, l]`` is the piece of length ``l + 1`` that ends
    before position ``j`` of word ``b``; 0 is none, the last number an unknown character."""

    ids: np.ndarray
    sizes: np.ndarray


class PieceIndex:
    """Numbers of pieces (from 1) by a polynomial hash of their characters, looked up for whole arrays
    in a few open tables; a piece whose slot is taken goes to the next table."""

    BASE = 0x9E3779B97F4A7C15
    SLOT_BITS = (18, 16, 16)

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.powers = np.array([pow(self.BASE, i, 1 << 64) for i in range(self.longest)], np.uint64)
        self.keys = np.array([0] + [self._hash(p) for p in pieces], np.uint64)
        self.tables, rest, t = [], np.arange(1, len(pieces) + 1), 0
        while len(rest):
            bits = self.SLOT_BITS[min(t, len(self.SLOT_BITS) - 1)]
            factor, shift = np.uint64(self.BASE + 2 * t), np.uint64(64 - bits)
            slots, first = np.unique((self.keys[rest] * factor) >> shift, return_index=True)
            table = np.zeros(1 << bits, np.int32)
            table[slots] = rest[first]
            self.tables.append((factor, shift, table))
            rest, t = np.delete(rest, first), t + 1

    def _hash(self, piece: str) -> int:
        codes = np.array([ord(c) for c in reversed(piece)], np.uint64)
        return int((codes * self.powers[:len(codes)]).sum())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape, np.int32)
        for factor, shift, table in self.tables:
            slot = table[(hashes * factor) >> shift]
            out += np.where(self.keys[slot] == hashes, slot, 0)
        return out


def lattice(words: list[str], index: PieceIndex) -> Lattice:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.max())
    codes = np.zeros((len(words), n), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), sizes)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    ids = np.zeros((len(words), n + 1, index.longest), np.int32)
    hashes = np.zeros_like(codes)
    for size in range(1, min(index.longest, n) + 1):
        hashes[:, size - 1:] += codes[:, :n - size + 1] * index.powers[size - 1]
        ids[:, size:, size - 1] = index.find(hashes[:, size - 1:])
    one = ids[:, 1:, 0]
    one[one == 0] = index.size + 1
    return Lattice(ids, sizes)


def forward(grid: Lattice, table: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: words x positions x languages. ``table`` has the
    probabilities of pieces (rows, the first is 0) in each language."""
    b, n, longest = grid.ids.shape
    alpha = np.zeros((b, n, table.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n):
        k = min(j, longest)
        alpha[:, j] = np.einsum("bkl,bkl->bl", alpha[:, j - k:j][:, ::-1], table[grid.ids[:, j, :k]])
    return alpha


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Positions of words of like length, a few thousand at a time."""
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(order), BATCH):
        yield order[at:at + BATCH]


def log_scores(words: list[str], index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for some in batches_of(words):
        grid = lattice([words[i] for i in some], index)
        total = forward(grid, table)[np.arange(len(some)), grid.sizes]
        out[some] = np.log(np.maximum(total, 1e-300))
    return out


def expected(words: list[str], language: np.ndarray, counts: np.ndarray, index: PieceIndex,
             table: np.ndarray) -> np.ndarray:
    """Expected piece counts (languages x pieces) of counted words under the present model."""
    rows, languages = table.shape
    out = np.zeros(languages * rows)
    flat = np.ascontiguousarray(table.T).ravel()
    for some in batches_of(words):
        grid = lattice([words[i] for i in some], index)
        base = (language[some] * rows)[:, None]
        b, n, longest = grid.ids.shape
        alpha, beta = np.zeros((b, n)), np.zeros((b, n))
        alpha[:, 0] = 1
        for j in range(1, n):
            k = min(j, longest)
            alpha[:, j] = (alpha[:, j - k:j][:, ::-1] * flat[base + grid.ids[:, j, :k]]).sum(axis=1)
        beta[np.arange(b), grid.sizes] = 1
        weight = counts[some] / np.maximum(alpha[np.arange(b), grid.sizes], 1e-300)
        for j in range(n - 1, 0, -1):
            k = min(j, longest)
            at = base + grid.ids[:, j, :k]
            step = flat[at] * beta[:, j:j + 1]
            out += np.bincount(at.ravel(), (step * alpha[:, j - k:j][:, ::-1] * weight[:, None]).ravel(), len(out))
            beta[:, j - k:j] += step[:, ::-1]
    return out.reshape(languages, rows)


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """``lang, word, n`` over whole texts; tasks add up their own words first."""
    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            rows: Counter = Counter()
            for lang, tokens in held.items():
                for token, n in tokens.items():
                    for word in words_of(token):
                        rows[lang, word] += n
            held.clear()
            keys = list(rows)
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()),
                                               "word": pa.array([k[1] for k in keys], pa.string()),
                                               "n": pa.array(list(rows.values()), pa.int64())})

        for batch in slices(batches, 64):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(text.replace("\n", " ").split(" "))
            if sum(map(len, held.values())) > flush:
                yield out()
        yield out()

    texts = texts_of(docs, docs["lang"].cast("string").alias("lang")).select("text", "lang")
    return (texts.mapInArrow(tidy(run), "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class Model:
    """Languages, pieces and their probabilities (pieces + 2 rows, one column per language)."""

    languages: list[str]
    pieces: list[str]
    table: np.ndarray

    def predictor(self, spark, evidence: bool = False):
        """Column function from text to ``lang_pred, score``: the best language and its posterior with
        equal priors; ``und`` and 0 for null texts, texts without a letter, and an empty model. With
        ``evidence`` also by how much (log) that language explains the text better than pieces that
        are all equally likely."""
        # parts of the model, not the model: a broadcast names classes and does not carry them
        shared = spark.sparkContext.broadcast((self.languages, self.pieces, self.table))

        def run(parts):
            scorer = Scorer(Model(*shared.value), evidence)
            for texts in parts:
                yield pd.concat([scorer(texts[i:i + 512]) for i in range(0, max(len(texts), 1), 512)])

        @F.pandas_udf("lang_pred string, score double" + ", evidence double" * evidence)
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from tidy(run)(parts)

        return predict


class Scorer:
    """Scores texts and remembers the scores of their tokens."""

    def __init__(self, model: Model, evidence: bool = False, limit: int = 300_000):
        self.model, self.evidence, self.limit = model, evidence, limit
        self.index, self.table = PieceIndex(model.pieces), model.table
        if evidence:
            self.table = np.column_stack([model.table, first_table(len(model.pieces), 1)])
        self._forget()

    def _forget(self) -> None:
        self.tokens = _Index()
        self.scores = np.empty((1024, self.table.shape[1] + 1))

    def _learn(self) -> None:
        """The last column counts letters."""
        new, self.tokens.fresh = self.tokens.fresh, []
        if len(self.tokens) > len(self.scores):
            grown = np.empty((2 * len(self.tokens), self.scores.shape[1]))
            grown[:len(self.scores)] = self.scores
            self.scores = grown
        words = _Index()
        owner, rows = [], []
        for i, token in enumerate(new):
            for word in words_of(token):
                owner.append(i)
                rows.append(words[word])
        own = log_scores(list(words), self.index, self.table)
        out = self.scores[len(self.tokens) - len(new):len(self.tokens)]
        out[:] = 0
        np.add.at(out[:, :-1], np.array(owner, np.int64), own[np.array(rows, np.int64)])
        out[:, -1] = [any(map(str.isalpha, t)) for t in new]

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        languages = self.model.languages
        if not len(texts) or not languages:
            none = {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "evidence": [0.0] * len(texts)}
            return pd.DataFrame(none)[list(none)[:2 + self.evidence]]
        if len(self.tokens) > self.limit:
            self._forget()
        tokens, counts = [], []
        for text in texts:
            own = text.replace("\n", " ").split(" ") if isinstance(text, str) else [""]
            counts.append(len(own))
            tokens += own
        rows = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        if self.tokens.fresh:
            self._learn()
        total = np.add.reduceat(self.scores[rows], np.cumsum(counts) - counts, axis=0)
        logs, letters = total[:, :len(languages)], total[:, -1] > 0
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        out = pd.DataFrame({"lang_pred": np.where(letters, np.array(languages, object)[best], "und"),
                            "score": np.where(letters, posterior, 0.0)})
        if self.evidence:
            out["evidence"] = np.where(letters, logs.max(axis=1) - total[:, len(languages)], 0.0)
        return out


def first_table(pieces: int, languages: int) -> np.ndarray:
    """Equal probabilities of all pieces."""
    table = np.zeros((pieces + 2, languages))
    table[1:-1], table[-1] = 1 / max(pieces, 1), UNKNOWN
    return table


def train(docs: DataFrame, vocab: str | None = None, rounds: int = 2, smoothing: float = 0.1) -> Model:
    """Piece probabilities per language from all rows with a language: word counts, then ``rounds`` of
    expectation and maximisation from equal probabilities. Tasks send at most one number for each
    piece and language, and so does the driver get; more than 1024 languages raise."""
    spark = docs.sparkSession
    pieces = vocabulary(vocab)
    counted = materialize(count_words(docs.where(docs["lang"].isNotNull())))
    found = docs.where(docs["lang"].isNotNull()).select(docs["lang"].cast("string").alias("lang")).distinct()
    languages = sorted(r["lang"] for r in found.limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {lang: i for i, lang in enumerate(languages)}
    table = first_table(len(pieces), len(languages))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(table)

        def run(batches, shared=shared):
            total, index = np.zeros(shared.value.T.shape), PieceIndex(pieces)
            for batch in slices(batches, 1 << 16):
                language = np.fromiter((number[x] for x in batch.column("lang").to_pylist()), np.int64)
                total += expected(batch.column("word").to_pylist(), language, batch.column("n").to_numpy(),
                                  index, shared.value)
            language, piece = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"l": pa.array(language, pa.int32()), "p": pa.array(piece, pa.int32()),
                                              "n": pa.array(total[language, piece])})

        sums = (counted.repartition("word").mapInArrow(tidy(run), "l int, p int, n double")
                .groupBy("l", "p").agg(F.sum("n").alias("n")).toArrow())
        counts = np.zeros(table.shape)
        counts[sums.column("p").to_numpy(), sums.column("l").to_numpy()] = sums.column("n").to_numpy()
        seen = counts[1:-1] + smoothing
        table = table.copy()
        table[1:-1] = seen / seen.sum(axis=0)
        shared.unpersist()
    return Model(languages, pieces, table)


def held_out(docs: DataFrame) -> Column:
    return fold_of(docs["doc_id"], FOLDS) == HELD_OUT


def identify(docs: DataFrame, vocab: str | None = None, rounds: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``, by a model of the rows whose
    fold is not held out. Rows without a language teach nothing; a null doc_id is not held out."""
    model = train(docs.where(~held_out(docs)), vocab, rounds)
    predict = model.predictor(docs.sparkSession)
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs).alias("held_out"),
                        predict(docs["text"].cast("string")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, least_evidence: float = 0.0, vocab: str | None = None,
                    rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language: one that explains it better than
    pieces that are all equally likely, by more than ``least_evidence`` (log). How alike the learned
    languages are does not matter, only the text does. All columns stay.

    Null and empty texts and texts without a letter go. Repeated rows stay repeated. Where no row
    has a language there is nothing to judge by, and all rows stay.
    """
    model = train(docs.where(~held_out(docs)), vocab, rounds)
    if not model.languages:
        return docs
    name = fresh(docs, "found")
    rows = docs.withColumn(name, model.predictor(docs.sparkSession, evidence=True)(docs["text"].cast("string")))
    known = (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.evidence") > least_evidence)
    return rows.where(known).drop(name)
