"""Ids of whole texts by the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import string
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rastergrid.llm.common import ragged

ENDINGS = string.punctuation
PLAIN = "^[a-zß-öø-ÿ]+$"  # words that NFC and lower-casing leave as they are
LINE_WORDS = 1000        # words of letters that go through the library as one text


class _Index(dict):
    """Numbers keys in order of arrival and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


def listed(words: pa.Array) -> list:
    """What ``to_pylist`` gives for texts without nulls, in a fifth of its time."""
    return words.to_numpy(zero_copy_only=False).tolist()


def numbered(index: dict, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct words (binary), and the positions of those that are new to the index."""
    names = listed(words)
    numbers = np.fromiter(map(index.get, names, repeat(-1)), np.int64, len(names))
    new = np.flatnonzero(numbers < 0)
    first = len(index)
    numbers[new] = np.arange(first, first + len(new))
    index.update(zip(map(names.__getitem__, new.tolist()), range(first, first + len(new))))
    return numbers, new


def suffixes(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last ``sizes`` bytes of each word."""
    _, offsets, raw = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset + 1:words.offset + len(words) + 1].astype(np.int64)
    own = np.frombuffer(raw or b"", np.uint8)[ragged(ends - sizes, sizes)]
    return pa.Array.from_buffers(words.type, len(words), [
        None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(own)])


class _Pool:
    """Id sequences by number, one after the other in one array."""

    def __init__(self):
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids.astype(np.uint32))

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[rows], self.sizes[rows])]


def drops_spaces(spec: str) -> bool:
    """Whether white space only separates words for this tokenizer and never becomes an id, so that
    the ids of a text are those of its words, one after the other."""
    rule = json.loads(spec)
    steps = (rule.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (first.get("type") == "Split" and first.get("invert") is True
            and first.get("behavior") == "Removed" and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
            and rule.get("post_processor") is None and rule["model"].get("end_of_word_suffix") == "</w>"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rule["added_tokens"]))


def keeps_letters(spec: str) -> bool:
    """Whether a word of ``PLAIN`` reaches the model of this tokenizer whole, byte by byte."""
    rule = json.loads(spec)
    steps = (rule.get("normalizer") or {}).get("normalizers") or [{}]
    first, *others = (rule.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (all(x.get("type") in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": r"\s+"} for x in steps)
            and (first.get("pattern") or {}).get("Regex", "").startswith(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|")
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in others] == [("ByteLevel", False, False)])


class TextEncoder:
    """``encode(texts)`` equals the library's ``encode_batch(texts, add_special_tokens=False)``.

    Where white space only separates words, texts are cut at spaces and line ends, and every
    distinct word goes through the library once. At most ``limit`` words are remembered; then the
    memory starts anew. Other tokenizers get the whole texts.
    """

    def __init__(self, spec: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_word = drops_spaces(spec)
        self.limit = limit
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        closing = [piece for piece in vocab if piece.endswith("</w>")]
        self.ends[[vocab[piece] for piece in closing]] = True
        # Where every byte has a closing piece, no word of letters is without one.
        self.closes = sum(len(piece) == len("</w>") + 1 for piece in closing) >= 256
        if hasattr(self.tokenizer.model, "_resize_cache"):  # words come once, a second memory costs time
            self.tokenizer.model._resize_cache(0)
        # The same model without the steps that do nothing to plain words and take half the time.
        self.plain = self.tokenizer
        if keeps_letters(spec):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids = {}, _Pool()
        self.parts, self.part_ids = {}, _Pool()

    def _library(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _letter_words(self, words: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, many in one text: each ends with an id that closes a word. A word that
        normalising splits has several such ids; the words of its line are encoded one by one."""
        lines = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        ids, sizes = self._library([" ".join(line) for line in lines], tokenizer)
        all_ids, all_sizes = [], []
        for line, own in zip(lines, np.split(ids, np.cumsum(sizes)[:-1])):
            counts = np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
            if len(counts) != len(line):
                own, counts = self._library(line)
            all_ids.append(own)
            all_sizes.append(counts)
        return np.concatenate(all_ids), np.concatenate(all_sizes)

    def _learn(self, words: pa.Array) -> None:
        """Encode new words: a word is a core and the punctuation behind it."""
        core = pc.utf8_rtrim(words, characters=ENDINGS)
        # A letter that normalising ends in a mark keeps the punctuation behind it.
        letters = pc.and_not(pc.utf8_is_alpha(pc.utf8_normalize(core, "NFC")), pc.match_substring(core, "İ"))
        letters = letters.to_numpy(zero_copy_only=False)
        cut = letters.copy()
        other = np.flatnonzero(~letters)
        for i, word, own in zip(other.tolist(), *(listed(x.take(pa.array(other))) for x in (words, core))):
            cut[i] = unicodedata.normalize("NFC", own[-1:]).lower()[-1:].isalpha() and "<|" not in word
        small = letters | (cut & pc.string_is_ascii(core).to_numpy(zero_copy_only=False))
        heads = pc.if_else(pa.array(small), pc.ascii_lower(core), pc.if_else(pa.array(cut), core, words))
        tails = (pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()) * cut
        both = pa.concat_arrays([heads, suffixes(words, tails.astype(np.int64))]).dictionary_encode()
        numbers, new = numbered(self.parts, both.dictionary.cast(pa.binary()))
        if len(new):
            parts = both.dictionary.take(pa.array(new))
            alpha, plain = pc.utf8_is_alpha(parts), pc.match_substring_regex(parts, PLAIN)
            # 0: plain words, 1: other words of letters, 2: all else
            kind = 2 - self.closes * (alpha.to_numpy(zero_copy_only=False).astype(np.int64)
                                      + plain.to_numpy(zero_copy_only=False))
            order = np.argsort(kind, kind="stable")
            names, ends = listed(parts.take(pa.array(order))), np.cumsum(np.bincount(kind, minlength=3))
            some = names[:ends[0]], names[ends[0]:ends[1]], names[ends[1]:]
            found = []
            if some[0]:
                found.append(self._letter_words(some[0], self.plain))
            if some[1]:
                found.append(self._letter_words(some[1]))
            if some[2]:
                found.append(self._library(some[2]))
            ids, sizes = (np.concatenate(x) for x in zip(*found))
            starts, back = np.cumsum(sizes) - sizes, np.argsort(order)
            self.part_ids.add(ids[ragged(starts[back], sizes[back])], sizes[back])
        # core and punctuation of a word, one after the other
        pairs = numbers[both.indices.to_numpy()].reshape(2, -1).T.ravel()
        sizes = self.part_ids.sizes[pairs]
        self.word_ids.add(self.part_ids.take(pairs), sizes[::2] + sizes[1::2])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if not len(texts) or not self.by_word:
            return self._library(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        if len(self.words) > self.limit:
            self._forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = cut.flatten().dictionary_encode()
        numbers, new = numbered(self.words, found.dictionary.cast(pa.binary()))
        if len(new):
            self._learn(found.dictionary.take(pa.array(new)))
        rows = numbers[found.indices.to_numpy()]
        counts = pc.list_value_length(cut).to_numpy()
        firsts = np.cumsum(counts) - counts
        return self.word_ids.take(rows), np.add.reduceat(self.word_ids.sizes[rows], firsts)


def read_spec(path: str | None = None) -> str:
    """The tokenizer's file as text; by default the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
