"""SentencePiece encoding by a Viterbi search that words with a common prefix share."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.llm.common import ragged, relieved, text_runs, texts_of, tidy
from rastergrid.llm.encoding import _Pool, listed, numbered

MARK = "▁"
WAITING_WORDS = 2_000_000      # words of texts that wait, as numbers, for their new words to be searched together
HELD_BYTES = 32 << 20          # bytes of the words that are remembered
RUN_CHARS = 1 << 20            # characters of sorted words that are searched at a time
FEW = 256                      # of those, words as long as so many at least go by depth, longer ones one by one
#: Where a Latin letter meets ASCII punctuation or a digit.
BORDER = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-@\[-`{-~])")
LINES = re.compile(r"(?s)\n.|.\n")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _bytes_of(pattern: str) -> np.ndarray:
    """By byte, whether its character fits."""
    return np.array([re.fullmatch(pattern, chr(b)) is not None for b in range(256)])


LETTER, OTHER = _bytes_of("[A-Za-z]"), _bytes_of(r"[!-@\[-`{-~]")
#: The second bytes, behind 0xC3, of the letters from À to ÿ.
SECOND = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


class _Table:
    """Numbers by key (64 bits, not negative), put in and looked up as arrays."""

    def __init__(self, keys=(), values=()):
        self.size, self.keys, self.values = 0, np.full(2, -1, np.int64), np.zeros(2, np.int32)
        self.put(np.array(keys, np.int64), np.array(values, np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.keys).bit_length() - 1
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 3 * (self.size + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.append(keys, self.keys[old]), np.append(values, self.values[old])
            room = 1 << (3 * len(keys)).bit_length()
            self.size, self.keys, self.values = 0, np.full(room, -1, np.int64), np.zeros(room, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            own = self.keys[at[left]] == keys[left]
            self.values[at[left[own]]] = values[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.size += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 where a key is not there."""
        at = self._home(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            own = there == keys[left]
            found[left[own]] = self.values[at[left[own]]]
            left = left[~own & (there >= 0)]
        return found


class _Ends:
    """What stands at one end of pieces while merging builds them: parts, and scores of the merges that take them up."""

    def __init__(self, n: int):
        self.starts, self.sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.parts, self.scores = np.empty(0, np.int64), np.empty(0)

    def add(self, pieces: list[int], ends: list[list[tuple[int, float]]]) -> None:
        sizes = np.array([len(x) for x in ends], np.int64)
        self.starts[pieces], self.sizes[pieces] = len(self.parts) + np.cumsum(sizes) - sizes, sizes
        self.parts = np.append(self.parts, np.array([part for x in ends for part, _ in x], np.int64))
        self.scores = np.append(self.scores, [score for x in ends for _, score in x])


class Vocabulary:
    """Pieces with scores, byte pieces, and the steps in which merging builds a piece."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int]):
        self.pieces = pieces
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := BYTE.fullmatch(p))}
        skip = special | set(self.bytes.values())
        self.ids = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.scores, self.special = scores, special
        self.longest = max(map(len, self.ids), default=1)
        #: The greatest length of a piece by its last three characters; others have two at most.
        self.ending: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 2:
                self.ending[p[-3:]] = max(len(p), self.ending.get(p[-3:], 0))
        self.crossed = any(BORDER.search(p) for p in self.ids)
        self.lined = not any(LINES.search(p) for p in self.ids)
        self._edges: dict[str, tuple | None] = {}

    @classmethod
    def load(cls, proto: bytes) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = range(model.get_piece_size())
        special = {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], special)

    def edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and at the right end while merging builds ``piece``, as pairs
        (part, score of the merge that takes it up); None if merging builds something else."""
        if piece not in self._edges:
            parts, left, right = list(piece), [], []
            while len(parts) > 1:
                best, at = max(((self.scores[i], -k) for k in range(len(parts) - 1)
                                if (i := self.ids.get(parts[k] + parts[k + 1])) is not None),
                               default=(None, None))
                if best is None:
                    break
                at = -at
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            built = len(parts) == 1
            self._edges[piece] = (left + [(piece, -math.inf)], right + [(piece, -math.inf)]) if built else None
        return self._edges[piece]

    def stays(self, first: str, second: str) -> bool:
        """Whether merging leaves these two neighbours apart: no merge across them comes before the
        merges that build them (of equal merges the left one comes first)."""
        for x, x_ends in self.edges(first)[1]:
            for y, y_ends in self.edges(second)[0]:
                i = self.ids.get(x + y)
                if i is not None and self.scores[i] > x_ends and self.scores[i] >= y_ends:
                    return False
        return True


class Viterbi:
    """Best segmentations of words, forward over all prefixes.

    For a ``unigram`` vocabulary the forward score of a prefix is the largest sum of piece scores.
    For ``bpe`` the scores order merges and do not add up; there a path is allowed if each two
    neighbours stay apart under merging, which exactly one path is, and the forward score of a
    prefix is 0 on that path. The state kept for a prefix is its score and its last piece.
    """

    def __init__(self, vocabulary: Vocabulary, kind: str = "bpe"):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind {kind!r}")
        self.v, self.kind = vocabulary, kind
        self.known: dict[tuple[str, str], bool] = {}
        self.unknown = min(vocabulary.scores, default=0.0) - 10.0
        self._tables()

    def _tables(self) -> None:
        """The vocabulary as arrays. Pieces are a trie whose states also know where to go on when no piece goes
        on (``fail``), the longest piece that ends there, and the next shorter piece that ends a piece."""
        ids, n = self.v.ids, len(self.v.pieces)
        heads = sorted({p[:k] for p in ids for k in range(1, len(p) + 1)}, key=len)
        state = {h: i for i, h in enumerate(["", *heads])}
        fail, longest, shorter = [0], [-1], [-1] * n
        for h in heads:
            k = 1
            while (f := state.get(h[k:])) is None:
                k += 1
            fail.append(f)
            longest.append(ids.get(h, longest[f]))
            if h in ids:
                shorter[ids[h]] = longest[f]
        self.steps = _Table([state[h[:-1]] << 21 | ord(h[-1]) for h in heads], range(1, len(state)))
        self.fail, self.longest, self.shorter = (np.array(x, np.int64) for x in (fail, longest, shorter))
        self.width = np.array([len(p) for p in self.v.pieces], np.int64)
        self.scores = np.array(self.v.scores, np.float64)
        rank = {p: i for i, p in enumerate(sorted(ids))}
        self.rank = np.array([rank.get(p, -1) for p in self.v.pieces], np.int64)
        # parts are pieces or characters of pieces
        self.number = dict(ids)
        for c in sorted({c for p in ids for c in p}):
            self.number.setdefault(c, n + len(self.number) - len(ids))
        self.room = n + len(self.number) - len(ids) + 1
        merges = {x * self.room + y: i for p, i in ids.items() for k in range(1, len(p))
                  if (x := self.number.get(p[:k])) is not None and (y := self.number.get(p[k:])) is not None}
        self.merges = _Table(list(merges), list(merges.values()))
        self.left, self.right = _Ends(n), _Ends(n)
        self.asked, self.built = np.zeros(n, bool), np.zeros(n, bool)
        self.pairs = _Table()

    def _ask(self, pieces: np.ndarray) -> None:
        """Note the ends of pieces that were not met before."""
        new = np.unique(pieces[~self.asked[pieces]]).tolist()
        if not new:
            return
        self.asked[new] = True
        found = {i: edges for i in new if (edges := self.v.edges(self.v.pieces[i])) is not None}
        self.built[list(found)] = True
        for k, side in enumerate((self.left, self.right)):
            side.add(list(found), [[(self.number[part], score) for part, score in edges[k]] for edges in found.values()])

    def _stay(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``_apart`` for many pairs of ids; -1 as the first is no piece, or the beginning."""
        self._ask(np.concatenate([first[first >= 0], second]))
        allowed = self.built[second]
        own = np.flatnonzero(allowed & (first >= 0))
        x, y = first[own], second[own]
        wide = self.left.sizes[y]
        sizes = self.right.sizes[x] * wide
        pair = np.repeat(np.arange(len(own)), sizes)
        nth = ragged(np.zeros(len(own), np.int64), sizes)
        at_x = self.right.starts[x][pair] + nth // wide[pair]
        at_y = self.left.starts[y][pair] + nth % wide[pair]
        merged = self.merges.get(self.right.parts[at_x] * self.room + self.left.parts[at_y])
        score = self.scores[merged]
        allowed[own[pair[(merged >= 0) & (score > self.right.scores[at_x]) & (score >= self.left.scores[at_y])]]] = False
        return allowed

    def _apart_all(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``_apart`` for many pairs of ids, each distinct pair decided once."""
        keys = (first + 1) * self.room + second
        found = self.pairs.get(keys)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            new = np.unique(keys[unknown])
            allowed = self._stay(new // self.room - 1, new % self.room)
            if self.pairs.size > 400_000:
                self.pairs = _Table()
            self.pairs.put(new, allowed.astype(np.int32))
            found[unknown] = allowed[np.searchsorted(new, keys[unknown])]
        return found > 0

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that follow: the longest ends of the prefixes that begin a piece."""
        state, out, left = state.copy(), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(left):
            to = self.steps.get(state[left] << 21 | char[left])
            out[left] = np.maximum(to, 0)
            left = left[(to < 0) & (state[left] > 0)]
            state[left] = self.fail[state[left]]
        return out

    def _by_depth(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``search`` of sorted words, which are a trie in depth-first order: all prefixes of one length at a
        time, each distinct prefix once."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        places = starts + np.arange(n)                        # in path, where the empty prefix has a place too
        path = np.zeros(len(text) + n, np.int32)              # the node of each prefix of each word
        state, last, count = (np.zeros(len(text) + 1, np.int32) for _ in range(3))
        score = np.zeros(len(text) + 1 if self.kind == "unigram" else 0)
        last[0], total = -1, 1
        alive, node = np.arange(n), np.zeros(n, np.int64)
        for j in range(int(sizes.max(initial=0))):
            keep = sizes[alive] > j
            alive, node = alive[keep], node[keep]
            char = text[starts[alive] + j].astype(np.int64)
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            heads = np.flatnonzero(new)
            parent, place, nodes = node[heads], places[alive[heads]] + j + 1, slice(total, total + len(heads))
            state[nodes] = own = self._step(state[parent].astype(np.int64), char[heads])
            piece, above = np.full(len(heads), -1, np.int64), parent.copy()
            best = score[parent] + self.unknown if self.kind == "unigram" else None
            option = self.longest[own]
            left = np.flatnonzero(option >= 0)
            while len(left):
                tried = option[left]
                up = path[place[left] - self.width[tried]]
                if self.kind == "bpe":
                    better = self._apart_all(last[up].astype(np.int64), tried)
                    rest = ~better
                else:
                    sums, so_far = score[up] + self.scores[tried], piece[left]
                    better = (so_far < 0) | (sums > best[left]) | (
                        (sums == best[left]) & (self.rank[tried] > self.rank[so_far]))
                    best[left[better]] = sums[better]
                    rest = np.ones(len(left), bool)
                piece[left[better]], above[left[better]] = tried[better], up[better]
                left, shorter = left[rest], self.shorter[tried[rest]]
                option[left] = shorter
                left = left[shorter >= 0]
            if self.kind == "bpe":  # a character stands alone, piece or not, where nothing else may end
                alone = np.flatnonzero((piece < 0) & (self.longest[own] >= 0))
                piece[alone] = [self.v.ids.get(chr(c), -1) for c in char[heads[alone]].tolist()]
            last[nodes], count[nodes] = piece, count[above] + 1
            if best is not None:
                score[nodes] = best
            node = np.cumsum(new) + (total - 1)
            path[places[alive] + j + 1] = node
            total += len(heads)
        # back from the ends of the words
        counts = count[path[places + sizes]].astype(np.int64)
        codes, stop = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        rows, at = np.arange(n), sizes
        while True:
            rows, at, stop = rows[at > 0], at[at > 0], stop[at > 0] - 1
            if not len(rows):
                return codes, counts
            piece = last[path[places[rows] + at]]
            codes[stop] = np.where(piece < 0, -1 - text[starts[rows] + at - 1].astype(np.int64), piece)
            at = at - np.where(piece < 0, 1, self.width[piece])

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of all words, one word after the other, and their number in each word; -1 less the
        code point for a character that is no piece."""
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))[order]
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // RUN_CHARS)) + 1
        rows, codes, counts = [], [], []
        for run, sizes in zip(np.split(order, cuts), np.split(lengths, cuts)):
            depth = np.sort(sizes)[-FEW] if len(run) >= FEW else -1
            short, long = run[sizes <= depth], run[sizes > depth]
            own, own_counts = self._by_depth([words[i] for i in short.tolist()])
            found = list(self._one_by_one([words[i] for i in long.tolist()]))
            more = [self.v.ids.get(p, -1 - ord(p[0])) for _, parts in found for p in parts]
            rows += [short, long[[at for at, _ in found]]]
            codes += [own, np.array(more, np.int64)]
            counts += [own_counts, np.array([len(parts) for _, parts in found], np.int64)]
        back = np.argsort(np.concatenate(rows))
        codes, counts = np.concatenate(codes), np.concatenate(counts)
        return codes[ragged((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def segment(self, words: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Position in ``words`` and pieces of each word."""
        codes, counts = self.search(words)
        names = [self.v.pieces[c] if c >= 0 else chr(-1 - c) for c in codes.tolist()]
        ends = np.cumsum(counts).tolist()
        for at, (a, b) in enumerate(zip([0, *ends], ends)):
            yield at, names[a:b]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their number in each word."""
        codes, counts = self.search(words)
        odd = np.flatnonzero(codes < 0)
        chars, which = np.unique(codes[odd], return_inverse=True)
        own = [self.ids_of(chr(-1 - c)) for c in chars.tolist()]
        own_sizes = np.array([len(x) for x in own], np.int64)
        sizes = np.ones(len(codes), np.int64)
        sizes[odd] = own_sizes[which]
        starts = np.cumsum(sizes) - sizes
        ids = np.repeat(np.maximum(codes, 0), sizes)
        ids[ragged(starts[odd], sizes[odd])] = np.array([i for x in own for i in x], np.int64)[
            ragged((np.cumsum(own_sizes) - own_sizes)[which], sizes[odd])]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(ends)

    def _apart(self, first: str, second: str) -> bool:
        """Whether ``second`` may follow ``first``, or begin a word (``first`` is empty)."""
        if len(self.known) > 400_000:
            self.known.clear()
        if self.v.edges(second) is None:
            allowed = False
        else:
            allowed = first not in self.v.ids or self.v.stays(first, second)
        self.known[first, second] = allowed
        return allowed

    def _merged(self, word: str, start: int, last: list[str]) -> None:
        """Last pieces of the prefixes from ``start`` on; a character that is no piece stands alone."""
        ids, known, ending = self.v.ids, self.known, self.v.ending
        for j in range(start, len(word) + 1):
            longest = ending.get(word[j - 3:j], 2) if j > 2 else 2
            for i in range(j - longest if j > longest else 0, j):
                piece = word[i:j]
                if piece in ids:
                    before = last[i]
                    allowed = known.get((before, piece))
                    if allowed or (allowed is None and self._apart(before, piece)):
                        last.append(piece)
                        break
            else:
                last.append(word[j - 1])

    def _summed(self, word: str, start: int, last: list[str], score: list[float]) -> None:
        """Last pieces and best sums of the prefixes from ``start`` on."""
        ids, scores, longest = self.v.ids, self.v.scores, self.v.longest
        for j in range(start, len(word) + 1):
            options = [(score[i] + scores[ids[word[i:j]]], word[i:j])
                       for i in range(max(0, j - longest), j) if word[i:j] in ids]
            total, piece = max(options, default=(score[j - 1] + self.unknown, word[j - 1]))
            last.append(piece)
            score.append(total)

    def _one_by_one(self, words: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Position in ``words`` and pieces of each word. Sorted words are a trie in depth-first
        order: what was found for the prefix that a word shares with the one before stays."""
        order = sorted(range(len(words)), key=words.__getitem__)
        before, last, score = "", [""], [0.0]
        for at in order:
            word = words[at]
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1:], score[same + 1:]
            if self.kind == "bpe":
                self._merged(word, same + 1, last)
            else:
                self._summed(word, same + 1, last, score)
            before = word
            found, j = [], len(word)
            while j:
                found.append(last[j])
                j -= len(last[j])
            yield at, found[::-1]

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id, or the byte pieces of a character that is none."""
        i = self.v.ids.get(piece)
        if i is not None:
            return [i]
        raw = piece.encode()
        if all(b in self.v.bytes for b in raw):
            return [self.v.bytes[b] for b in raw]
        return [min(self.v.special, default=0)]


class Encoder:
    """Ids of whole texts; each distinct marked word is searched once, at most ``limit`` remembered."""

    def __init__(self, proto: bytes, kind: str = "bpe", limit: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.search, self.limit = Viterbi(Vocabulary.load(proto), kind), limit
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids, self.fresh, self.held = {}, _Pool(), [], 0

    @property
    def full(self) -> bool:
        return len(self.words) > self.limit or self.held > HELD_BYTES

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Marked words of normalised texts, and how many each has. Where no piece crosses the border behind a
        letter, or the end of a line, words end there too."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        cut = np.zeros(len(data) + 1, bool)
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        cut[:-1] = mark
        cut[3:-1] &= ~mark[:-3]
        if not self.search.v.crossed:
            letter = LETTER[data]
            letter[1:] |= SECOND[data[1:]] & (data[:-1] == 0xC3)
            cut[1:-1] |= letter[:-1] & OTHER[data[1:]]
        if self.search.v.lined:
            line = data == 0x0A
            cut[:-1] |= line
            cut[1:] |= line
        cut[bounds] = True
        cut[-1] = False
        offsets = np.append(np.flatnonzero(cut), len(data))
        words = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words, np.diff(np.searchsorted(offsets[:-1], bounds))

    def read(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and how many each has; new words are noted."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        words, counts = self._cut(list(map(self.model.normalize, listed(texts.cast(pa.binary())))))
        found = words.dictionary_encode()
        numbers, new = numbered(self.words, found.dictionary)
        own = listed(found.dictionary.take(pa.array(new)))
        self.fresh += own
        self.held += sum(map(len, own))
        return numbers[found.indices.to_numpy()], counts

    def ids(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text. All words noted so far
        are searched together first: the more there are, the longer the prefixes they share."""
        if self.fresh:
            self.word_ids.add(*self.search.ids([word.decode() for word in self.fresh]))
            self.fresh = []
        ends = np.append(0, np.cumsum(self.word_ids.sizes[rows]))[np.append(0, np.cumsum(counts))]
        return self.word_ids.take(rows), np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.full:
            self._forget()
        return self.ids(*self.read(texts))


class Decoder:
    """Texts of ids: pieces with marks as spaces, runs of byte pieces as UTF-8, without the leading
    mark that encoding puts before a text."""

    def __init__(self, vocabulary: Vocabulary):
        values = {i: bytes([b]) for b, i in vocabulary.bytes.items()}
        self.parts = [b"" if i in vocabulary.special else values.get(i, p.replace(MARK, " ").encode())
                      for i, p in enumerate(vocabulary.pieces)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.parts[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(path: str | None = None) -> bytes:
    """The model file; by default the public vocabulary of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """``doc_id, n_ids, ids`` (little-endian unsigned 32-bit) of every whole text of ``docs``.

    Texts are normalised by the model's own rules and cut into marked words, which no piece crosses.
    Null and empty texts have no ids. Repeated rows and null ids stay as they are; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        encoder, waiting = Encoder(shared.value, kind), []

        def out():
            for doc_id, rows, counts in waiting:
                ids, sizes = encoder.ids(rows, counts)
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc_id, "n_ids": pa.array(sizes, pa.int64()),
                    "ids": pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())})
            waiting.clear()

        for batch in relieved(text_runs(batches), 32):
            waiting.append((batch.column("doc_id"), *encoder.read(batch.column("text"))))
            if sum(len(rows) for _, rows, _ in waiting) > WAITING_WORDS or encoder.full:
                yield from out()
                if encoder.full:
                    encoder._forget()
        yield from out()

    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, n_ids long, ids binary")


def decoded(spark, ids: Column, model: str | None = None) -> Column:
    """Text of a column of little-endian ids; null stays null."""
    shared = spark.sparkContext.broadcast(read_model(model))

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(Vocabulary.load(shared.value))
        for part in parts:
            yield part.map(lambda raw: decoder.decode(np.frombuffer(raw, "<u4")), na_action="ignore")

    return decode(ids)
