"""Encoding with a merge-type (BPE) piece vocabulary, by a score-ordered agenda.

A text is escaped (spaces become U+2581, one is put in front) and split into symbols. An
agenda holds the adjacent pairs of symbols whose concatenation is a piece, best score
first and leftmost first among equals; the top pair is merged and its new neighbours are
put on the agenda, until it is empty. Symbols that are no piece become byte pieces.

All new words of a batch are worked on together. Symbols are numbers, and a table tells for a
pair of them the rank and number of the piece they make. A row of an array has the ranks of a
word's pairs: its agenda, whose top is the first least one. Each step merges the top pair of
every word that still has one, and looks up the ranks of the two new pairs. Very long words
have a heap each.

No piece of the vocabularies handled has a space mark after another character, or a line
break (both checked when a vocabulary is loaded), so merges never cross into a new word or
line, nor from a letter to a mark of punctuation that follows none in any piece. Texts are
cut there, with plain spaces for the marks, and each worker remembers the words it has worked out,
a word as two flat objects. It forgets words that were not met again among the last ones, so
its memory stays bounded; new words are worked out some at a time, for the same reason.

Every word that is worked out is also given to the sentencepiece library, many at a time;
a difference raises. The library decodes the ids.

A null is an empty text, and an empty text has no ids. Repeated rows are kept.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from shopledger.llm.common import kept_by, map_batches, row_bytes

SPACE = "▁"
WORD_MEMORY = 250_000
REMEMBERED_LENGTH = 40
# Characters of the texts that are worked on at once.
SLICE_CHARS = 1_000_000
# Characters of new words that are worked out at once: some ten arrays of as many numbers.
NEW_WORD_CHARS = 100_000

# Kinds of pieces in the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


# Words are worked on together with others of up to the same of these lengths; longer ones alone.
WIDTHS = (4, 7, 10, 14, 20, 40)
NO_PAIR = 1 << 30
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1


def _word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts that merges never leave, of a text with spaces for the space marks.

    Cuts are before space marks, around line breaks, and between a word character and a mark
    of punctuation, if no piece has any such two characters together: marks that follow
    a letter of the alphabet in some piece are left out, then the few word characters
    that the other marks follow.
    """
    pairs = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
    follows = {p[1] for p in pairs if p[0].isascii() and p[0].isalpha()}
    marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in follows]
    joined = {p[0] for p in pairs if p[1] in marks and re.match(r"\w", p[0])}
    some = re.escape("".join(marks)) or "\n"
    free = rf"[^\W{re.escape(''.join(sorted(joined)))}]"
    body = f"[^ \n](?:[^ \n{some}]++|(?<!{free})[{some}])*+"
    return re.compile(f"\n| +(?:{body})?|{body}")


class PairTable:
    """Rank and number of what a pair of numbered symbols makes, for many pairs at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int64)
        self.made = np.zeros(1 << bits, np.int64)
        for (left, right), (rank, made) in pairs.items():
            key = left << 32 | right
            at = int(self._slots(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & self.last
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NO_PAIR`` if there is no such piece) and what the pairs make."""
        keys = (left << 32 | right).ravel()
        at = self._slots(keys)
        there = self.keys[at]
        open_now = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_now):
            at[open_now] = at[open_now] + 1 & self.last
            there[open_now] = self.keys[at[open_now]]
            open_now = open_now[(there[open_now] != keys[open_now]) & (there[open_now] >= 0)]
        ranks = np.where(there == keys, self.ranks[at], NO_PAIR)
        return ranks.reshape(left.shape), self.made[at].reshape(left.shape)


class Vocabulary:
    """A merge-type vocabulary: scores and ids of pieces, ids of bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        model = model_pb2.ModelProto()
        model.ParseFromString(data)
        normalizer, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces:
            raise ValueError("only vocabularies that leave texts as they are")
        if not (normalizer.add_dummy_prefix and normalizer.escape_whitespaces):
            raise ValueError("only vocabularies with a space mark in front of words")
        if kinds & {USER_DEFINED, UNUSED} or not model.trainer_spec.byte_fallback:
            raise ValueError("only vocabularies of plain and byte pieces")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # Pieces by score, best first; pieces of one score share a rank.
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        order = {score: at for at, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in self.ids):
            raise ValueError("a piece goes on after a space mark or holds a line break")
        self.word = _word_pattern(self.ids)
        self.decimals = [str(i) for i in range(len(model.pieces))]
        bytes_at = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_at[f"<0x{b:02X}>"] for b in range(256)]
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Pieces have their ids, other characters of pieces numbers above; no pair has the last."""
        numbers = dict(self.ids)
        above = len(self.decimals)
        for char in sorted(set("".join(self.ids)) - numbers.keys()):
            numbers[char], above = above, above + 1
        self.pairs = PairTable(
            {
                (numbers[piece[:k]], numbers[piece[k:]]): (rank, self.ids[piece])
                for piece, rank in self.ranks.items()
                for k in range(1, len(piece))
                if piece[:k] in numbers and piece[k:] in numbers
            }
        )
        self.other = above
        self.of_char = np.full(0x110000, above, np.int64)
        for symbol, number in numbers.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = number

    def _merged_together(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol numbers of words of at most ``width`` characters, and how many each has left."""
        sizes = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.full((len(words), width), self.other, np.int64)
        symbols[np.arange(width) < sizes[:, None]] = self.of_char[chars]
        out, left_over = np.full_like(symbols, self.other), sizes.copy()
        ranks, made = self.pairs(symbols[:, :-1], symbols[:, 1:])
        rows, place = np.arange(len(words)), np.arange(width)
        while True:
            top = ranks.argmin(1)
            more = ranks[np.arange(len(rows)), top] < NO_PAIR
            if not more.all():
                done = ~more
                out[rows[done]] = symbols[done]
                rows, top = rows[more], top[more]
                symbols, ranks, made = symbols[more], ranks[more], made[more]
            if not len(rows):
                return out, left_over
            here = np.arange(len(rows))
            merged = made[here, top]
            # What is behind the pair moves up by one.
            source = np.minimum(place + (place > top[:, None]), width - 1) + here[:, None] * width
            symbols = symbols.ravel()[source]
            symbols[:, -1] = self.other
            symbols[here, top] = merged
            source = np.minimum(place[:-1] + (place[:-1] >= top[:, None]), width - 2)
            source += here[:, None] * (width - 1)
            ranks, made = ranks.ravel()[source], made.ravel()[source]
            ranks[:, -1] = NO_PAIR
            left_over[rows] -= 1
            with_next = np.flatnonzero(top < width - 1)
            at = top[with_next]
            found = self.pairs(merged[with_next], symbols[with_next, at + 1])
            ranks[with_next, at], made[with_next, at] = found
            with_last = np.flatnonzero(top > 0)
            at = top[with_last] - 1
            found = self.pairs(symbols[with_last, at], merged[with_last])
            ranks[with_last, at], made[with_last, at] = found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of escaped words, worked out together."""
        found: list[list[int] | None] = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        group = np.searchsorted(WIDTHS, sizes)
        for k, width in enumerate(WIDTHS):
            mine = np.flatnonzero(group == k).tolist()
            if not mine:
                continue
            symbols, left_over = self._merged_together([words[i] for i in mine], width)
            # Symbols that are no piece become bytes, one word at a time.
            known = (symbols < len(self.decimals)).sum(1) == left_over
            rows = zip(mine, symbols.tolist(), left_over.tolist(), known.tolist())
            for i, row, n, pieces_only in rows:
                if pieces_only:
                    found[i] = row[:n]
        return [self.encode_escaped(w) if ids is None else ids for w, ids in zip(words, found)]

    def merged(self, text: str) -> list[str]:
        """Symbols of an escaped text when no pair is left on the agenda, here a heap.

        An entry is the rank of a pair and the place of its left symbol, as one number, so
        the smallest is the best score, leftmost first. An entry is stale if the pair that now
        begins there has another rank.
        """
        rank_of = self.ranks.get
        symbols: list[str] = list(text)
        n = len(symbols)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = [
            rank << PLACE_BITS | left
            for left, rank in enumerate(map(rank_of, map(add, symbols, symbols[1:])))
            if rank is not None
        ]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & PLACES
            right = following[left]
            if right >= n or not symbols[left]:
                continue
            pair = symbols[left] + symbols[right]
            if rank_of(pair) != entry >> PLACE_BITS:
                continue
            symbols[left], symbols[right] = pair, ""
            after = following[left] = following[right]
            if after < n:
                before[after] = left
                rank = rank_of(pair + symbols[after])
                if rank is not None:
                    heappush(agenda, rank << PLACE_BITS | left)
            ahead = before[left]
            if ahead >= 0:
                rank = rank_of(symbols[ahead] + pair)
                if rank is not None:
                    heappush(agenda, rank << PLACE_BITS | ahead)
        return [s for s in symbols if s]

    def encode_escaped(self, text: str) -> list[int]:
        symbols = self.merged(text)
        found = list(map(self.ids.get, symbols))
        if None not in found:
            return found
        return [
            i
            for symbol, known in zip(symbols, found)
            for i in ([self.byte_ids[b] for b in symbol.encode()] if known is None else [known])
        ]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, worked out as one agenda."""
        return self.encode_escaped(SPACE + text.replace(" ", SPACE)) if text else []


Coded = tuple[list[int], bytes]  # ids, and the same packed
PACKED = "i"


class Recent:
    """Two generations of at most ``limit`` strings with their packed ids.

    Strings of the older one that are met again move to the younger; when that is full, it
    becomes the older one. Long strings are left out.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def missing(self, strings: set[str]) -> list[str]:
        young, old = self.young, self.old
        young.update({s: old[s] for s in strings if s in old and s not in young})
        return [s for s in strings if s not in young]

    def add(self, new: dict[str, bytes]) -> None:
        self.young.update(new)
        self.long += [s for s in new if len(s) > REMEMBERED_LENGTH]

    def settle(self) -> None:
        for s in self.long:
            del self.young[s]
        self.long = []
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young


def _together(parts: list[bytes]) -> Coded:
    packed = b"".join(parts)
    return array(PACKED, packed).tolist(), packed


class WordMemory:
    """Encodes texts by the words met lately; new ones are worked out."""

    def __init__(self, vocabulary: Vocabulary, words: int = WORD_MEMORY):
        self.vocabulary, self.words = vocabulary, Recent(words)

    def worked_out(self, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for some in _slices(iter(parts), NEW_WORD_CHARS):
            out.update(zip(some, self._packed(some)))
        return out

    def _packed(self, parts: list[str]) -> Iterator[bytes]:
        vocabulary = self.vocabulary
        found = vocabulary.encode_words([w.replace(" ", SPACE) for w in parts])
        # The library puts a space mark in front: a part that has one goes without it, another
        # goes after a line break, and the ids of mark and break are left out again.
        plain = [w[1:] if w[0] == " " else "\n" + w for w in parts]
        expected = vocabulary.library.encode(plain, num_threads=1)
        for part, own, ids in zip(parts, found, expected):
            if own != (ids if part[0] == " " else ids[2:]) and part != " ":
                raise ValueError(f"agenda and library differ on {part!r}")
            yield array(PACKED, own).tobytes()

    def encode(self, texts: list[str]) -> Iterator[Coded]:
        parts_of, words = self.vocabulary.word.findall, self.words
        cut = [parts_of(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        words.add(self.worked_out(words.missing(set(chain.from_iterable(cut)))))
        at = words.young
        for mine in cut:
            yield _together([at[p] for p in mine])
        words.settle()


_MEMORIES: dict[str, WordMemory] = {}
kept_by(__name__, _MEMORIES.clear)


def memory_of(path: str) -> WordMemory:
    if path not in _MEMORIES:
        _MEMORIES[path] = WordMemory(Vocabulary(path))
    return _MEMORIES[path]


def _slices(texts: Iterator[str], limit: int) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


ENCODED_SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids of the rows of a batch, as one array of numbers and where each row's begin."""
    width = array(PACKED).itemsize
    starts = accumulate((len(ids) // width for ids in packed), initial=0)
    numbers = np.frombuffer(b"".join(packed), PACKED)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(numbers, pa.int32()))


def _coded(df: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(path)
        decode = memory.vocabulary.library.decode
        # Many small objects and no cycles: the collector would only look through the memory.
        gc.disable()
        try:
            yield from rows_of(batches, memory, decode)
        finally:
            gc.enable()

    def rows_of(batches, memory, decode) -> Iterator[pa.RecordBatch]:
        decimal = memory.vocabulary.decimals.__getitem__
        for batch in batches:
            columns: list[list] = [[], [], []]
            texts = (text.decode() for text in row_bytes(batch.column(1)))
            for part in _slices(texts, SLICE_CHARS):
                for ids, packed in memory.encode(part):
                    if digests:
                        columns[0].append(len(ids))
                        columns[1].append(_sha256(",".join(map(decimal, ids))))
                        columns[2].append(_sha256(decode(ids)))
                    else:
                        columns[0].append(packed)
                        columns[1].append(decode(ids))
            if digests:
                arrays = [pa.array(columns[0], pa.int64())]
                arrays += [pa.array(c, pa.string()) for c in columns[1:]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                arrays = [_lists(columns[0]), pa.array(columns[1], pa.string())]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, DIGEST_SCHEMA if digests else ENCODED_SCHEMA)


def encoded(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the library's decoding of the ids) of every row."""
    return _coded(df, path, id_col, text_col, False)


def encoded_digests(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Like ``encoded``, with SHA-256 digests of the ids (decimals, commas) and decoded texts."""
    return _coded(df, path, id_col, text_col, True)
