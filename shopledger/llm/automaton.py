"""An Aho-Corasick automaton over words, as arrays that workers map from one file.

Words are numbers (0: in no pattern), found by hash in a table. States are numbered level by
level, so the children of a state stand together, ordered by word: ``first`` has where they begin,
``symbols`` the word that leads to each. ``fail`` is the state of the longest proper suffix,
``link`` the next state on that way where a pattern ends. A state takes 21 bytes and there are at most
as many as words in all patterns, so a million patterns of ten words take some 200 MB of disk, which
all workers of a machine share as mapped pages. To build them takes some 900 MB in one task.

Many places of a text are scanned in step: the words are cut into lanes, and a lane begins as many
words early as a pattern can have, so its state is right from its first own word on. Hashes
only find candidates: every word of a match is compared with the pattern's bytes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

import numpy as np

# ASCII bytes that are no letter or digit become spaces; A-Z become a-z; the rest stays.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)
)
LANES, LEAST_LANE = 4096, 32
SEGMENT = 1 << 20
PLACES = 1 << 12
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Words:
    """The words of texts: where each begins and ends in ``data``, and how many each text has."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def words_in(texts: list[bytes]) -> Words:
    """Normalised words; ``data`` has the texts with a space behind each."""
    data = b" ".join([*texts, b""]).translate(WORDS)
    inside = np.frombuffer(data, np.uint8) != 32
    steps = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds))
    return Words(data, starts, ends, counts)


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """A hash of each word's bytes by their places in it."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, PLACES, dtype=np.uint64)
    factors = factors * np.uint64(2) + np.uint64(1)
    data = np.frombuffer(words.data, np.uint8)
    out = np.empty(len(words.starts), np.uint64)
    # Some words at a time, so that the work area does not grow with the text.
    at = 0
    while at < len(out):
        limit = words.starts[at] + SEGMENT
        stop = max(at + 1, int(np.searchsorted(words.ends, limit, side="right")))
        starts, ends = words.starts[at:stop], words.ends[at:stop]
        sizes = ends - starts
        begins = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
        values = data[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(values * factors[place & (PLACES - 1)], begins)
        sums += sizes.astype(np.uint64)
        out[at:stop] = (sums ^ (sums >> np.uint64(29))) * MIX
        at = stop
    return out


def _slots_for(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open table: keys (0: empty) and values by the key's upper bits."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
    for key, value in zip(keys.tolist(), values.tolist()):
        at = key >> (64 - bits)
        while slots[at]:
            at = at + 1 & (1 << bits) - 1
        slots[at], held[at] = key, value
    return slots, held


@dataclass
class Automaton:
    seed: np.ndarray
    word_keys: np.ndarray
    word_symbols: np.ndarray
    spelled: np.ndarray  # all pattern words, one after the other
    spelled_ends: np.ndarray
    levels: np.ndarray  # the first state of each depth, and the number of states
    root: np.ndarray  # the state after one word
    first: np.ndarray
    symbols: np.ndarray
    fail: np.ndarray
    link: np.ndarray
    ending: np.ndarray  # whether a pattern ends in a state
    owners_at: np.ndarray  # for each state, where its owners begin
    owners: np.ndarray
    names: np.ndarray  # of the owners, one after the other
    name_ends: np.ndarray
    named: np.ndarray  # whether an owner has a name

    @property
    def longest(self) -> int:
        return len(self.levels) - 2

    def save(self, path: str) -> None:
        arrays = {f.name: np.ascontiguousarray(getattr(self, f.name)) for f in fields(self)}
        head = json.dumps({k: (a.dtype.str, len(a)) for k, a in arrays.items()}).encode()
        with open(path, "wb") as file:
            file.write(len(head).to_bytes(8, "little") + head)
            for array in arrays.values():
                file.write(b"\0" * (-file.tell() % 8))
                file.write(array.tobytes())

    @classmethod
    def load(cls, path: str) -> Automaton:
        """The arrays as mapped pages of the file."""
        pages = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(pages[:8].tobytes(), "little")
        at, found = 8 + size, {}
        for name, (kind, n) in json.loads(pages[8 : 8 + size].tobytes()).items():
            at += -at % 8
            end = at + n * np.dtype(kind).itemsize
            found[name] = pages[at:end].view(kind).view(np.ndarray)
            at = end
        return cls(**found)

    def child(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state that each symbol leads to from each state; 0 if there is none."""
        low, end = self.first[states], self.first[states + 1]
        high = end.copy()
        open_now = np.flatnonzero(high - low > 1)
        while len(open_now):
            middle = (low[open_now] + high[open_now]) >> 1
            left = self.symbols[middle] <= symbols[open_now]
            low[open_now[left]] = middle[left]
            high[open_now[~left]] = middle[~left]
            open_now = open_now[high[open_now] - low[open_now] > 1]
        there = low < end
        there[there] = self.symbols[low[there]] == symbols[there]
        return np.where(there, low, 0)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, along failure links where no child fits."""
        out = self.root[symbols]
        live = np.flatnonzero(states)
        states = states[live]
        while len(live):
            found = self.child(states, symbols[live])
            there = found > 0
            out[live[there]] = found[there]
            live, states = live[~there], self.fail[states[~there]]
            live, states = live[states > 0], states[states > 0]
        return out

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        shift, last = np.uint64(64 - (len(self.word_keys).bit_length() - 1)), len(self.word_keys) - 1
        at = (hashes >> shift).astype(np.int64)
        keys = self.word_keys[at]
        open_now = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(open_now):
            at[open_now] = at[open_now] + 1 & last
            keys[open_now] = self.word_keys[at[open_now]]
            open_now = open_now[(keys[open_now] != hashes[open_now]) & (keys[open_now] != 0)]
        return np.where(keys == hashes, self.word_symbols[at], 0)

    def states(self, stream: np.ndarray) -> np.ndarray:
        """The state after each symbol of a stream."""
        early = max(self.longest - 1, 0)
        lanes = int(min(LANES, max(1, len(stream) // LEAST_LANE)))
        size = -(-len(stream) // lanes)
        padded = np.zeros(early + lanes * size, np.int32)
        padded[early : early + len(stream)] = stream
        in_step = np.lib.stride_tricks.as_strided(
            padded, (early + size, lanes), (padded.itemsize, padded.itemsize * size)
        )
        now, out = np.zeros(lanes, np.int32), np.empty((size, lanes), np.int32)
        for k in range(early + size):
            now = self.step(now, np.ascontiguousarray(in_step[k]))
            if k >= early:
                out[k - early] = now
        return out.T.reshape(-1)[: len(stream)]

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Number of the last word, and state of the pattern, of every match."""
        none = np.empty(0, np.int64)
        if not len(words.starts) or not self.longest:
            return none, none
        symbols = self.symbols_of(word_hashes(words, int(self.seed[0])))
        wrong = np.array([], np.int64)
        while True:
            symbols[wrong] = 0
            ends, found = self._matches(symbols, words)
            wrong = self._misspelled(words, symbols, ends, self.depth(found))
            if not len(wrong):
                return ends, found

    def _matches(self, symbols: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        # A zero between texts, and for each run of words that are in no pattern.
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        stream = np.zeros(len(symbols) + len(words.counts), np.int32)
        number = np.full(len(stream), -1, np.int64)
        place = np.arange(len(symbols)) + text
        stream[place], number[place] = symbols, np.arange(len(symbols))
        needed = stream != 0
        needed[1:] |= stream[:-1] != 0
        stream, number = stream[needed], number[needed]
        if not len(stream):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        states = self.states(stream)
        at = np.flatnonzero(self.ending[states] | (self.link[states] > 0))
        found = states[at]
        ends, kinds = [], []
        while len(at):
            here = self.ending[found] > 0
            ends.append(number[at[here]])
            kinds.append(found[here])
            found = self.link[found]
            at, found = at[found > 0], found[found > 0]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(ends), np.concatenate(kinds).astype(np.int64)

    def depth(self, states: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels[:-1], states, side="right") - 1

    def _misspelled(self, words: Words, symbols, ends, sizes) -> np.ndarray:
        """Words of matches that only share their hash with the pattern's."""
        covered = np.flatnonzero(cover(len(symbols), ends, sizes))
        begins = np.concatenate([[0], self.spelled_ends[:-1]])
        spelled = self.spelled.tobytes() if len(covered) else b""
        wrong = [
            k
            for k, symbol in zip(covered.tolist(), symbols[covered].tolist())
            if words.data[words.starts[k] : words.ends[k]]
            != spelled[begins[symbol - 1] : self.spelled_ends[symbol - 1]]
        ]
        return np.array(wrong, np.int64)

    def name(self, owner: int) -> str | None:
        if not self.named[owner]:
            return None
        begin = self.name_ends[owner - 1] if owner else 0
        return self.names[begin : self.name_ends[owner]].tobytes().decode()

    def owners_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each state its owners, and the place of the state in ``states``."""
        begins, sizes = self.owners_at[states], np.diff(self.owners_at)[states]
        of = np.repeat(np.arange(len(states)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.owners[np.repeat(begins, sizes) + place], of


def cover(n: int, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are inside a match."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, ends + 1 - sizes, 1)
    np.add.at(steps, ends + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def windows_of(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of all windows of texts with so many words."""
    each = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), each)
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    starts = (np.cumsum(counts) - counts)[text] + within
    return starts, np.minimum(counts[text], window), text


def build(texts: list[bytes], names: list[str | None], window: int) -> Automaton:
    """An automaton of all windows of the texts; the owners of a pattern are texts, which have names."""
    words = words_in(texts)
    seed = 0
    while True:  # until no two different words have one hash
        hashes = word_hashes(words, seed)
        keys, at, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        of_key = [words.data[words.starts[k] : words.ends[k]] for k in at.tolist()]
        spelled = {words.data[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist())}
        if len(spelled) == len(of_key) and not (keys == 0).any():
            break
        seed += 1
    stream = (numbers + 1).astype(np.int64)
    slots, held = _slots_for(keys, np.arange(1, len(keys) + 1))
    starts, sizes, owner = windows_of(words.counts, window)
    # States level by level: the distinct pairs of a state and the word behind it, in order.
    width = len(keys) + 1
    at_state = np.zeros(len(starts), np.int64)
    parents, symbols, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1]
    for depth in range(int(sizes.max(initial=0))):
        mine = np.flatnonzero(sizes > depth)
        pairs = at_state[mine] * width + stream[starts[mine] + depth]
        distinct, which = np.unique(pairs, return_inverse=True)
        at_state[mine] = levels[-1] + which
        parents.append(distinct // width)
        symbols.append(distinct % width)
        levels.append(levels[-1] + len(distinct))
    parent, symbol = np.concatenate(parents), np.concatenate(symbols).astype(np.int32)
    n = len(parent)
    # The root's own entry is left out of the children.
    first = 1 + np.searchsorted(parent[1:], np.arange(n + 1))
    root = np.zeros(width, np.int32)
    if n > 1:
        top = slice(levels[1], levels[2])
        root[symbol[top]] = np.arange(levels[1], levels[2])
    owned = np.unique(np.stack([at_state, owner], 1), axis=0) if len(owner) else np.empty((0, 2), int)
    ending = np.zeros(n, bool)
    ending[owned[:, 0]] = True
    spoken = [(x or "").encode() for x in names]
    made = Automaton(
        np.array([seed], np.int64), slots, held,
        np.frombuffer(b"".join(of_key), np.uint8), np.cumsum([len(w) for w in of_key]).astype(np.int64),
        np.array(levels, np.int64), root, first.astype(np.int32), symbol,
        np.zeros(n, np.int32), np.zeros(n, np.int32), ending,
        np.searchsorted(owned[:, 0], np.arange(n + 1)).astype(np.int32), owned[:, 1].astype(np.int32),
        np.frombuffer(b"".join(spoken), np.uint8), np.cumsum([len(x) for x in spoken]).astype(np.int64),
        np.array([x is not None for x in names], bool),
    )
    for low, high in zip(levels[2:], levels[3:]):
        level = np.arange(low, high)
        made.fail[level] = made.step(made.fail[parent[level]], symbol[level])
        suffix = made.fail[level]
        made.link[level] = np.where(ending[suffix], suffix, made.link[suffix])
    return made
