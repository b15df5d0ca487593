"""External induced sorting: a shard's suffixes in order, with their common prefixes.

A shard is many short strings of small numbers, one after the other, each ended by a 0. A
suffix ends with its string. The order of all suffixes is induced from that of a few:

* A place is of type S if its suffix is smaller than the next place's, else L. The places of
  type S behind one of type L (``sampled``) begin pieces, which are named in their order. The
  string of names, at most half as long, is sorted by recursion. Its suffixes are those sampled.
* The L suffixes follow in one pass from small to large: what stands before a suffix that is
  passed goes to the end of its first number's queue. The S suffixes follow from large to small.
* The common prefix of two neighbours in a queue is one more than the smallest between the
  two that they were induced from; it is carried along. It is counted up to ``longest``.

Queues are ordered by number and arrival. What they hold beyond ``held`` rows is on disk, in parts
that are read when their number is due; so are the L suffixes that wait for the second pass.
Numbers are few in the shard itself, and rows are handled many at a time. In the strings of
names numbers are many: there a queue is a heap with sorted runs on disk, merged as they are read.
A string of names that fits memory ends the recursion; it is sorted by doubled prefixes.

The files lie in a folder of the task alone, like the sorter's own, and go with it.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np

CHUNK = 1 << 16
ROW = np.dtype([("at", "<i8"), ("common", "<u2")])
KEY_BITS = 60


class Shard:
    """Numbers on disk, mapped once all are added; each with its type in the lowest bit (1: S)."""

    def __init__(self, folder: str, n_symbols: int):
        self.folder, self.n_symbols, self.n = folder, n_symbols, 0
        self.kind = np.uint16 if 2 * n_symbols <= 1 << 16 else np.int64
        self.path = os.path.join(folder, "numbers")
        self.file = open(self.path, "wb")

    def add(self, part: np.ndarray) -> None:
        self.file.write((part.astype(self.kind) << 1).tobytes())
        self.n += len(part)

    def closed(self, last: int = 1) -> Shard:
        """``last`` is the last place's type: 1 for the end of a string, else 0."""
        self.file.write(b"\0" * 8)  # so that eight bytes can be read at each place
        self.file.close()
        self.pages = np.memmap(self.path, np.uint8, "r+")
        self.marked = self.pages[: -8].view(self.kind).view(np.ndarray)
        mark_types(self.marked, last)
        return self

    def numbers(self, at: np.ndarray) -> np.ndarray:
        return self.marked[at] >> 1


def mark_types(marked: np.ndarray, last: int) -> None:
    """Set the lowest bit of all places of type S, from the last one on."""
    following, kind = None, last  # the number behind a block, and its type
    for stop in range(len(marked), 0, -CHUNK * 16):
        start = max(0, stop - CHUNK * 16)
        numbers = (marked[start:stop] >> 1).astype(np.int64)
        behind = np.append(numbers[1:], numbers[-1] if following is None else following)
        types = np.where(numbers < behind, 1, np.where(numbers > behind, 0, 2)).astype(np.int8)
        # A place with an equal number behind it has that one's type.
        decided = np.where(types < 2, np.arange(len(types)), len(types))
        source = np.minimum.accumulate(decided[::-1])[::-1]
        types = np.append(types, kind)[source]
        marked[start:stop] |= types.astype(marked.dtype)
        following, kind = int(numbers[0]), int(types[0])


def sampled(marked: np.ndarray) -> np.ndarray:
    """The places of type S behind one of type L."""
    found, before = [], 1
    for start in range(0, len(marked), CHUNK * 16):
        types = (marked[start : start + CHUNK * 16] & 1).astype(np.int8)
        found.append(start + np.flatnonzero((types == 1) & (np.append(before, types[:-1]) == 0)))
        before = types[-1]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _keys(marked: np.ndarray, starts: np.ndarray, sizes: np.ndarray, done: int, bits: int) -> np.ndarray:
    """As many numbers as a key takes, from the ``done``-th of each piece on; 0 behind its end."""
    keys = np.zeros(len(starts), np.int64)
    for k in range(done, done + max(1, KEY_BITS // bits)):
        inside = sizes > k
        keys <<= bits
        keys[inside] |= marked[starts[inside] + k].astype(np.int64) + 1
    return keys


def piece_names(marked: np.ndarray, places: np.ndarray, held: int, limit: int) -> np.ndarray:
    """For each sampled place the rank of its piece, which ends with the next sampled place.

    Pieces are dealt out by ranges of their first numbers, so that about ``held`` are sorted at once.
    """
    bits = int(2 * limit + 1).bit_length()
    step = max(1, KEY_BITS // bits)
    sizes = np.append(np.diff(places) + 1, len(marked) - places[-1:])
    names, given = np.empty(len(places), np.int64), 0
    first = _keys(marked, places, sizes, 0, bits)
    shares = np.linspace(0, 1, -(-len(places) // held) + 1)[1:-1]
    sample = np.sort(first[:: max(1, len(first) // (64 * (len(shares) + 1)))])
    bounds = np.unique(sample[(shares * len(sample)).astype(int)]) if len(shares) else sample[:0]
    slices = np.searchsorted(bounds, first, side="right")
    for number in range(len(bounds) + 1):
        mine = np.flatnonzero(slices == number)
        ranks = np.unique(first[mine], return_inverse=True)[1]
        done = step
        while True:
            going = np.flatnonzero(sizes[mine] > done)
            if not len(going):
                break
            keys = _keys(marked, places[mine[going]], sizes[mine[going]], done, bits)
            within = np.zeros(len(mine), np.int64)
            within[going] = np.unique(keys, return_inverse=True)[1]
            ranks = np.unique(ranks * (len(mine) + 1) + within, return_inverse=True)[1]
            done += step
        names[mine] = given + ranks
        given += int(ranks.max()) + 1 if len(ranks) else 0
    return names


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of a short string's suffixes, by ranks of prefixes that double."""
    ranks, size = np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    while size < len(names) and int(ranks.max()) + 1 < len(names):
        behind = np.zeros(len(names), np.int64)
        behind[:-size] = ranks[size:] + 1
        ranks = np.unique(ranks * (len(names) + 1) + behind, return_inverse=True)[1]
        size *= 2
    return np.argsort(ranks, kind="stable")


class HeapQueue:
    """Smallest first; more than ``held`` rows go to disk as sorted runs."""

    def __init__(self, path: str, held: int):
        self.file, self.held = open(path, "w+b"), held
        self.heap: list[tuple[int, int, int]] = []
        self.runs: list[tuple[tuple[int, int, int], int, list, list[int]]] = []

    def push(self, row: tuple[int, int, int]) -> None:
        if len(self.heap) >= self.held:
            self.heap.sort()
            data = np.array(self.heap, np.int64)
            self.file.seek(0, 2)
            start = self.file.tell()
            self.file.write(data.tobytes())
            self._next(len(self.runs), [], [start, start + data.nbytes])
            self.heap = []
        heappush(self.heap, row)

    def _next(self, number: int, block: list, rest: list[int]) -> None:
        if not block and rest[0] < rest[1]:
            self.file.seek(rest[0])
            data = self.file.read(min(rest[1] - rest[0], 24 * 4096))
            rest[0] += len(data)
            block = np.frombuffer(data, np.int64).reshape(-1, 3).tolist()[::-1]
        if block:
            heappush(self.runs, (tuple(block.pop()), rest[1], block, rest))

    def top(self) -> tuple[int, int, int] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, int, int]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            row, _, block, rest = heappop(self.runs)
            self._next(0, block, rest)
            return row
        return heappop(self.heap)


def order_of_names(folder: str, names: np.ndarray, held: int) -> np.ndarray:
    """The order of the suffixes of a string of names."""
    if len(names) <= held:
        return doubled(names)
    folder = os.path.join(folder, "names")
    os.mkdir(folder)
    limit = int(names.max()) + 1
    shard = Shard(folder, limit)
    for k in range(0, len(names), CHUNK):
        shard.add(names[k : k + CHUNK])
    shard.closed(0)
    places = sampled(shard.marked)
    if len(places):
        inner = piece_names(shard.marked, places, held, limit)
        places = places[order_of_names(folder, inner, held)]
    return _induced_by_heap(folder, shard, places, held)


def _induced_by_heap(folder: str, shard: Shard, places: np.ndarray, held: int) -> np.ndarray:
    """All suffixes of a string of many different numbers, given the sampled ones in order."""
    marked = shard.marked
    passed = np.memmap(os.path.join(folder, "passed"), np.int64, "w+", shape=shard.n)
    out = np.memmap(os.path.join(folder, "order"), np.int64, "w+", shape=shard.n)
    queue, n_passed, arrival = HeapQueue(os.path.join(folder, "large"), held), 0, 0
    seeds = deque(places.tolist())
    queue.push((int(marked[-1] >> 1), -1, shard.n - 1))  # of type L, behind it is nothing
    while seeds or queue.top():
        top = queue.top()
        if top and (not seeds or top[0] <= int(marked[seeds[0]] >> 1)):
            number, _, at = queue.pop()
            passed[n_passed], n_passed, least = at, n_passed + 1, number
        else:
            at = seeds.popleft()
            least = int(marked[at] >> 1) + 1
        if at:
            before = int(marked[at - 1])
            if not before & 1 and before >> 1 >= least:
                queue.push((before >> 1, arrival, at - 1))
        arrival += 1
    queue, arrival, n_out, rest = HeapQueue(os.path.join(folder, "small"), held), 0, shard.n, n_passed
    while rest or queue.top():
        top = queue.top()
        if top and (not rest or -top[0] >= int(marked[passed[rest - 1]] >> 1)):
            at = queue.pop()[2]
        else:
            rest -= 1
            at = int(passed[rest])
        n_out -= 1
        out[n_out] = at
        if at and marked[at - 1] & 1:
            queue.push((-int(marked[at - 1] >> 1), arrival, at - 1))
        arrival += 1
    return out


class DiskQueue:
    """Rows by number and arrival; parts beyond ``held`` rows are on disk."""

    def __init__(self, path: str, n_symbols: int, held: int):
        self.file, self.held, self.rows = open(path, "w+b"), held, 0
        self.parts: list[deque] = [deque() for _ in range(n_symbols)]

    def push(self, number: int, rows: np.ndarray) -> None:
        self.parts[number].append(rows)
        self.rows += len(rows)
        if self.rows > self.held:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(0, 2)
        for parts in self.parts:
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.rows = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            self.rows -= len(part)
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * ROW.itemsize), ROW)

    def pop(self, number: int) -> np.ndarray | None:
        """The first rows of a number, several parts together."""
        parts, found, n = self.parts[number], [], 0
        while parts and n < CHUNK:
            found.append(self._read(parts.popleft()))
            n += len(found[-1])
        return np.concatenate(found) if found else None

    def pop_last(self, number: int) -> np.ndarray | None:
        parts = self.parts[number]
        return self._read(parts.pop()) if parts else None


class Ranges:
    """The smallest of any range of a list."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the values from ``first`` to ``last``, both counted."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for step in range(len(self.levels), int(level.max(initial=0)) + 1):
            held, half = self.levels[-1], 1 << (step - 1)
            self.levels.append(np.minimum(held[:-half], held[half:]))
        out = np.empty(len(first), self.levels[0].dtype)
        for k, held in enumerate(self.levels):
            mine = level == k
            if mine.any():
                out[mine] = np.minimum(held[first[mine]], held[last[mine] + 1 - (1 << k)])
        return out


class Pass:
    """Passes over suffixes in order, and queues those that stand before them."""

    def __init__(self, shard: Shard, queue: DiskQueue, longest: int):
        self.shard, self.queue, self.longest = shard, queue, longest
        # Of each number: whether its queue was ever used, and the smallest common prefix since.
        self.begun = np.zeros(shard.n_symbols, bool)
        self.least = np.full(shard.n_symbols, longest, np.uint16)

    def feed(self, at: np.ndarray, common: np.ndarray, large: bool, number: int, own: bool) -> None:
        """Suffixes that begin with ``number``, with what each has in common with the one before.

        ``large``: L suffixes are wanted, from small to large, else S suffixes. ``own``: those
        passed are of that type, so an equal number before them is as well.
        """
        before = self.shard.numbers(np.maximum(at - 1, 0)).astype(np.int64)
        if large:
            wanted = before >= number if own else before > number
        else:
            wanted = before <= number if own else before < number
        source = np.flatnonzero(wanted & (at > 0))
        if not len(source):
            np.minimum(self.least, common.min(), out=self.least)
            return
        before = before[source]
        order = np.argsort(before.astype(self.shard.kind), kind="stable")
        before, source = before[order], source[order]
        heads = np.flatnonzero(np.diff(before, prepend=-1))
        ranges = Ranges(common)
        first = np.empty(len(source), np.int64)
        first[1:], first[heads] = source[:-1] + 1, 0
        found = ranges(first, source)
        found[heads] = np.minimum(found[heads], self.least[before[heads]])
        found = np.minimum(found + 1, self.longest).astype(np.uint16)
        found[heads[~self.begun[before[heads]]]] = 0
        rows = np.empty(len(source), ROW)
        rows["at"], rows["common"] = at[source] - 1, found
        tails = np.append(heads[1:], len(source)) - 1
        for head, tail in zip(heads.tolist(), tails.tolist()):
            self.queue.push(int(before[head]), rows[head : tail + 1])
        self.begun[before[heads]] = True
        np.minimum(self.least, common.min(), out=self.least)
        self.least[before[tails]] = self.longest
        open_now = tails[source[tails] + 1 < len(common)]
        if len(open_now):
            last = np.full(len(open_now), len(common) - 1)
            self.least[before[open_now]] = ranges(source[open_now] + 1, last)


def _run(shard: Shard, at: int, longest: int) -> int:
    """How often a place's number stands there in a row."""
    numbers = shard.marked[at : at + longest] >> 1
    other = np.flatnonzero(numbers != numbers[0])
    return int(other[0]) if len(other) else len(numbers)


def common_prefixes(shard: Shard, places: np.ndarray, longest: int) -> np.ndarray:
    """What each of the places has in common with the one before; a 0 is not common."""
    # Four numbers at a time, without their types.
    fours = np.ndarray((shard.n,), "<u8", shard.pages, strides=(2,))
    types = np.uint64(0x0001000100010001)
    ends = np.flatnonzero(shard.marked >> 1 == 0)
    left = np.minimum(ends[np.searchsorted(ends, places)] - places, longest)
    most = np.minimum(left[1:], left[:-1])
    out, going, done = np.zeros(len(places), np.int64), np.arange(1, len(places)), 0
    while len(going):
        other = (fours[places[going] + done] ^ fours[places[going - 1] + done]) & ~types
        # Equal numbers before the first that differs: its lowest bit tells.
        lowest = other & (~other + np.uint64(1))
        equal = np.where(other == 0, 4, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)) // 16)
        out[going] += equal.astype(np.int64)
        done += 4
        going = going[(other == 0) & (most[going - 1] > done)]
    out[1:] = np.minimum(out[1:], most)
    return out.astype(np.uint16)


def ordered(shard: Shard, longest: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the very last 0, from large to small, and what each shares with the one before."""
    if not shard.n:
        return
    folder, n_symbols = shard.folder, shard.n_symbols
    places = sampled(shard.marked)
    names = piece_names(shard.marked, places, held, n_symbols)
    # Ends of strings are all different, so no comparison goes beyond one.
    ends = np.flatnonzero(shard.numbers(places) == 0)
    names += len(ends)
    names[ends] = np.arange(len(ends))
    places = places[order_of_names(folder, names, held)]
    common = common_prefixes(shard, places, longest)
    begins = np.searchsorted(shard.numbers(places), np.arange(n_symbols + 1))

    queue = DiskQueue(os.path.join(folder, "large"), n_symbols, held)
    kept = DiskQueue(os.path.join(folder, "kept"), n_symbols, held)
    up = Pass(shard, queue, longest)
    for number in range(n_symbols):
        last = None
        while (rows := queue.pop(number)) is not None:
            for k in range(0, len(rows), CHUNK):
                kept.push(number, rows[k : k + CHUNK])
                up.feed(rows["at"][k : k + CHUNK], rows["common"][k : k + CHUNK], True, number, True)
            last = int(rows["at"][-1])
        for k in range(begins[number], begins[number + 1], CHUNK):
            mine = slice(k, min(k + CHUNK, begins[number + 1]))
            shared = common[mine].copy()
            if k == begins[number]:
                shared[0] = 0 if last is None else _both(shard, last, int(places[k]), longest)
            up.feed(places[mine], shared, True, number, False)

    queue = DiskQueue(os.path.join(folder, "small"), n_symbols, held)
    down = Pass(shard, queue, longest)
    for number in range(n_symbols - 1, -1, -1):
        last = None
        while (rows := queue.pop(number)) is not None:
            for k in range(0, len(rows), CHUNK):
                at, shared = rows["at"][k : k + CHUNK], rows["common"][k : k + CHUNK]
                yield at, shared if number else np.zeros_like(shared)
                down.feed(at, shared, False, number, True)
            last = int(rows["at"][-1])
        shared_next = None
        while (rows := kept.pop_last(number)) is not None:
            rows = rows[::-1]
            if shared_next is None:
                shared_next = 0 if last is None else _both(shard, last, int(rows["at"][0]), longest)
            shared = np.append(np.uint16(shared_next), rows["common"][:-1]).astype(np.uint16)
            shared_next = rows["common"][-1]
            yield rows["at"], shared
            down.feed(rows["at"], shared, False, number, False)


def _both(shard: Shard, one: int, other: int, longest: int) -> int:
    """What an L and an S suffix of one number have in common: the shorter run of it."""
    return min(_run(shard, one, longest), _run(shard, other, longest))


def repeated_places(shard: Shard, longest: int, held: int) -> np.ndarray:
    """For each place whether the ``longest`` numbers from there stand somewhere else as well."""
    hits = np.zeros(shard.n, bool)
    before = None
    for at, common in ordered(shard, longest, held):
        same = common >= longest
        hits[at[same]] = True
        ahead = np.append(before if before is not None else at[:1], at[:-1])
        hits[ahead[same]] = True
        before = at[-1]
    return hits
