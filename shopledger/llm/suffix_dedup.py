"""Removal of every byte that a repeated string of ``width`` bytes covers, by induced sorting.

Strings start anywhere, in any document; they are compared as bytes and never reach over
a document's end. All of them would be one suffix order of the whole corpus, which no task
can hold. It is worked out from sampled suffixes instead:

1. Anchors. In every run of ``width - GRAM + 1`` positions the one whose next ``GRAM`` bytes
   have the smallest hash is an anchor (the leftmost of equals). Equal strings have the same
   anchor at the same place, so each string belongs to one anchor, ``a`` bytes behind its start.
2. Keys. A string has half of what is beside its anchor before or behind it; that half and
   the anchor are its key. A key that occurs once cannot repeat. Spark sorts the keys, and
   a walk over the sorted rows leaves those of longer runs.
3. Induction. What surrounds the keys of a partition, a number in place of each key, is a shard
   of strings. Its suffixes are sorted by external induced sorting (``induced``): recursion over
   named pieces, suffix tuples and common prefixes carried through queues on disk, so a shard
   may be far larger than memory. Neighbours in the order that have all of the ``width`` bytes
   in common are repeated strings.

A key of more than ``block`` suffixes is not sorted as it is: it is extended by half of the bytes
still missing, before or behind it, and its suffixes are dealt out again, until the keys are short
or are whole strings. The work stays in proportion to the suffixes. Equal contexts that come
together are one suffix, so copies and periodic texts stay small.

A null text counts as empty; texts shorter than ``width`` lose nothing. Equal rows, even
with one id, repeat each other. Rows are known by 92 bits of hashes of their id and text.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from shopledger.llm.common import map_batches, row_bytes, stored, text_bytes
from shopledger.llm.induced import Shard, repeated_places

WIDTH = 200
GRAM = 32
BLOCK = 4_000
# Rows that are looked at together, and rows of a queue that are held in memory.
HELD = 20_000
QUEUE_ROWS = 2_000_000
# Bytes of texts within which equal keys and contexts are put together.
COMBINED_BYTES = 16 << 20
MASK = (1 << 64) - 1
# A row's second number: text tie, position, which half is the key, and a mark.
TIE_BITS, TIE_AT, PLACE_AT = 28, 34, 2

_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_of(width: int) -> int:
    """Bytes of an anchor: a power of two, at most ``GRAM``, that leaves room on both sides."""
    gram = 1
    while gram * 2 <= min(GRAM, width // 2):
        gram *= 2
    return gram


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position, by doubling."""
    hashes = _BYTES[data]
    factor, size = 0x9E3779B97F4A7C15, 1
    while size < gram:
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:]
        factor = factor * factor & MASK
        size *= 2
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(0xBF58476D1CE4E5B9)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return pick(out[:n], out[width - size : width - size + n])


def anchors(text: bytes, width: int) -> list[tuple[int, int, int]]:
    """Position of each anchor, and the least and largest ``a`` of the strings it stands for."""
    if len(text) < width:
        return []
    gram = gram_of(width)
    span = width - gram + 1
    hashes = _gram_hashes(np.frombuffer(text, np.uint8), gram)
    lowest = _sliding(hashes, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, lowest, edge]), span, np.maximum)
    places = np.flatnonzero(hashes == reach)
    values, places = hashes[places].tolist(), places.tolist()
    # The first string of an anchor begins behind the last smaller or equal one before it; its
    # last one ends before the first smaller one behind it.
    last_start = len(text) - width
    first, last, stack = [0] * len(places), [last_start] * len(places), []
    for at, (place, value) in enumerate(zip(places, values)):
        while stack and values[stack[-1]] > value:
            last[stack.pop()] = place - span
        first[at] = places[stack[-1]] + 1 if stack else 0
        stack.append(at)
    found = []
    for place, low, high in zip(places, first, last):
        low, high = max(low, place - span + 1), min(high, place, last_start)
        if low <= high:
            found.append((place, place - high, place - low))
    return found


def halves(
    place: int, least: int, most: int, width: int
) -> Iterator[tuple[int, int, int, int]]:
    """Side, key start, least and largest number of bytes before the key, of an anchor's strings."""
    half = (width - gram_of(width)) // 2
    if least < half:  # more behind the anchor: the key starts with it
        yield 0, place, least, min(most, half - 1)
    if most >= half:  # as much before it: the key ends with it
        yield 1, place - half, max(least - half, 0), most - half


def key_length(width: int) -> int:
    gram = gram_of(width)
    return (width - gram) // 2 + gram


def _tied(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with two hashes by which they are known: of id and text, and of the text."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    doc_id = F.col(id_col).cast("long")
    tie = F.xxhash64(F.lit(1), text).bitwiseAND((1 << TIE_BITS) - 1)
    uid = F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text)
    return df.select(
        uid.alias("uid"), text.alias("text"), tie.alias("tie"), doc_id.alias("doc_id")
    )


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _key_rows(texts: DataFrame, width: int) -> DataFrame:
    """``key``, ``uid``, ``at`` and ``span`` of every anchor half.

    A key that occurs again within a batch repeats for certain: its rows are marked and
    dealt out evenly, and one of them stays for the other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, rows, at, spans = [], [], [], []
            ties = batch.column(2).to_pylist()
            for row, text in enumerate(row_bytes(batch.column(1))):
                for place, least, most in anchors(text, width):
                    for side, start, low, high in halves(place, least, most, width):
                        keys.append(digest(text[start : start + key_length(width)], side))
                        rows.append(row)
                        at.append(ties[row] << TIE_AT | start << PLACE_AT | side << 1)
                        spans.append(low << 16 | high)
            yield marked(batch, keys, rows, at, spans)

    def marked(batch, keys, rows, at, spans) -> pa.RecordBatch:
        keys, at = np.array(keys, np.uint64), np.array(at, np.int64)
        _, first, group, counts = np.unique(
            keys, return_index=True, return_inverse=True, return_counts=True
        )
        certain = counts[group] > 1
        at[certain] |= 1
        stays = first[counts > 1]
        spread = keys ^ (at.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        to = np.concatenate([np.where(certain, spread, keys), keys[stays]])
        every = np.concatenate([np.arange(len(keys)), stays]).astype(np.int64)
        at = np.concatenate([at, at[stays] & ~1])
        rows = pa.array(np.array(rows, np.int64)[every])
        spans = pa.array(np.array(spans, np.int64)[every])
        return pa.RecordBatch.from_arrays(
            [_signed(to), batch.column(0).take(rows), pa.array(at), spans],
            ["key", "uid", "at", "span"],
        )

    schema = "key long, uid long, at long, span long"
    return map_batches(texts.select("uid", "text", "tie"), run, schema, COMBINED_BYTES)


def _repeating(rows: DataFrame) -> DataFrame:
    """Rows that are marked or whose key is in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose run may go on
        held_repeats = False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            mark = batch.column(2).to_numpy(zero_copy_only=False) & 1 == 1
            if mark.any():
                yield batch.filter(pa.array(mark))
                batch = batch.filter(pa.array(~mark))
                keys = keys[~mark]
            if not len(keys):
                continue
            same = keys[1:] == keys[:-1]
            repeats = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if held is not None and held.column(0)[0].as_py() == keys[0]:
                held_repeats = repeats[0] = True
            if held is not None and held_repeats:
                yield held
            repeats, held_repeats = repeats[:-1], bool(repeats[-1])
            held = batch.slice(batch.num_rows - 1)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(repeats))
        if held is not None and held_repeats:
            yield held

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return map_batches(ordered, run, rows.schema)


CONTEXT_SCHEMA = (
    "high long, low long, before binary, behind binary, least int, most int, "
    "uid long, tie long, start long, done boolean, stop long"
)
NAMES = [x.split()[0] for x in CONTEXT_SCHEMA.split(", ")]
KINDS = [
    pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(),
    pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(),
]


def _contexts(documents: DataFrame, width: int) -> DataFrame:
    """What surrounds each key, and spans that a batch decides by itself (``stop`` is set).

    Equal contexts in a batch are repeated strings: their spans are known, and one of
    them goes on, marked as done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = zip(batch.column(2), batch.column(3).to_pylist())
            for row, (packed, places) in enumerate(rows):
                text = unpack(packed.as_py())
                for place in places:
                    least, most = place["span"] >> 16, place["span"] & 0xFFFF
                    side, start = place["at"] >> 1 & 1, place["at"] >> PLACE_AT
                    size = key_length(width)
                    key = xxhash.xxh3_128_digest(text[start : start + size], side)
                    before = text[start - most : start]
                    behind = text[start + size : start + width - least]
                    found[key, before, behind, least, most].append((row, start))
            out, known = [], defaultdict(list)
            for (key, before, behind, least, most), places in found.items():
                row, start = places[0]
                high, low = (int.from_bytes(x, "big", signed=True) for x in (key[:8], key[8:]))
                done = len(places) > 1
                out.append(
                    (high, low, before, behind, least, most, ids[row], ties[row], start, done, None)
                )
                if done:
                    for row, start in places:
                        known[row].append((start - most, start - least + width))
            for row, spans in known.items():
                for start, stop in merged(spans):
                    # Spread over the tasks; no context has an empty key.
                    out.append(
                        (start * 7919 + row, start, None, None, 0, 0, ids[row], ties[row], start,
                         True, stop)
                    )
            columns = list(zip(*out)) if out else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, KINDS)], NAMES
            )

    return map_batches(documents, run, CONTEXT_SCHEMA, COMBINED_BYTES // 2)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(start, stop) for start, stop in out]


ROW = np.dtype(
    [("uid", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("most", "<i8"), ("done", "?"), ("begin", "<i8")]
)
# Numbers of a shard: an end, bytes, and digits of a key's number.
BYTE, DIGIT, DIGITS = 1, 257, 4


def _span_rows(uid: pa.Array, tie: pa.Array, start: pa.Array, stop: pa.Array) -> pa.RecordBatch:
    columns = {"uid": uid, "tie": tie, "start": start, "stop": stop}
    return pa.RecordBatch.from_arrays(
        [columns.get(x, pa.nulls(len(uid), kind)) for x, kind in zip(NAMES, KINDS)], NAMES
    )


class Contexts:
    """Contexts of whole keys as a shard on disk: before, the key's number, behind, an end."""

    def __init__(self, folder: str, width: int, reach: int):
        self.shard, self.width, self.reach, self.n_keys = Shard(folder, DIGIT + 256), width, reach, 0
        self.path = f"{folder}/rows"
        self.rows = open(self.path, "wb")

    def add(self, batch: pa.RecordBatch, group: np.ndarray) -> None:
        """``group`` numbers the keys from 0."""
        before, behind = (text_bytes(batch.column(x)) for x in ("before", "behind"))
        n_before, n_behind = np.diff(before[1]), np.diff(behind[1])
        sizes = n_before + DIGITS + n_behind + 1
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint16)
        keys = group + self.n_keys
        for (data, offsets), n, at in (
            (before, n_before, begins), (behind, n_behind, begins + n_before + DIGITS)
        ):
            out[np.repeat(at - offsets[:-1], n) + np.arange(len(data))] = data.astype(np.uint16) + BYTE
        for k in range(DIGITS):
            out[begins + n_before + k] = DIGIT + (keys >> 8 * (DIGITS - 1 - k) & 255)
        rows = np.empty(len(sizes), ROW)
        for name in ("uid", "tie", "start", "most", "done"):
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        rows["begin"] = begins + self.shard.n
        self.rows.write(rows.tobytes())
        self.shard.add(out)
        self.n_keys += int(group.max()) + 1

    def spans(self, held: int) -> Iterator[pa.RecordBatch]:
        """Spans that repeated strings cover, of contexts that are not done."""
        self.rows.close()
        if not self.shard.n:
            return
        hits = repeated_places(self.shard.closed(), self.reach + DIGITS, held)
        rows = np.memmap(self.path, ROW, "r")
        edges = np.flatnonzero(np.diff(hits, prepend=False, append=False))
        # Runs of neighbouring strings of a suffix are one span.
        for at in range(0, len(edges), 2 * HELD):
            first, last = edges[at : at + 2 * HELD : 2], edges[at + 1 : at + 2 * HELD : 2] - 1
            mine = rows[np.searchsorted(rows["begin"], first, side="right") - 1]
            start = mine["start"] - mine["most"] - mine["begin"]
            new = ~mine["done"]
            columns = (mine["uid"], mine["tie"], start + first, start + last + self.width)
            yield _span_rows(*[pa.array(c[new], pa.int64()) for c in columns])


def _sorter(width: int, reach: int, block: int, queue_rows: int):
    """Spans out of contexts sorted by key; contexts of too many suffixes leave as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Private to the task, as the sorter's own files are.
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            contexts = Contexts(folder, width, reach)
            yield from read(batches, contexts)
            yield from contexts.spans(queue_rows)

    def read(batches: Iterator[pa.RecordBatch], contexts: Contexts) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        long_key: tuple | None = None
        for batch in batches:
            known = batch.column(NAMES.index("stop")).is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            held.append(batch)
            if sum(x.num_rows for x in held) < HELD:
                continue
            spans, rows = once(pa.concat_batches(held))
            yield spans
            keys = keys_of(rows)
            last = int(np.flatnonzero(changes(keys))[-1])  # its key may go on in the next batch
            begin = long_until(keys, long_key)
            yield rows.slice(0, begin)
            if last > begin:
                yield from add(rows.slice(begin, last - begin), contexts)
            rest = rows.slice(max(last, begin))
            if begin == len(keys) or rest.num_rows > block:
                long_key = tuple(keys[-1])
                yield rest
                rest = rest.slice(0, 0)
            held = [rest]
        if held:
            spans, rows = once(pa.concat_batches(held))
            yield spans
            begin = long_until(keys_of(rows), long_key)
            yield rows.slice(0, begin)
            yield from add(rows.slice(begin), contexts)

    def once(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Equal contexts are repeated strings: their spans, and one of them, which is done."""
        first: dict[tuple, int] = {}
        parts = ("high", "low", "before", "behind", "least", "most")
        contexts = zip(*[batch.column(x).to_pylist() for x in parts])
        group = np.array([first.setdefault(c, k) for k, c in enumerate(contexts)], np.int64)
        repeats = np.bincount(group, minlength=len(group))[group] > 1
        done = batch.column("done").to_numpy(zero_copy_only=False)
        columns = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("start", "most", "least")}
        new = pa.array(np.flatnonzero(repeats & ~done))
        start = columns["start"] - columns["most"]
        stop = columns["start"] - columns["least"] + width
        spans = _span_rows(
            batch.column("uid").take(new), batch.column("tie").take(new),
            pa.array(start, pa.int64()).take(new), pa.array(stop, pa.int64()).take(new),
        )
        at = NAMES.index("done")
        rows = batch.set_column(at, "done", pa.array(done | repeats))
        return spans, rows.filter(pa.array(group == np.arange(len(group))))

    def changes(keys: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])

    def long_until(keys: np.ndarray, long_key: tuple | None) -> int:
        """How many of the first rows go on with a key that was too long."""
        if long_key is None or not len(keys) or tuple(keys[0]) != long_key:
            return 0
        following = np.flatnonzero(changes(keys))
        return int(following[1]) if len(following) > 1 else len(keys)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("high", "low")], 1)

    def add(batch: pa.RecordBatch, contexts: Contexts) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        group = np.cumsum(changes(keys_of(batch))) - 1
        sizes = np.bincount(group)[group]
        if sizes.max() > block:
            yield batch.filter(pa.array(sizes > block))
        paired = (sizes > 1) & (sizes <= block)
        if paired.any():
            group = np.unique(group[paired], return_inverse=True)[1]
            contexts.add(batch.filter(pa.array(paired)), group)

    return run


def _extended(contexts: DataFrame, reach: int) -> DataFrame:
    """Contexts with longer keys: by half of the ``reach`` bytes still missing, before or behind."""
    more = (reach + 1) // 2
    left = reach - more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = row["high"].to_bytes(8, "big", signed=True) + row["low"].to_bytes(8, "big", signed=True)
                before, behind, least, most = (row[x] for x in ("before", "behind", "least", "most"))
                place = (row["uid"], row["tie"])
                if least <= left:  # strings with as much behind the key
                    high = min(most, left)
                    content = (before[most - high :], behind[more : reach - least], least, high)
                    out.append((*_halves_of(key, 0, behind[:more]), *content, *place, row["start"], row["done"], None))
                if most > left:  # strings with as much before it
                    low = max(least, left + 1) - more
                    content = (before[: most - more], behind[: left - low], low, most - more)
                    added = before[most - more :]
                    out.append((*_halves_of(key, 1, added), *content, *place, row["start"] - more, row["done"], None))
            columns = list(zip(*out)) if out else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)

    return map_batches(contexts, run, CONTEXT_SCHEMA)


def _halves_of(key: bytes, side: int, added: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key + added, side)
    return tuple(int.from_bytes(x, "big", signed=True) for x in (digest[:8], digest[8:]))


def max_before(width: int) -> int:
    """The most bytes of a string before its key."""
    return width - key_length(width)


def repeated_spans(
    df: DataFrame,
    width: int = WIDTH,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_rows: int = QUEUE_ROWS,
) -> DataFrame:
    """``uid``, ``tie``, ``start`` and ``stop`` of spans that repeated strings cover.

    In bytes of the text. Spans of one document may overlap; all of them together are what
    is covered.
    """
    texts = _tied(df, id_col, text_col)
    alive = (
        _repeating(_key_rows(texts, width))
        .select(
            "uid",
            F.shiftright("at", TIE_AT).alias("tie"),
            F.struct(
                F.col("at").bitwiseAND((1 << TIE_AT) - 2).alias("at"), F.col("span")
            ).alias("place"),
        )
        .groupBy("uid", "tie")
        .agg(F.collect_set("place").alias("places"))
    )
    documents = _joined(texts, alive, "inner").select("uid", "tie", "packed", "places")
    contexts, reach, found = _contexts(documents, width), max_before(width), []
    while True:
        limit = block if reach else 1 << 62
        ordered = contexts.repartition("high", "low").sortWithinPartitions("high", "low")
        spans = stored(map_batches(ordered, _sorter(width, reach, limit, queue_rows), CONTEXT_SCHEMA), "spans")
        found.append(spans.where("stop is not null").select("uid", "tie", "start", "stop"))
        long = spans.where("stop is null")
        if not reach or long.isEmpty():
            return reduce(DataFrame.unionByName, found)
        contexts, reach = _extended(long, reach), reach - (reach + 1) // 2


def _joined(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Texts, compressed as they move whole, with another table by the rows' hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [work(text) for text in row_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (0, 2, 3)], pa.array(packed, pa.binary())],
                ["uid", "tie", "doc_id", "packed"],
            )

    packed = map_batches(texts, pack, "uid long, tie long, doc_id long, packed binary")
    return packed.join(other, ["uid", "tie"], how)


def deduplicated(
    df: DataFrame,
    width: int = WIDTH,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_rows: int = QUEUE_ROWS,
) -> DataFrame:
    """``doc_id``, ``kept`` (the bytes left), ``n_bytes`` and ``removed`` (maximal spans) of every row."""
    spans = repeated_spans(df, width, block, id_col, text_col, queue_rows)
    gathered = stored(
        spans.groupBy("uid", "tie").agg(
            F.collect_set(F.struct("start", "stop")).alias("spans")
        ),
        "spans",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, sizes, removed = [], [], []
            for packed, found in zip(batch.column(1), batch.column(2).to_pylist()):
                text = unpack(packed.as_py())
                gone = merged([(x["start"], x["stop"]) for x in found or ()])
                ends = [0, *[x for span in gone for x in span], len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(ends[::2], ends[1::2])]))
                sizes.append(len(text))
                removed.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(kept, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, kinds),
                ],
                ["doc_id", "kept", "n_bytes", "removed"],
            )

    rows = _joined(_tied(df, id_col, text_col), gathered, "left").select(
        "doc_id", "packed", "spans"
    )
    schema = "doc_id long, kept binary, n_bytes long, removed array<struct<start:long,stop:long>>"
    return map_batches(rows, run, schema)
