"""Document fingerprints: Merkle trees over paragraphs and sections.

A paragraph is a line. A section ends at a blank line, or after a paragraph whose digest is a
multiple of eight, so an edit moves no border beyond it. A section's digest covers those of
its paragraphs, the root's those of the sections, so equal roots mean equal texts.

Below the paragraphs are leaves of at most ``LONGEST`` bytes. A leaf ends where the hash of the
eight bytes before is the least among all places up to ``REACH`` bytes away (the leftmost of equals
is none, so repetitions have no such place). What is longer is cut again: from its start on, at
the place of the least hash within ``LONGEST`` bytes, the last of equals. Text that repeats itself is
so cut at the same place of each repetition. Cuts are between whole characters, and depend on
nothing outside the line.

A fingerprint is text: the root, then the sections with their paragraphs' leaves, a digest and
a length each. The likeness of two is 1 if the roots are equal, else the share of bytes in
leaves that they have in common; sections that are equal in both are matched whole.
``changed_spans`` walks two trees down their differing branches and gives the character spans
that were edited.

A null text counts as empty. An empty text has a root and no leaf; its likeness is 1 to
another empty one and 0 to any other. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from shopledger.llm.common import map_batches, row_bytes

# Hex digits of the nodes in a fingerprint; a leaf's last two are its length.
ROOT, SECTION, LEAF, LENGTH = 32, 12, 10, 2
GRAM, REACH, LONGEST = 8, 10, 64
SECTION_BITS = 3
NO_CUT = np.uint32(0xFFFFFFFF)
LOWEST_ID = -(1 << 63)
# Characters of the texts whose trees are made at once.
GROUP_CHARS = 1 << 18
# Odd numbers without a pattern, and what undoes a multiplication by the second.
GRAM_FACTOR, LEAF_FACTOR, MIX = 0x9E3779B1, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
LEAF_INVERSE = pow(LEAF_FACTOR, -1, 1 << 64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def _place_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes before each place; ``NO_CUT`` in a character and near a line's start."""
    hashes = data.astype(np.uint32) * np.uint32(GRAM_FACTOR)
    size, factor = 1, GRAM_FACTOR
    while size < GRAM:
        hashes = hashes[:-size] * np.uint32(factor | 1) + hashes[size:]
        hashes ^= hashes >> np.uint32(15)
        factor = factor * GRAM_FACTOR & 0xFFFFFFFF
        size *= 2
    out = np.full(len(data), NO_CUT)
    out[GRAM:] = hashes[: len(data) - GRAM] * np.uint32(GRAM_FACTOR)
    out[(data & 0xC0) == 0x80] = NO_CUT
    # So near a line's start that neither the hash nor a neighbour may look over it.
    first = starts[:, None] + np.arange(REACH)
    out[first[first < np.minimum(ends, len(data))[:, None]]] = NO_CUT
    return out


def leaf_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the leaves of many lines, given the ends of the lines."""
    if not len(data):
        return np.empty(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    cuts = ends
    hashes = NO_CUT
    if len(data) > GRAM:
        hashes = _place_hashes(data, starts, ends)
        edge = np.full(REACH, NO_CUT)
        around = _least(np.concatenate([edge, hashes, edge]), REACH)
        before, behind = around[: len(data)], around[REACH + 1 : REACH + 1 + len(data)]
        cuts = np.flatnonzero((hashes < before) & (hashes <= behind) & (hashes != NO_CUT))
        cuts = np.sort(np.concatenate([cuts, ends]))
    begins = np.concatenate([[0], cuts[:-1]])
    long = np.flatnonzero(cuts - begins > LONGEST)
    more = [_cut_again(data, hashes, int(begins[k]), int(cuts[k])) for k in long.tolist()]
    return np.sort(np.concatenate([cuts, *more])).astype(np.int64) if more else cuts


def _cut_again(data: np.ndarray, hashes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Further cuts of what is too long."""
    found = []
    while stop - start > LONGEST:
        window = hashes[start + 1 : start + LONGEST + 1][::-1]
        at = int(window.argmin())
        end = start + LONGEST - at
        if window[at] == NO_CUT:  # not reached by text in whole characters
            end = start + LONGEST
            while end > start + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        found.append(end)
        start = end
    return np.array(found, np.int64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the leaf factor and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * GROUP_CHARS)
        _POWERS[:] = []
        for factor in (LEAF_FACTOR, LEAF_INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def leaf_codes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> bytes:
    """Four bytes of digest and one of length for every leaf."""
    powers, inverses = _powers(len(data) + 1)
    # A polynomial of the leaf's bytes, by differences of a running sum.
    sums = np.concatenate(
        [np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])]
    )
    sizes = (ends - begins).astype(np.uint64)
    codes = (sums[ends] - sums[begins]) * inverses[begins] + sizes
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(MIX)
    out = np.empty((len(ends), 5), np.uint8)
    out[:, :4] = (codes >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = sizes
    return out.tobytes()


Leaf = tuple[str, int, int]  # code, start, end
Paragraph = tuple[bytes, list[Leaf]]
Section = tuple[bytes, list[Paragraph]]


class Forest:
    """The trees of many texts, whose leaves are found at once."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_ends = np.cumsum(sizes)
        lines = np.union1d(np.flatnonzero(data == 10) + 1, text_ends[sizes > 0]).astype(np.int64)
        ends = leaf_ends(data, lines)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.codes = leaf_codes(data, begins, ends).hex() if len(ends) else ""
        self.ends = ends
        # Of each line: its end, and the number of leaves up to there.
        self.lines, self.joined = lines.tolist(), joined
        self.leaves = np.searchsorted(ends, lines, side="right").tolist()
        self.first_line = np.searchsorted(lines, text_ends - sizes, side="right").tolist()
        self.last_line = np.searchsorted(lines, text_ends, side="right").tolist()

    def sections(self, number: int) -> tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]:
        """A text's root, and its sections: digest, and digest and line number of the paragraphs."""
        sections, mine = [], []
        for line in range(self.first_line[number], self.last_line[number]):
            start = self.lines[line - 1] if line else 0
            text = self.joined[start : self.lines[line]]
            digest = _digest(text)
            mine.append((digest, line))
            if text == b"\n" or digest[0] >> (8 - SECTION_BITS) == 0:
                sections.append((_digest(b"".join([d for d, _ in mine])), mine))
                mine = []
        if mine:
            sections.append((_digest(b"".join([d for d, _ in mine])), mine))
        return _digest(b"".join([digest for digest, _ in sections])), sections

    def line_codes(self, line: int) -> str:
        first = self.leaves[line - 1] if line else 0
        return self.codes[LEAF * first : LEAF * self.leaves[line]]

    def fingerprint(self, number: int) -> str:
        root, sections = self.sections(number)
        parts = [root.hex()]
        for digest, paragraphs in sections:
            lines = [self.line_codes(line) for _, line in paragraphs]
            parts.append(digest.hex()[:SECTION] + ":" + ",".join(lines))
        return "/".join(parts)

    def tree(self, number: int) -> tuple[bytes, list[Section]]:
        """Root digest, and sections: their digest and their paragraphs, with byte offsets."""
        root, sections = self.sections(number)
        offset = sum(len(t) for t in self.texts[:number])

        def leaves(line: int) -> list[Leaf]:
            first = self.leaves[line - 1] if line else 0
            out = []
            for k in range(first, self.leaves[line]):
                start = int(self.ends[k - 1]) if k else 0
                code = self.codes[LEAF * k : LEAF * (k + 1)]
                out.append((code, start - offset, int(self.ends[k]) - offset))
            return out

        return root, [(d, [(p, leaves(line)) for p, line in own]) for d, own in sections]


def fingerprints_of(texts: list[bytes]) -> list[str]:
    forest = Forest(texts)
    return [forest.fingerprint(k) for k in range(len(texts))]


def fingerprint(text: bytes) -> str:
    return fingerprints_of([text])[0]


def tree(text: bytes) -> tuple[bytes, list[Section]]:
    return Forest([text]).tree(0)


def _leaves(section: str) -> str:
    return section[SECTION + 1 :].replace(",", "")


def _n_bytes(sections: Counter) -> int:
    return sum(n * sum(bytes.fromhex(_leaves(s))[4::5]) for s, n in sections.items())


def _counted(sections: Counter) -> Counter:
    found: Counter = Counter()
    for section, n in sections.items():
        codes = _leaves(section)
        found.update([codes[k : k + LEAF] for k in range(0, len(codes), LEAF)] * n)
    return found


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else twice the bytes of common leaves over all bytes of both."""
    if a[:ROOT] == b[:ROOT]:
        return 1.0
    ours, theirs = Counter(a.split("/")[1:]), Counter(b.split("/")[1:])
    same = ours & theirs
    common = _n_bytes(same)
    left, right = ours - same, theirs - same
    total = 2 * common + _n_bytes(left) + _n_bytes(right)
    shared = _counted(left) & _counted(right)
    common += sum(n * int(code[-LENGTH:], 16) for code, n in shared.items())
    return 2 * common / total if total else 0.0


def changed_spans(old: str, new: str) -> list[tuple[int, int]]:
    """Character spans of ``new`` whose leaves are not in ``old`` at the same place."""
    a, b = old.encode(), new.encode()
    (root_a, sections_a), (root_b, sections_b) = tree(a), tree(b)
    if root_a == root_b:
        return []
    spans: list[list[int]] = []

    def differing(left: list, right: list, descend) -> None:
        blocks = SequenceMatcher(
            None, [x[0] for x in left], [x[0] for x in right], autojunk=False
        ).get_opcodes()
        for kind, a0, a1, b0, b1 in blocks:
            if kind != "equal":
                descend(left[a0:a1], right[b0:b1])

    def in_leaves(left: list, right: list) -> None:
        for _, start, end in right:
            if spans and spans[-1][1] == start:
                spans[-1][1] = end
            else:
                spans.append([start, end])

    def in_paragraphs(left: list, right: list) -> None:
        ours = [leaf for p in left for leaf in p[1]]
        differing(ours, [leaf for p in right for leaf in p[1]], in_leaves)

    def in_sections(left: list, right: list) -> None:
        ours = [p for s in left for p in s[1]]
        differing(ours, [p for s in right for p in s[1]], in_paragraphs)

    differing(sections_a, sections_b, in_sections)
    return [(len(b[:s].decode()), len(b[:e].decode())) for s, e in spans]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints_of(list(row_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"]
            )

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, "doc_id long, fingerprint string")


class Parts:
    """Parts of the descending order of ids, cut at bounds; ids that are bounds again and again
    are cut within, by their rows' ties, which are spread evenly."""

    def __init__(self, bounds: list[int]):
        self.bounds = np.sort(np.array(bounds, np.int64))
        values, counts = np.unique(self.bounds, return_counts=True)
        self.hot = {int(v): int(n) for v, n in zip(values, counts) if n > 1}

    def of(self, ids: pa.Array, ties: pa.Array) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Each row's place in the order (null ids: below all), and its part."""
        order = ids.fill_null(LOWEST_ID).to_numpy(zero_copy_only=False)
        ties = ties.to_numpy(zero_copy_only=False)
        part = len(self.bounds) - np.searchsorted(self.bounds, order, side="right")
        counted = np.zeros(len(order), np.int64)
        for value, n in self.hot.items():
            mine = order == value
            counted[mine] = ties[mine]
            share = ((ties[mine] >> 32) + (1 << 31)) * n >> 32
            part[mine] += share
        return list(zip(order.tolist(), counted.tolist())), part.astype(np.int32)


def _first_rows(rows: DataFrame, parts: Parts) -> dict[int, tuple[int, int]]:
    """The place of the first row of each part that has rows; of ``doc_id`` and ``tie``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, part = parts.of(batch.column(0), batch.column(1))
            first: dict[int, tuple[int, int]] = {}
            for at, (order, tie) in zip(part.tolist(), places):
                key = (order, ~tie)
                if at not in first or key > first[at]:
                    first[at] = key
            columns = list(zip(*[(at, *key) for at, key in first.items()])) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                ["part", "first", "turned"],
            )

    found = map_batches(rows, run, "part int, first long, turned long").groupBy("part")
    best = found.agg(F.max(F.struct("first", "turned")).alias("best"))
    return {row.part: (row.best.first, ~row.best.turned) for row in best.collect()}


def _placed(df: DataFrame, parts: Parts, copies: dict[tuple[int, int], int]) -> DataFrame:
    """Rows with their part and text, compressed as it moves whole, and the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            places, part = parts.of(batch.column(0), batch.column(2))
            texts = [pack(text) for text in row_bytes(batch.column(1))]
            twice = [at for at, place in enumerate(places) if place in copies]
            rows = pa.array([*range(len(texts)), *twice])
            to = [*part.tolist(), *[copies[places[at]] for at in twice]]
            copied = [False] * len(texts) + [True] * len(twice)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to, pa.int32()),
                    batch.column(0).take(rows),
                    pa.array(texts, pa.binary()).take(rows),
                    pa.array(copied),
                    batch.column(2).take(rows),
                ],
                ["part", "doc_id", "packed", "copied", "tie"],
            )

    return map_batches(df, run, "part int, doc_id long, packed binary, copied boolean, tie long")


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


Row = tuple[int, int | None, str, bool, str | None]  # part, id, text, copied, fingerprint


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted parts, each ended by a copy of the next part's first row."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[Row] = []
    size = 0
    for batch in batches:
        part, doc_id, packed, copied = batch.columns[:4]
        rows = zip(part.to_pylist(), doc_id.to_pylist(), packed, copied.to_pylist())
        for part_at, id_at, packed_at, is_copy in rows:
            text = unpack(packed_at.as_py()).decode()
            held.append((part_at, id_at, text, is_copy, None))
            size += len(text)
            if size >= GROUP_CHARS:
                out, last = _edited(held)
                yield _edit_batch(out)
                held, size = [last], 0
    if held:
        yield _edit_batch(_edited(held)[0])


def _edited(rows: list[Row]) -> tuple[list[tuple], Row]:
    """Results of all rows but the last, which waits for the one that follows it."""
    prints = [row[4] for row in rows[:1] if row[4] is not None]
    prints += fingerprints_of([row[2].encode() for row in rows[len(prints) :]])
    # Behind the copy of the next row nothing of the part is left.
    pairs = [
        k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][3]
    ]
    edited = []
    for k in pairs:
        text, following = rows[k][2], rows[k + 1][2]
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode())
    out = [
        (
            rows[k][1],
            len(rows[k][2]),
            hashlib.sha256(new).hexdigest(),
            prints[k],
            other,
            likeness(prints[k], other),
            likeness(prints[k], prints[k + 1]),
        )
        for k, new, other in zip(pairs, edited, fingerprints_of(edited))
    ]
    return out, (*rows[-1][:4], prints[-1])


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EDIT_SCHEMA.split(", ")])


def edit_likeness(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Each text's fingerprint against those of an edited text and of the next document.

    Documents are ordered by descending id, rows without id last, ties by text hash; the
    last one's next is the first. The edited text is the text with its last half, rounded
    down in characters, replaced by as many first characters of the next document.

    The order is cut into parts of about equal size at quantiles of the ids, an id of very many
    rows by their ties. Each part also gets a copy of the row that follows its last, so texts
    move once and no part waits for another. What reaches the driver is the place of the
    first row of each part.
    """
    spark = df.sparkSession
    n_parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    order = F.coalesce(doc_id, F.lit(LOWEST_ID))
    shares = [k / n_parts for k in range(n_parts)]
    quantiles = df.agg(F.percentile_approx(order, shares, max(10_000, 10 * n_parts))).first()[0]
    cut = Parts(quantiles or [])
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # Texts are only looked at here if an id has to be cut by them.
    firsts = _first_rows(df.select(doc_id, (tie if cut.hot else F.lit(0).cast("long")).alias("tie")), cut)
    filled = sorted(firsts)
    # Where a part's first row goes as well: to the end of the filled part before it.
    copies = {firsts[now]: last for last, now in zip([*filled[-1:], *filled], filled)}
    placed = _placed(df.select(doc_id, F.col(text_col), tie.alias("tie")), cut, copies)
    sorted_parts = placed.repartition("part").sortWithinPartitions(
        "part", "copied", F.col("doc_id").desc_nulls_last(), "tie"
    )
    return map_batches(sorted_parts, _edit_rows, EDIT_SCHEMA)
