"""Line deduplication by a segment-partition edit-distance join.

Equal lines are one class. Two classes are linked if their edit distance is at most
``threshold``. A line of length l is cut into ``threshold + 1`` segments, one of which every
line within the distance contains unchanged. Each line is indexed under its segments and
probes, for every shorter length in reach, the substrings at which such a segment can
stand (positions limited from the left and from the right by the edits that are left).
Equal keys give candidates, which are verified by a banded bit-parallel edit distance.

Keys are sorted by Spark and walked run by run, so a task holds one short run. A run with
more than ``run_pairs`` candidates is not multiplied out: both lines contain its segment,
so the rests of the lines are within the distance too, and the rests are joined the same way
under keys of their own. What is still long after that is cut into blocks; each pair of
blocks is compared in a task of its own, first by counts of characters, and only links
leave it.

A line occurrence is dropped if an equal or linked line occurs before it (by document id,
then line number): with ``chains`` one that itself stays, so that every dropped line has a
kept one within the distance, else any one, even if that goes too. What stays along chains
is decided in rounds over the links: a class without an undecided earlier neighbour stays,
its later neighbours go. Rounds are as many as the longest chain needs; the last
``AT_ONCE`` links are decided on the driver. Blank lines always stay. Lines shorter than
``min_chars`` are only compared as equals, or, with ``scaled``, within as many edits as their
length allows in proportion (2 from 24 characters on are 1 from 12 on, and none below): two
edits make a different line of so few characters. Of two lines, the shorter one's length
counts. Lines are what line breaks separate, and are compared as they are, without the
carriage return.

A null text is one blank line, as an empty one is. Rows without id come first; repeated
ids are told apart by their text; rows equal in id and text count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from shopledger.llm import chains as chains_of
from shopledger.llm.common import kept_by, map_batches, row_bytes, stored

THRESHOLD = 2
MIN_CHARS = 24
RUN_PAIRS = 32
# Lines of a long run that are compared with as many others at once.
BLOCK = 1024
# Bins of characters whose counts are compared before the edit distance is worked out.
BINS = 16
SEEN = 200_000
# Bits of the filter that picks the lines whose text is looked up: for each line, and at most.
BITS_PER_LINE, MAX_BITS = 16, 1 << 26
# Undecided links of chains that the driver decides in one go.
AT_ONCE = 200_000
MASK = (1 << 64) - 1


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """Start and end of the segments of a line of this length; the last ones are longer."""
    n = threshold + 1
    short, longer = divmod(length, n)
    sizes = [short] * (n - longer) + [short + 1] * longer
    ends = np.cumsum(sizes).tolist()
    return [(end - size, end) for size, end in zip(sizes, ends)]


def allowed(length: int, threshold: int, scale: int) -> int:
    """Edits between a line of this length and one that is no shorter.

    ``scale``: the length from which all edits of the threshold are allowed; 0 for any length.
    """
    return threshold if length >= scale else threshold * length // scale


@lru_cache(maxsize=4_000)
def probes(
    length: int, threshold: int, other: int | None = None, scale: int = 0
) -> list[tuple[int, int, int]]:
    """Seed, start and end of the substrings that can equal a segment of a shorter line.

    ``other``: only for this length of the shorter line.
    """
    if scale:
        shorter = range(max(0, length - threshold), length + 1)
        edits = {size: allowed(size, threshold, scale) for size in shorter}
        plans = [(size, probes(length, n, size)) for size, n in edits.items() if length - size <= n > 0]
        return [
            (size * (threshold + 1) + seed % (edits[size] + 1), start, end)
            for size, plan in plans
            for seed, start, end in plan
        ]
    found = []
    shorter = range(max(0, length - threshold), length + 1) if other is None else [other]
    for size in shorter:
        extra = length - size
        for number, (start, end) in enumerate(segments(size, threshold)):
            # At most ``number`` edits before the segment, and ``threshold - number`` behind.
            behind = threshold - number
            first = max(0, start - number, start + extra - behind)
            last = min(length - (end - start), start + number, start + extra + behind)
            seed = size * (threshold + 1) + number
            found += [(seed, at, at + end - start) for at in range(first, last + 1)]
    return found


@lru_cache(maxsize=4_000)
def indexed(length: int, threshold: int, scale: int = 0) -> list[tuple[int, int, int]]:
    edits = allowed(length, threshold, scale)
    return [
        (length * (threshold + 1) + number, start, end)
        for number, (start, end) in enumerate(segments(length, edits) if edits or not scale else ())
    ]


kept_by(__name__, lambda: (probes.cache_clear(), indexed.cache_clear()))


def lines_of(text: bytes) -> list[bytes]:
    return [line.rstrip(b"\r") for line in text.split(b"\n")]


def _cutter(line: bytes):
    """Substring by characters, as UTF-8."""
    if line.isascii():
        return lambda start, end: line[start:end], len(line)
    text = line.decode()
    return lambda start, end: text[start:end].encode(), len(text)


def _keys(line: bytes, threshold: int, scale: int) -> tuple[list[int], int]:
    """Keys of the line: first of its segments, then its probes; and how many are segments."""
    cut, length = _cutter(line)
    key = xxhash.xxh3_64_intdigest
    own = indexed(length, threshold, scale)
    plan = [*own, *probes(length, threshold, None, scale)]
    return [key(cut(start, end), seed) for seed, start, end in plan], len(own)


def digest64(line: bytes) -> int:
    """Number of a line among candidates; its lowest bit is left free for its role."""
    return xxhash.xxh3_64_intdigest(line) & ~1


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _compared(line: bytes, min_chars: int) -> bool:
    return len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars)


def line_keys(texts: DataFrame, threshold: int, min_chars: int, scale: int = 0) -> DataFrame:
    """``key`` and ``line`` (odd: a probe) of all lines; copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys: list[int] = []
            lines: list[int] = []
            counts: list[int] = []
            for text in row_bytes(batch.column(1)):
                for line in lines_of(text):
                    number = digest64(line)
                    if number in seen or not _compared(line, min_chars):
                        continue
                    seen.add(number)
                    found, n_own = _keys(line, threshold, scale)
                    keys += found
                    lines += (number, number | 1)
                    counts += (n_own, len(found) - n_own)
                if len(keys) > 100_000:
                    yield _rows(keys, lines, counts)
                    keys, lines, counts = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            if keys:
                yield _rows(keys, lines, counts)

    return map_batches(texts, run, "key long, line long")


def _rows(keys: list[int], lines: list[int], counts: list[int]) -> pa.RecordBatch:
    repeated = np.repeat(np.array(lines, np.uint64), np.array(counts, np.int64))
    return pa.RecordBatch.from_arrays([_signed(keys), _signed(repeated)], ["key", "line"])


def _walker(run_pairs: int):
    """Candidate pairs out of rows sorted by key; rows of too long a run leave marked heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 4 * run_pairs  # rows of one run that are held at most
        tail: list[np.ndarray] | None = None
        long_key: int | None = None
        for batch in batches:
            keys, lines = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            if tail is not None:
                keys, lines = np.concatenate([tail[0], keys]), np.concatenate([tail[1], lines])
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            last = int(starts[-1])
            if len(starts) > 1 and int(keys[0]) == long_key:
                yield out([], [], keys[: starts[1]], lines[: starts[1]])
                starts = starts[1:]
            yield work(keys, lines, starts)
            tail = [keys[last:], lines[last:]]
            if int(keys[last]) == long_key or len(keys) - last > limit:
                long_key = int(keys[last])
                yield out([], [], *tail)
                tail = None
        if tail is not None:
            yield work(*tail, np.array([0, len(tail[0])]))

    def out(a, b, keys, lines) -> pa.RecordBatch:
        heavy = np.concatenate([np.zeros(len(a), bool), np.ones(len(keys), bool)])
        first, second = (np.array(x, np.uint64) for x in (a, b))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([first, keys]).view(np.int64)),
                pa.array(np.concatenate([second, lines]).view(np.int64)),
                pa.array(heavy),
            ],
            ["a", "b", "heavy"],
        )

    def work(keys, lines, bounds) -> pa.RecordBatch:
        pairs: set[tuple[int, int]] = set()
        heavy_keys, heavy_lines = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        if len(bounds) > 1:
            inside = lines[: bounds[-1]]
            numbers, roles = inside >> np.uint64(1), (inside & np.uint64(1)).astype(np.int64)
            starts = bounds[:-1]
            probing = np.add.reduceat(roles[starts[0] :], starts - starts[0])
            several = np.minimum.reduceat(numbers[starts[0] :], starts - starts[0]) != (
                np.maximum.reduceat(numbers[starts[0] :], starts - starts[0])
            )
            sizes = np.diff(bounds)
            for at in np.flatnonzero(several & (probing > 0) & (probing < sizes)).tolist():
                start, end = int(bounds[at]), int(bounds[at + 1])
                own, asking = set(), set()
                for x in lines[start:end].tolist():
                    (asking if x & 1 else own).add(x & ~1)
                if len(own) * len(asking) > run_pairs:
                    heavy_keys.append(keys[start:end])
                    heavy_lines.append(lines[start:end])
                    continue
                pairs.update((min(x, y), max(x, y)) for x in own for y in asking if x != y)
        a, b = zip(*pairs) if pairs else ((), ())
        return out(a, b, np.concatenate(heavy_keys), np.concatenate(heavy_lines))

    return run


def _walked(keys: DataFrame, run_pairs: int, name: str) -> DataFrame:
    ordered = keys.repartition("key").sortWithinPartitions("key")
    return stored(map_batches(ordered, _walker(run_pairs), "a long, b long, heavy boolean"), name)


def _places(number: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bit filter for each line number."""
    mixed = number * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)) % np.uint64(n_bits), (mixed >> np.uint64(3)) % np.uint64(n_bits - 1)


def _filter_of(lines: DataFrame) -> tuple[np.ndarray, int]:
    """A bit filter of the distinct ``line`` numbers, of at most ``MAX_BITS`` bits."""
    n_bits = int(min(MAX_BITS, max(1 << 12, BITS_PER_LINE * lines.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unique(np.concatenate(_places(number, n_bits)))
            words, starts = np.unique(bits >> np.uint64(6), return_index=True)
            masks = np.uint64(1) << (bits & np.uint64(63))
            merged = np.bitwise_or.reduceat(masks, starts) if len(starts) else masks
            yield pa.RecordBatch.from_arrays([_signed(words), _signed(merged)], ["word", "mask"])

    found = map_batches(lines, run, "word long, mask long").groupBy("word")
    words = np.zeros(n_bits // 64 + 1, np.int64)
    for part in found.agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        words[part["word"]] = part["mask"]
    return words.view(np.uint64), n_bits


def _texts_of(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """``line`` and ``content``, once each, of the lines whose number is in ``lines``.

    A bit filter of bounded size goes to the tasks; only lines that pass it are shuffled, and
    the join decides. Different contents with one number are all returned.
    """
    words, n_bits = _filter_of(lines)
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            found = [x for text in row_bytes(batch.column(1)) for x in lines_of(text) if x]
            number = np.array([digest64(x) for x in found], np.uint64)
            inside = np.ones(len(number), bool)
            for place in _places(number, n_bits):
                inside &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            at = [i for i in np.flatnonzero(inside).tolist() if found[i] not in seen]
            at = list({found[i]: i for i in at}.values())
            if len(seen) < SEEN // 20:
                seen.update(found[i] for i in at)
            yield pa.RecordBatch.from_arrays(
                [_signed(number[at]), pa.array([found[i] for i in at], pa.binary())],
                ["line", "content"],
            )

    passed = map_batches(texts, run, "line long, content binary")
    return passed.join(lines, "line", "left_semi").distinct()


def within(a: str, b: str, threshold: int) -> bool:
    return bool(_within_many([(a, b)], threshold)[0])


def _stripped(a: str, b: str) -> tuple[str, str]:
    """Both without what they share at the front and at the back."""

    def shared(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
        return low

    front = shared(a, b)
    a, b = a[front:], b[front:]
    back = shared(a[::-1], b[::-1])
    return a[: len(a) - back], b[: len(b) - back]


def _within_many(pairs: list[tuple[str, str]], threshold: int) -> np.ndarray:
    """Whether each pair is within the edit distance.

    For each pair and each number of errors, the bits of one word are the diagonals of the
    band that can be reached; one column of all pairs is worked off at a time.
    """
    result = np.zeros(len(pairs), bool)
    rest = []
    for at, (a, b) in enumerate(pairs):
        a, b = _stripped(a, b)
        if abs(len(a) - len(b)) <= threshold:
            if max(len(a), len(b)) <= threshold:
                result[at] = True
            else:
                rest.append((max(len(a), len(b)), at, a, b))
    rest.sort()
    while rest:
        # Pairs of like length together, in blocks of bounded size.
        width = rest[-1][0]
        block = rest[-max(1, 2_000_000 // (width + 1)) :]
        del rest[-len(block) :]
        result[[x[1] for x in block]] = _banded([x[2:] for x in block], width, threshold)
    return result


def _linked(pairs: list[tuple[str, str]], threshold: int, scale: int) -> np.ndarray:
    """Whether each pair is within the edits that its shorter line allows."""
    result = np.zeros(len(pairs), bool)
    edits = np.array([allowed(min(len(a), len(b)), threshold, scale) for a, b in pairs], np.int64)
    for n in np.unique(edits).tolist():
        at = np.flatnonzero(edits == n)
        result[at] = _within_many([pairs[k] for k in at.tolist()], n)
    return result


def _banded(pairs: list[tuple[str, str]], width: int, threshold: int) -> np.ndarray:
    n, band = len(pairs), 2 * threshold + 1
    pattern = np.zeros((n, width + 2 * threshold + 1), np.uint32)
    text = np.full((n, width + 1), 0xFFFFFFFF, np.uint32)
    for row, (a, b) in enumerate(pairs):
        pattern[row, threshold : threshold + len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32) + 1
        text[row, : len(b)] = np.frombuffer(b.encode("utf-32-le"), np.uint32) + 1
    ends = np.array([len(b) for _, b in pairs])
    goal = np.array([len(a) - len(b) + threshold for a, b in pairs])
    full = (1 << band) - 1
    weights = (1 << np.arange(band)).astype(np.uint32)
    # Diagonals by number of errors before the first character; bit ``threshold`` is the middle.
    reached = [np.full(n, 1 << threshold, np.uint32)]
    for _ in range(threshold):
        reached.append(reached[-1] | (reached[-1] << np.uint32(1)) & np.uint32(full))
    best = np.zeros(n, bool)
    for column in range(width + 1):
        done = ends == column
        if done.any():
            best[done] = (reached[-1][done] >> goal[done].astype(np.uint32)) & 1 == 1
        if column == width or not reached[-1].any():
            break
        equal = pattern[:, column : column + band] == text[:, column, None]
        match = (equal * weights).sum(1, dtype=np.uint32)
        following = [reached[0] & match]
        for errors in range(1, threshold + 1):
            before = reached[errors - 1]
            step = (
                (reached[errors] & match)
                | before
                | (before >> np.uint32(1))
                | (following[-1] << np.uint32(1))
            )
            following.append(step & np.uint32(full))
        reached = following
    return best


def _verified(pairs: DataFrame, contents: DataFrame, threshold: int, scale: int) -> DataFrame:
    """``a`` and ``b``, contents of linked lines, out of candidate pairs of numbers."""
    left = contents.select(F.col("line").alias("a"), F.col("content").alias("x"))
    right = contents.select(F.col("line").alias("b"), F.col("content").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[v.decode() for v in c.to_pylist()] for c in batch.columns]
            near = _linked(list(zip(*texts)), threshold, scale)
            yield batch.filter(pa.array(near))

    joined = pairs.join(left, "a").join(right, "b").where("x != y").select("x", "y")
    return map_batches(joined, run, "x binary, y binary")


def _rest_keys(heavy: DataFrame, contents: DataFrame, threshold: int, scale: int) -> DataFrame:
    """Keys of the rests of lines in long runs: the line without the segment they share.

    A rest of too few characters to be cut has the key of its run.
    """
    rows = heavy.withColumn("number", F.col("line").bitwiseAND(F.lit(-2))).join(
        contents.withColumnRenamed("line", "number"), "number"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys: list[int] = []
            lines: list[int] = []
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for key, line, content in rows:
                key, line, found = key & MASK, line & MASK, set()
                cut, length = _cutter(content)
                plan = (
                    probes(length, threshold, None, scale)
                    if line & 1
                    else indexed(length, threshold, scale)
                )
                for seed, start, end in plan:
                    if digest(cut(start, end), seed) != key:
                        continue
                    rest, size = _cutter(cut(0, start) + cut(end, length))
                    whole = seed // (threshold + 1)
                    edits, shorter = allowed(whole, threshold, scale), whole - (end - start)
                    if shorter <= edits:
                        found.add(key)
                        continue
                    parts = probes(size, edits, shorter) if line & 1 else indexed(size, edits)
                    found.update(digest(rest(s, e), (key + k) & MASK) for k, s, e in parts)
                keys += found
                lines += [line] * len(found)
            yield pa.RecordBatch.from_arrays([_signed(keys), _signed(lines)], ["key", "line"])

    return map_batches(rows.select("key", "line", "content"), run, "key long, line long")


def _character_counts(texts: list[str]) -> np.ndarray:
    found = np.zeros((len(texts), BINS), np.int32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found[row] = np.bincount(codes % BINS, minlength=BINS)
    return found


def _links_within(
    own: list[str], asking: list[str], threshold: int, scale: int = 0
) -> set[tuple[str, str]]:
    """Links between two lists of lines. An edit changes counts of characters by two at most."""
    ours, theirs = _character_counts(own), _character_counts(asking)
    near: list[tuple[str, str]] = []
    links: set[tuple[str, str]] = set()

    def verify() -> None:
        kept = _linked(near, threshold, scale)
        links.update((min(p), max(p)) for p, k in zip(near, kept) if k)
        near.clear()

    for text, counts in zip(own, ours):
        for at in np.flatnonzero(np.abs(theirs - counts).sum(1) <= 2 * threshold).tolist():
            if asking[at] != text:
                near.append((text, asking[at]))
        if len(near) > 20_000:
            verify()
    verify()
    return links


def _blocked(
    long: DataFrame, contents: DataFrame, threshold: int, block: int, scale: int
) -> DataFrame:
    """Links between lines of one key, for keys of many lines (``key``, ``line``)."""
    blocks = long.groupBy("key").agg(
        F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")
    )
    rows = (
        long.withColumn("number", F.col("line").bitwiseAND(F.lit(-2)))
        .join(contents.withColumnRenamed("line", "number"), "number")
        .join(blocks, "key")
        .withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "line", "content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, asking = None, [], []
        for batch in batches:
            for *key, line, content in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    yield found(own, asking)
                    now, own, asking = key, [], []
                (asking if line & 1 else own).append(content.decode())
        yield found(own, asking)

    def found(own: list[str], asking: list[str]) -> pa.RecordBatch:
        links = sorted(_links_within(own, asking, threshold, scale))
        columns = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([x.encode() for x in c], pa.binary()) for c in columns], ["x", "y"]
        )

    keys = ["key", "low", "high"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    return map_batches(ordered, run, "x binary, y binary")


def line_links(
    df: DataFrame,
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_pairs: int = RUN_PAIRS,
    block: int = BLOCK,
    scaled: bool = False,
) -> DataFrame:
    """``x`` and ``y``: every pair of different lines within the distance, once."""
    # With ``scaled`` a line is compared as long as its length allows an edit.
    scale = min_chars if scaled else 0
    shortest = -(-min_chars // threshold) if scaled and threshold else min_chars
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    walked = _walked(line_keys(texts, threshold, shortest, scale), run_pairs, "line-candidates")
    light = walked.where("not heavy").select("a", "b")
    # Copies of a line from many tasks are one row from here on.
    heavy = walked.where("heavy").select(F.col("a").alias("key"), F.col("b").alias("line")).distinct()
    heavy_lines = heavy.select(F.col("line").bitwiseAND(F.lit(-2)).alias("line"))
    wanted = light.select(F.explode(F.array("a", "b")).alias("line")).unionByName(heavy_lines)
    contents = stored(_texts_of(texts, stored(wanted.distinct(), "wanted")), "line-texts")
    rests = _walked(_rest_keys(heavy, contents, threshold, scale), run_pairs, "rest-candidates")
    long = rests.where("heavy").select(F.col("a").alias("key"), F.col("b").alias("line")).distinct()
    candidates = light.union(rests.where("not heavy").select("a", "b")).distinct()
    links = _verified(candidates, contents, threshold, scale).select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    )
    return links.unionByName(_blocked(long, contents, threshold, block, scale)).distinct()


def _occurrences(texts: DataFrame) -> DataFrame:
    """Every line that is not blank: its document, number and 128-bit class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, classes = [], [], []
            for row, text in enumerate(row_bytes(batch.column(1))):
                for number, line in enumerate(lines_of(text)):
                    if line.strip():
                        rows.append(row)
                        numbers.append(number)
                        classes.append(xxhash.xxh3_128_digest(line))
            halves = np.frombuffer(b"".join(classes), ">u8").astype(np.uint64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(2).take(at),
                    pa.array(numbers, pa.int32()),
                    _signed(halves[:, 0].copy()),
                    _signed(halves[:, 1].copy()),
                ],
                ["doc_id", "tie", "number", "high", "low"],
            )

    schema = "doc_id long, tie long, number int, high long, low long"
    return map_batches(texts, run, schema)


def _class_links(links: DataFrame) -> DataFrame:
    """Links in both directions, as classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns:
                data = b"".join(xxhash.xxh3_128_digest(line) for line in row_bytes(column))
                sides.append(np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2))
            a, b = sides
            columns = np.hstack([np.vstack([a, b]), np.vstack([b, a])])
            yield pa.RecordBatch.from_arrays(
                [_signed(columns[:, k].copy()) for k in range(4)],
                ["high", "low", "other_high", "other_low"],
            )

    return map_batches(links, run, "high long, low long, other_high long, other_low long")


def line_decisions(
    df: DataFrame,
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_pairs: int = RUN_PAIRS,
    block: int = BLOCK,
    chains: bool = False,
    at_once: int = AT_ONCE,
    scaled: bool = False,
) -> DataFrame:
    """One row per document that has a line to drop, or a linked line.

    ``dropped`` are line numbers, ``sources`` the ids of the documents that have the
    earliest equal or linked line of each (with ``chains`` the earliest that stays),
    ``n_links`` counts the linked classes of all lines.
    """
    texts = _tied(df, id_col, text_col)
    links = stored(
        _class_links(
            line_links(df, threshold, min_chars, id_col, text_col, run_pairs, block, scaled)
        ),
        "class-links",
    )
    rows = stored(_occurrences(texts), "occurrences")
    place = F.struct("doc_id", "tie", "number").alias("place")
    kind = ["high", "low"]
    classes = rows.groupBy(*kind).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Only classes that repeat or are linked can make a line go: all others end here.
    firsts = stored(
        classes.join(links.groupBy(*kind).agg(F.count("*").alias("links")), kind, "left").where(
            "n > 1 or links is not null"
        ),
        "line-classes",
    )
    linked = firsts.where("links is not null")
    other = linked.select(
        F.col("high").alias("other_high"), F.col("low").alias("other_low"),
        F.col("first").alias("other_first"),
    )
    near = links.join(other, ["other_high", "other_low"])
    if chains:
        # Only earlier classes count, and of these only those that stay.
        edges = stored(
            near.join(linked.select(*kind, "first"), kind)
            .where("other_first < first")
            .select(*kind, "other_high", "other_low", "other_first"),
            "chain-links",
        )
        behind = edges.select(*kind, "other_high", "other_low")
        gone = chains_of.gone(behind, at_once).select(
            F.col("high").alias("other_high"), F.col("low").alias("other_low")
        )
        near = edges.join(gone, ["other_high", "other_low"], "left_anti")
    earliest = near.groupBy(*kind).agg(F.min("other_first").alias("near"))
    source = F.when(F.col("near") < F.col("first"), F.col("near")).otherwise(F.col("first"))
    # A table of its own, so that its join with the rows is between two fresh shuffles, which
    # AQE splits at a line that very many rows have.
    decided = stored(
        firsts.join(earliest, kind, "left").select(
            *kind, source.alias("source"), F.coalesce("links", F.lit(0)).alias("links")
        ),
        "decisions",
    )
    drops = F.col("source") < place
    # Sets, as rows that are equal in id and text count as one document.
    by_document = (
        rows.join(decided, kind)
        .groupBy("doc_id", "tie")
        .agg(
            F.sort_array(F.collect_set(F.when(drops, F.col("number")))).alias("dropped"),
            F.sort_array(F.collect_set(F.when(drops, F.col("source.doc_id")))).alias("sources"),
            F.collect_set(F.struct("number", "links")).alias("linked"),
        )
    )
    n_links = F.aggregate("linked", F.lit(0).cast("long"), lambda n, x: n + x["links"])
    return by_document.select("doc_id", "tie", "dropped", "sources", n_links.alias("n_links"))


def _tied(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        F.xxhash64(text).alias("tie"), *more,
    )


def deduplicated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Every document with its kept text.

    ``doc_id``, ``text`` (kept lines joined by line breaks), ``n_lines``, ``n_removed``,
    ``n_links`` and ``sources``, then the ``columns`` asked for, unchanged. Texts are
    compressed where they move whole.
    """
    decisions = line_decisions(df, id_col=id_col, text_col=text_col, **options)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [work(text) for text in row_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(texts, pa.binary()), *batch.columns[3:]],
                ["doc_id", "tie", "packed", *columns],
            )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, counts = [], []
            for packed, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = work(packed).split(b"\n")
                counts.append(len(lines))
                for number in reversed(dropped or ()):
                    del lines[number]
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    *batch.columns[3:],
                ],
                ["doc_id", "text", "n_lines", *batch.schema.names[3:]],
            )

    more = [df.schema[name] for name in columns]
    packed_schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("tie", T.LongType()),
            T.StructField("packed", T.BinaryType()),
            *more,
        ]
    )
    packed = map_batches(_tied(df, id_col, text_col, *columns), pack, packed_schema).alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p.tie") == F.col("d.tie"))
    joined = packed.join(decisions.alias("d"), same, "left").select(
        "p.doc_id",
        "packed",
        "d.dropped",
        F.coalesce(F.size("d.dropped"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("d.n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("d.sources", F.array().cast("array<long>")).alias("sources"),
        *[f"p.{name}" for name in columns],
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            *joined.schema.fields[3:],
        ]
    )
    return map_batches(joined, unpack, schema)
