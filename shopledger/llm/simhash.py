"""SimHash near-duplicates: fingerprints, deletion-variant join, components.

A fingerprint bit is set where over half of the shingle hashes have it set.
Fingerprints within ``max_distance`` bits are found by cutting the 64 bits into
``max_distance // 2 + 1`` segments: one of them then differs in at most one bit, so
two such fingerprints share a segment with one bit wildcarded. Every fingerprint
is indexed under each one-wildcard variant of each segment, variants are matched
by equality, and matches are verified on all 64 bits.

Equal fingerprints are one node of the graph, so copies cost nothing. A run of
equal variants is walked in the task that holds it and leaves at most one edge
for each member; a longer run than ``RUN`` is dealt out again in pairs of blocks.

Nulls and texts without words have fingerprint zero and link like any other;
repeated rows are kept; a row without id never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shopledger.llm.common import map_batches, row_bytes, stored
from shopledger.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
# Members of one variant that a task compares at once; longer runs are cut into blocks.
RUN = 4096


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit fingerprint of a UTF-8 text over its word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    hashes = [
        digest(joined[start:end], SEED) for start, end in zip(starts, ends[shingle - 1 :].tolist())
    ]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and ``fp``, the fingerprint, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(text, shingle) for text in row_bytes(batch.column(1))),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found.view(np.int64))],
                ["doc_id", "tie", "fp"],
            )

    slim = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    return map_batches(slim, run, "doc_id long, tie long, fp long")


def segments(max_distance: int) -> list[tuple[int, int]]:
    """Shift and width of the segments of which one differs in at most one bit."""
    n = max_distance // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, max_distance: int) -> DataFrame:
    """``part``, ``bits`` and ``fp``: each segment of each fingerprint, one bit wildcarded."""
    keys = []
    for low, width in segments(max_distance):
        mask = (1 << width) - 1
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed(mask)))
        for bit in range(width):
            keys.append(
                F.struct(
                    F.lit(low + bit).alias("part"),
                    segment.bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))).alias("bits"),
                )
            )
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp").select("key.*", "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among the given distinct fingerprints."""
    left = np.ones(len(fps), bool)
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[at]) <= max_distance))
            if len(near):
                left[near] = False
                queue.extend(near.tolist())
                yield np.full(len(near), fps[at]), fps[near]


def _edges(a: list[np.ndarray], b: list[np.ndarray], heavy: bool, part: int = 0) -> pa.RecordBatch:
    left = np.concatenate(a) if a else np.empty(0, np.uint64)
    right = np.concatenate(b) if b else np.empty(0, np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(left.view(np.int64)),
            pa.array(right.view(np.int64)),
            pa.array(np.full(len(left), part, np.int32)),
            pa.array(np.full(len(left), heavy)),
        ],
        ["a", "b", "part", "heavy"],
    )


def _linker(max_distance: int, run_limit: int):
    """Walks rows sorted by their key columns; all but the last column are the key.

    Yields a forest for each run of equal keys. Rows of a run longer than
    ``run_limit`` leave as they are, marked heavy (``a`` the bits, ``b`` the fingerprint).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None  # the last run, which may go on in the next batch
        long_key: tuple | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if tail is not None:
                columns = [np.concatenate(pair) for pair in zip(tail, columns)]
            n = len(columns[0])
            if not n:
                continue
            changes = np.zeros(n - 1, bool)
            for key in columns[:-1]:
                changes |= key[1:] != key[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
            last, key_at = int(starts[-1]), lambda row: tuple(int(c[row]) for c in columns[:-1])
            if len(starts) > 1 and key_at(0) == long_key:
                yield heavy(columns, 0, int(starts[1]))
                starts = starts[1:]
            yield from work(columns, starts)
            tail = [c[last:] for c in columns]
            if key_at(last) == long_key or n - last > run_limit:
                long_key = key_at(last)
                yield heavy(columns, last, n)
                tail = None
        if tail is not None:
            yield from work(tail, np.array([0, len(tail[0])]))

    def heavy(columns, start, end) -> pa.RecordBatch:
        bits, fps = (c[start:end].astype(np.int64).view(np.uint64) for c in columns[-2:])
        return _edges([bits], [fps], True, int(columns[0][start]))

    def work(columns, bounds) -> Iterator[pa.RecordBatch]:
        fps, sizes = columns[-1].view(np.uint64), np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= max_distance
        a, b = [fps[pairs[near]]], [fps[pairs[near] + 1]]
        for at in np.flatnonzero(sizes > 2).tolist():
            start, end = int(bounds[at]), int(bounds[at + 1])
            if end - start > run_limit:
                yield heavy(columns, start, end)
                continue
            for left, right in _forest(fps[start:end], max_distance):
                a.append(left)
                b.append(right)
        yield _edges(a, b, False)

    return run


LINK_SCHEMA = "a long, b long, part int, heavy boolean"


def links(fps: DataFrame, max_distance: int = 3, run_limit: int = RUN) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` within the distance.

    Not every pair: a spanning forest of each group that shares a variant.
    """
    # Each fingerprint becomes 64 rows: spread first, as the few bytes here are one or two tasks.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = variants(fps.repartition(parts, "fp"), max_distance)
    walked = stored(
        map_batches(
            keyed.repartition("part", "bits").sortWithinPartitions("part", "bits"),
            _linker(max_distance, run_limit),
            LINK_SCHEMA,
        ),
        "variant-links",
    )
    # Long runs: members go to blocks, and each pair of blocks is compared in a task of its own.
    heavy = walked.where("heavy").select("part", F.col("a").alias("bits"), F.col("b").alias("fp"))
    blocks = heavy.groupBy("part", "bits").agg(
        F.ceil(F.count("*") * 2 / F.lit(run_limit)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = (
        heavy.join(blocks, ["part", "bits"])
        .select("part", "bits", "fp", block.alias("block"), other.alias("other"))
        .select(
            "part", "bits", F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"), "fp",
        )
    )
    keys = ["part", "bits", "low", "high"]
    rest = map_batches(
        paired.repartition(*keys).sortWithinPartitions(*keys),
        _linker(max_distance, 1 << 62),
        LINK_SCHEMA,
    )
    return walked.where("not heavy").select("a", "b").unionByName(rest.select("a", "b"))


def _rooted(
    df: DataFrame, shingle: int, max_distance: int, id_col: str, text_col: str, run_limit: int
) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and the root of each distinct fingerprint with its first id."""
    prints = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(nodes.select("fp"), max_distance, run_limit))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    # A table of its own, so that a fingerprint that very many rows have is a hot key between
    # two fresh shuffles, which AQE splits.
    return prints, stored(rooted, "roots")


def near_duplicates(
    df: DataFrame,
    shingle: int = 3,
    max_distance: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_limit: int = RUN,
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable, for every row."""
    prints, rooted = _rooted(df, shingle, max_distance, id_col, text_col, run_limit)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicated(
    df: DataFrame,
    shingle: int = 3,
    max_distance: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_limit: int = RUN,
) -> DataFrame:
    """The rows, with all their columns, that stay: of each component the one of smallest id.

    A row without id stays only if its component has none with one; of rows equal in id
    and text one stays.
    """
    prints, rooted = _rooted(df, shingle, max_distance, id_col, text_col, run_limit)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    first = prints.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("_id"), F.col("k.tie").alias("_tie"))
    number = F.col(id_col).cast("long")
    same = number.eqNullSafe(F.col("_id")) & F.xxhash64(text_col).eqNullSafe(F.col("_tie"))
    return df.join(kept, same).dropDuplicates(["_id", "_tie"]).drop("_id", "_tie")
