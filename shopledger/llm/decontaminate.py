"""Benchmark decontamination with one Aho-Corasick automaton over word symbols.

Benchmark texts and documents are normalised alike: A-Z in lower case, words are
runs of ASCII letters, digits and non-ASCII characters. Every word of the benchmark
becomes one symbol, so a window of ten words is a string of ten symbols and a match
ends at a word number of the document. One automaton (``automaton``) holds all windows;
each text is scanned once, and hits are mapped back to character offsets of the original.

A task makes the automaton out of the distinct benchmark rows. Its arrays reach the driver in
pieces, as a file, which Spark gives to every executor once; the workers map it and share its
pages. It takes up to 21 bytes for each word of a window, and nothing else grows with the
benchmark: documents are read by one stage and nothing is shuffled, at every size.

A null or wordless document has no words and no hits; a null or wordless item has no
window. Equal windows of several items count for each; a repeated item id counts once.
Items without id are searched as all others; together they are one item, which stands in
``item_ids`` as one null before the others. Repeated document rows are kept, each with
its result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from shopledger.llm.automaton import WORDS, Automaton, Words, build, cover, words_in
from shopledger.llm.common import kept_by, map_batches, row_bytes, stored

PIECE_BYTES = 8 << 20
SCAN_BYTES = 2 << 20

_AUTOMATA: dict[str, Automaton] = {}
kept_by(__name__, _AUTOMATA.clear)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _made(items: DataFrame, window: int) -> DataFrame:
    """The automaton of all items, as numbered pieces of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str | None] = []
        texts: list[bytes] = []
        for batch in batches:
            names += batch.column(0).to_pylist()
            texts += row_bytes(batch.column(1))
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "automaton")
            build(texts, names, window).save(path)
            del texts, names
            with open(path, "rb") as file:
                for number, data in enumerate(iter(lambda: file.read(PIECE_BYTES), b"")):
                    columns = [pa.array([number], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["number", "data"])

    return map_batches(items.coalesce(1), run, "number int, data binary")


def _sent(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> str:
    """The name of the automaton's file on all executors."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")
    ).where(F.col("text").isNotNull())
    pieces = stored(_made(items.distinct(), window), "automaton")
    name = f"automaton-{uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="shopledger-automaton-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    build([], [], window).save(path)  # stays if there is no item at all
    for row in pieces.orderBy("number").toLocalIterator():
        with open(path, "ab" if row.number else "wb") as file:
            file.write(row.data)
    benchmark.sparkSession.sparkContext.addFile(path)
    return name


def _opened(name: str) -> Automaton:
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = Automaton.load(SparkFiles.get(name))
    return _AUTOMATA[name]


def _hits(automaton: Automaton, texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, list[set]]:
    """Words of the texts, which of them are hit, where each text's words begin, items found."""
    words = words_in(texts)
    ends, states = automaton.matches(words)
    hit = cover(len(words.starts), ends, automaton.depth(states))
    begins = np.concatenate([[0], np.cumsum(words.counts)])
    text = np.searchsorted(begins, ends, side="right") - 1
    # A pattern that a text has often is looked up once.
    pairs = np.unique(np.stack([text, states], 1), axis=0) if len(ends) else np.empty((0, 2), int)
    owners, of = automaton.owners_of(pairs[:, 1])
    found: list[set] = [set() for _ in texts]
    for row, owner in zip(pairs[of, 0].tolist(), owners.tolist()):
        found[row].add(automaton.name(owner))
    return words, hit, begins, found


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """First and last number of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(numbers) > 1)
    firsts = numbers[np.concatenate([[0], cuts + 1])]
    return list(zip(firsts.tolist(), numbers[np.concatenate([cuts, [-1]])].tolist()))


def _spans(text: bytes, at: int, words: Words, hits: np.ndarray) -> list[dict]:
    """Character offsets in the text, which begins ``at`` in the words' data, of runs of hit words."""
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    out = []
    for first, last in _runs(hits):
        start, end = int(words.starts[first]) - at, int(words.ends[last]) - at
        out.append({"start": int(chars[start]) - 1, "end": int(chars[end - 1])})
    return out


SCAN_SCHEMA = (
    "doc_id long, n_words long, n_hit long, item_ids array<string>, "
    "spans array<struct<start:int,end:int>>"
)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For every row: ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings, null first), ``spans``.

    ``spans`` are the character offsets in the original text of each run of hit words.
    """
    name = _sent(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = list(row_bytes(batch.column(1)))
            words, hit, begins, found = _hits(_opened(name), texts)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[begins])
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
            items, spans = [], []
            for k, names in enumerate(found):
                items.append(sorted(names, key=lambda name: (name is not None, name)))
                mine = begins[k] + np.flatnonzero(hit[begins[k] : begins[k + 1]]) if names else []
                spans.append(_spans(texts[k], int(offsets[k]), words, mine) if names else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words.counts, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, spans_kind),
                ],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, SCAN_SCHEMA, SCAN_BYTES)


def clean(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows, with all their columns, in which no benchmark window occurs."""
    name = _sent(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _hits(_opened(name), list(row_bytes(batch.column(text_col))))[3]
            yield batch.filter(pa.array([not names for names in found], pa.bool_()))

    return map_batches(df, run, df.schema, SCAN_BYTES)
