"""Ranked lexical search by presence-mask grouping.

Terms are the words of ``decontaminate.words_of``: runs of ASCII letters, digits and
non-ASCII characters, A-Z in lower case. A document's score for an item is the sum over the
item's distinct terms of ``weight * impact``, in 64-bit integers:

* ``weight = floor(1000 * ln((2N + 2) / (2df + 1)))``, with N documents that hold any term;
* ``impact = 1000000000 * tf div (1000 * tf + 8 * m)``, ``m = 10 + 90 * n * N div L``, with n
  terms of the document and L of all documents.

Two passes. The first cuts every text into words once and stores its postings: the terms that
any item asks for, with their counts. N, L and df are summed from them. The second goes
through the postings of a task, many documents at a time. Each term has a bitmap of the
documents that hold it; the bitmaps of an item's terms, packed across, are each document's mask of
matched terms. Documents of one mask are a group, whose score is at most the sum of the
weights of its terms times the largest impact of each. Groups are evaluated by descending
bound until the next bound is below the score of the last place; a task keeps that score
from batch to batch. A task gives its best few of each item, and these are merged.

Work and memory: documents are never joined with items; a task holds a batch of postings and a
block of items of bounded size. Items beyond ``BLOCK_BYTES`` of text are searched block by block.

A null or wordless document has no terms and is never found, nor counted in N; a wordless item
finds nothing. Equal rows of items are one item; rows with one id and different texts are
items of their own, both under that id. Repeated documents each take a place. Among equal scores
the smaller id is first, a null id last.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shopledger.llm.common import map_batches, row_bytes, stored
from shopledger.llm.decontaminate import words_of

BLOCK_BYTES = 4 << 20
POSTING_BYTES = 16 << 20
# Cells (terms by documents) that an item's bitmaps may have at once.
CELLS = 8 << 20
FIRST_CHUNK = 64

# Constants of the score (fixed values).
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 8
LEAST_LENGTH, LENGTH_SHARE = 10, 90


def item_blocks(items: DataFrame, limit: int) -> Iterator[list]:
    """The items as lists of rows with about ``limit`` bytes of text."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        yield items.where(mine).collect()


def postings(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (all terms), and the asked terms of every document with their counts."""
    sent = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, asked, times = [], [], []
            for text in row_bytes(batch.column(1)):
                words = words_of(text)
                counts = Counter(words)
                found = counts.keys() & known.keys()
                sizes.append(len(words))
                asked.append([known[word] for word in found])
                times.append([counts[word] for word in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(asked, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return map_batches(documents, run, "doc_id long, n long, terms array<int>, times array<int>")


class Postings:
    """Postings of a batch of documents by term, with their impacts."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, n_docs: int, n_words: int):
        self.ids = batch.column(0).to_pylist()
        n = batch.column(1).to_numpy(zero_copy_only=False)
        lengths = LEAST_LENGTH + (LENGTH_SHARE * n * n_docs) // max(n_words, 1)
        asked, times = batch.column(2), batch.column(3)
        per_doc = np.diff(asked.offsets.to_numpy())
        docs = np.repeat(np.arange(len(n)), per_doc)
        terms = asked.flatten().to_numpy(zero_copy_only=False)
        tf = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        impacts = (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * lengths[docs])
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.highest[held] = np.maximum.reduceat(self.impacts, self.starts[held])

    def of(self, term: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``first`` to ``last`` that hold a term, counted from there, and impacts."""
        start, stop = self.starts[term], self.starts[term + 1]
        at = start + np.searchsorted(self.docs[start:stop], [first, last])
        return self.docs[at[0] : at[1]] - first, self.impacts[at[0] : at[1]]


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a table of terms by documents, and each document's one."""
    packed = np.ascontiguousarray(np.packbits(present, axis=0).T)
    if packed.shape[1] <= 8:
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        keys = wide.view(np.uint64).ravel()
    else:
        keys = packed.view(f"V{packed.shape[1]}").ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return present[:, first], group


class Best:
    """The best few documents of an item, as (-score, id is null, id)."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def lowest(self) -> int:
        """What a document must reach at least; equal scores may win by id."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        good = np.flatnonzero(scores >= self.lowest()).tolist()
        new = [(-int(scores[k]), ids[k] is None, ids[k] or 0) for k in good]
        self.rows = sorted(self.rows + new)[: self.top]


def search(
    held: Postings, terms: np.ndarray, weights: np.ndarray, best: Best, cells: int = CELLS
) -> int:
    """Put the batch's best documents for an item into ``best``; how many were evaluated."""
    terms = terms[(weights[terms] > 0) & (held.highest[terms] > 0)]
    if not len(terms):
        return 0
    evaluated, step = 0, max(1, cells // len(terms))
    for first in range(0, len(held.ids), step):
        last = min(first + step, len(held.ids))
        impacts = np.zeros((len(terms), last - first), np.int64)
        present = np.zeros(impacts.shape, bool)
        for row, term in enumerate(terms.tolist()):
            docs, found = held.of(term, first, last)
            impacts[row, docs], present[row, docs] = found, True
        masks, group = masks_of(present)
        bounds = (weights[terms] * held.highest[terms]) @ masks
        evaluated += _by_mask(bounds, group, impacts, weights[terms], held.ids[first:last], best)
    return evaluated


def _by_mask(bounds, group, impacts, weights, ids, best: Best) -> int:
    """Evaluate groups of documents by descending bound until the next cannot reach a place."""
    members = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(bounds)))
    begins = np.concatenate([[0], ends[:-1]])
    ordered = np.argsort(-bounds, kind="stable")
    ahead = np.cumsum((ends - begins)[ordered])
    at, chunk, done = 0, FIRST_CHUNK, 0
    while at < len(ordered) and bounds[ordered[at]] >= best.lowest():
        # As many whole groups as have about ``chunk`` documents, at least one; no group that
        # cannot reach a place.
        stop = max(at + 1, int(np.searchsorted(ahead, done + chunk, side="right")))
        groups = ordered[at:stop]
        groups = groups[bounds[groups] >= best.lowest()]
        docs = np.concatenate([members[begins[g] : ends[g]] for g in groups.tolist()])
        best.add(weights @ impacts[:, docs], [ids[k] for k in docs.tolist()])
        at, done, chunk = stop, done + len(docs), chunk * 2
    return done


def _found(
    held: DataFrame, items: list[tuple[int | None, list[int]]], weights: list[int], counts, top: int
) -> DataFrame:
    """``number``, ``item_id``, ``doc_id`` and ``score``: each task's best for every item of a block.

    ``items`` are ids and terms; the number of an item is its place there.
    """
    sent = held.sparkSession.sparkContext.broadcast((items, weights, *counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, n_docs, n_words = sent.value
        asked = [(item_id, np.array(terms, np.int64), Best(top)) for item_id, terms in asked]
        weight = np.array(weight, np.int64)
        for batch in batches:
            batch_postings = Postings(batch, len(weight), n_docs, n_words)
            for _, terms, best in asked:
                search(batch_postings, terms, weight, best)
        rows = [
            (number, item_id, None if null else doc, -score)
            for number, (item_id, _, best) in enumerate(asked)
            for score, null, doc in best.rows
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)],
            ["number", "item_id", "doc_id", "score"],
        )

    schema = "number long, item_id long, doc_id long, score long"
    return map_batches(held, run, schema, POSTING_BYTES)


def ranked(
    documents: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's best documents."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")
    ).where(F.col("text").isNotNull())
    results = []
    for rows in item_blocks(asked.distinct(), block_bytes):
        words = [sorted(set(words_of(row.text.encode()))) for row in rows]
        terms = {word: k for k, word in enumerate(sorted(set().union(*words)))}
        held = stored(postings(texts, terms), "postings")
        n_docs, n_words = held.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        document_counts = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [
            math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * document_counts.get(k, 0) + 1)))
            for k in range(len(terms))
        ]
        with_ids = [(row.item_id, [terms[word] for word in mine]) for row, mine in zip(rows, words)]
        found = _found(held, with_ids, weights, (n_docs, n_words or 0), top)
        # A window whose limit Spark applies in every task before it moves rows.
        place = F.row_number().over(
            Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        )
        best = found.withColumn("rank", place).where(F.col("rank") <= top)
        results.append(best.select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)
