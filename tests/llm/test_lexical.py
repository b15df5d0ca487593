"""Ranked search against a plain evaluation of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shopledger.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def expected(docs, items, top):
    held = [(doc, terms(text)) for doc, text in docs]
    n_docs, n_words = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in set(items):
        asked = set(terms(text))
        df = {t: sum(t in mine for _, mine in held) for t in asked}
        rows = []
        for doc, mine in held:
            m = 100 - 90 + (90 * len(mine) * n_docs) // max(n_words, 1)
            score = 0
            for t in asked & set(mine):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                tf = mine.count(t)
                score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, r[2], -r[0]) for k, r in enumerate(rows[:top])]
    return sorted(map(str, out))


def case(seed, n=120):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(30)] + ["The", "the", "Élan", "straße", "9", "x_y"]
    say = lambda k: " ".join(rng.choices(pool, range(len(pool), 0, -1), k=k))
    docs = [(k, say(rng.randint(0, 25))) for k in range(n)]
    docs += [(500, docs[3][1]), (3, docs[4][1]), (None, docs[3][1]), (600, None), (601, "?! .")]
    docs += [(700, say(3000)), *[(800 + k, "w1 w2 w3") for k in range(20)]]
    items = [(k, say(rng.randint(1, 12))) for k in range(12)]
    items += [(0, "w1 w2"), (40, None), (41, "..."), (42, "unheard"), (None, "w5 w6"), items[1]]
    return docs, items + [(43, " ".join(pool))]


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 60])
def test_same_as_every_document_scored(spark, block):
    docs, items = case(4)
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 as rank", "2 as n", "'x' as terms"
    )
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score")
    rows = lexical.ranked(documents.repartition(5), benchmark, top=7, block_bytes=block).collect()
    plain = [(i, t) for i, t in items if t is not None]
    assert sorted(str(tuple(r)) for r in rows) == expected(docs, plain, 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == []
    found = lexical.ranked(docs, items.limit(0))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def held(texts):
    words = sorted({t for text in texts for t in text.split()})
    asked = [sorted({words.index(t) for t in text.split()}) for text in texts]
    times = [[text.split().count(words[k]) for k in row] for text, row in zip(texts, asked)]
    n = [len(text.split()) for text in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(n, pa.int64()),
         pa.array(asked, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
        ["doc_id", "n", "terms", "times"],
    )
    return lexical.Postings(batch, len(words), len(texts), sum(n)), words


def test_masks_spare_most_documents():
    rare = ["common rare second"] * 5
    store, words = held(rare + ["common filler"] * 5000)
    weights = np.array([{"common": 1, "rare": 9000, "second": 8000}.get(w, 5) for w in words])
    asked = np.array([words.index(w) for w in ("common", "rare", "second")])
    best = lexical.Best(5)
    assert lexical.search(store, asked, weights, best) == 5
    assert [row[2] for row in best.rows] == [0, 1, 2, 3, 4]


def test_items_of_many_terms_are_cut():
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"t{k}" for k in range(90)], k=40)) for _ in range(300)]
    store, words = held(texts)
    weights = np.array([rng.randint(0, 5000) for _ in words])
    asked = np.arange(len(words))
    whole, cut = lexical.Best(10), lexical.Best(10)
    lexical.search(store, asked, weights, whole)
    lexical.search(store, asked, weights, cut, cells=len(words) * 17)
    assert whole.rows == cut.rows and len(whole.rows) == 10
