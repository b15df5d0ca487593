"""Removal of repeated strings against brute force over all strings."""

import random
from collections import Counter

import pytest

from shopledger.llm import suffix_dedup


def expected(texts, width):
    """For each text: its bytes, those left, and the maximal removed spans."""
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for text in texts:
        covered = bytearray(len(text))
        for i in range(len(text) - width + 1):
            if seen[text[i : i + width]] > 1:
                covered[i : i + width] = b"\1" * width
        spans, at = [], 0
        while at < len(text):
            stop = at
            while stop < len(text) and covered[stop]:
                stop += 1
            if stop > at:
                spans.append((at, stop))
            at = stop + 1
        out.append((bytes(x for x, c in zip(text, covered) if not c), len(text), spans))
    return out


def corpus(seed, letters, width):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(width - 2, 4 * width)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            passage = rng.choice(passages)
            if kind < 0.4:
                parts.append(passage)
            elif kind < 0.6:
                cut = sorted(rng.sample(range(len(passage)), 2))
                parts.append(passage[cut[0] : cut[1]])
            else:
                parts.append(word(rng.randint(1, 3 * width)))
        texts.append("".join(parts))
    return [*texts, texts[0], "ab" * 3 * width, letters[0] * 5 * width, letters[0] * width]


def found(spark, texts, **options):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in suffix_dedup.deduplicated(df, **options).collect()}
    return [
        (bytes(out[i].kept), out[i].n_bytes, [tuple(x) for x in out[i].removed])
        for i in range(len(texts))
    ]


@pytest.mark.parametrize(
    "width, letters, block",
    [(8, "abcdefgh", 4000), (13, "abc", 4000), (40, "abé\n", 4000), (12, "ab", 4), (21, "abc", 2)],
)
def test_same_as_all_strings(spark, width, letters, block, monkeypatch):
    texts = corpus(width, letters, width)
    options = {}
    if block < 4000:
        monkeypatch.setattr(suffix_dedup, "HELD", 8)
        options = {"queue_rows": 50}
    assert found(spark, texts, width=width, block=block, **options) == expected(
        [t.encode() for t in texts], width
    )


def test_many_rows_without_id(spark):
    """Rows are told apart by more than their text's short hash."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(3000)]
    texts += [f"{rng.random()} a passage that is in both texts, and repeated {rng.random()}" for _ in range(2)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    rows = suffix_dedup.deduplicated(df, width=24).collect()
    want = expected([t.encode() for t in texts], 24)
    assert sorted((bytes(r.kept), r.n_bytes, [tuple(x) for x in r.removed]) for r in rows) == sorted(want)


def test_longer_keys_have_every_string_once():
    for reach in (1, 2, 7, 84):
        for least, most in [(0, reach), (reach // 2, reach), (0, 0), (reach, reach), (1, reach - 1)]:
            if not 0 <= least <= most <= reach:
                continue
            more = (reach + 1) // 2
            left, seen = reach - more, []
            if least <= left:
                seen += [(0, a) for a in range(least, min(most, left) + 1)]
            if most > left:
                seen += [(more, a) for a in range(max(least, left + 1) - more, most - more + 1)]
            assert sorted(a + extra for extra, a in seen) == list(range(least, most + 1))


def test_a_hot_key_is_split(spark):
    """One passage shorter than the width in very many different surroundings."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [word(30) + "THE SAME PASSAGE OF THIRTY-TWO CH" + word(30) for _ in range(400)]
    assert found(spark, texts, width=40, block=20) == expected([t.encode() for t in texts], 40)


def test_strings_of_anchors_are_all_strings_once():
    rng = random.Random(2)
    for width in (8, 13, 40, 200):
        for letters in (b"ab", bytes(range(97, 123)), b"a"):
            text = bytes(rng.choice(letters) for _ in range(3 * width))
            starts = [
                start - a
                for place, least, most in suffix_dedup.anchors(text, width)
                for _, start, low, high in suffix_dedup.halves(place, least, most, width)
                for a in range(low, high + 1)
            ]
            assert sorted(starts) == list(range(len(text) - width + 1))


def test_edge_rows(spark):
    long = "".join(f"{i} bottles, " for i in range(3000))
    passage = "the same passage of more than forty bytes in two texts"
    docs = [
        (1, None), (2, ""), (3, "short"), (4, "A" + passage), (5, passage + "B"), (6, long),
        (7, long), (8, "one row"), (9, "id again " + passage[:20]), (9, passage[20:] + " again"),
        (10, "x" * 39), (11, "two equal rows of one id, more than forty"),
        (11, "two equal rows of one id, more than forty"), (None, "nothing here is repeated"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as tie")
    rows = suffix_dedup.deduplicated(df, width=40).collect()
    texts = [(text or "").encode() for _, text in docs]
    ids = [-1 if i is None else i for i, _ in docs]
    assert sorted(
        (-1 if r.doc_id is None else r.doc_id, bytes(r.kept), r.n_bytes, [tuple(x) for x in r.removed])
        for r in rows
    ) == sorted((i, *x) for i, x in zip(ids, expected(texts, 40)))
    assert suffix_dedup.deduplicated(df.limit(0), width=40).collect() == []
