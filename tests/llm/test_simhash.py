"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from shopledger.llm import simhash


def plain_fingerprint(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    """Smallest id reachable from each row, by flooding."""
    ids = [i for i, _ in prints]
    root = {}
    for start, (i, _) in sorted(enumerate(prints), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        if start in root:
            continue
        root[start], queue = i, [start]
        while queue:
            at = queue.pop()
            for other in range(len(ids)):
                near = bin(prints[at][1] ^ prints[other][1]).count("1") <= distance
                if near and other not in root:
                    root[other] = i
                    queue.append(other)
    return [root[k] for k in range(len(ids))]


def corpus():
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "zeta", "eta", "theta", "iota"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(12)]
    rows = []
    for k in range(90):
        text = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k * 37 % 90, rng.choice([" ", "\n", " \t"]).join(text)))
    extra = [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b"),
             (3, "again with id three"), (3, "again with id three"), (None, "one"),
             (206, "very long " * 20_000)]
    return rows + extra


@pytest.mark.parametrize("distance, run_limit", [(0, 4096), (2, 4096), (3, 4096), (3, 2), (5, 2)])
def test_same_as_all_pairs(spark, distance, run_limit):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as a")
    rows = simhash.near_duplicates(df, max_distance=distance, run_limit=run_limit).collect()
    prints = [(i, plain_fingerprint(text or "")) for i, text in docs]
    expected = [(i, p, c) for (i, p), c in zip(prints, components(prints, distance))]
    key = lambda row: (row[0] is None, row[0] or 0, row[1], row[2])
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in rows), key=key) == sorted(
        expected, key=key
    )


def test_rows_that_stay(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id % 3 as fp")
    rows = simhash.deduplicated(df).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "fp"]
    prints = [(i, plain_fingerprint(text or "")) for i, text in docs]
    # Id 3 stands for two components: of its two texts.
    number_of = components([(k, p) for k, (_, p) in enumerate(prints)], 3)
    roots = dict(zip(number_of, components(prints, 3)))
    assert sorted(r.doc_id for r in rows) == sorted(roots.values())
    assert simhash.deduplicated(df.limit(0)).collect() == []


def test_a_hot_group_is_walked_in_blocks(spark):
    rng = np.random.default_rng(1)
    low = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64))
    fps = spark.createDataFrame([(int(x),) for x in low], "fp long")
    found = simhash.links(fps, 3, run_limit=64)
    assert found.count() < 20 * 64 * len(low)
    edges = {(r.a, r.b) for r in found.collect()}
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    prints = [(int(x), int(x)) for x in low]
    parent = {int(x): int(x) for x in low}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert [top(int(x)) for x in low] == components(prints, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
