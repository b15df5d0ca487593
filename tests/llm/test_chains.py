"""Decisions along links against the plain order."""

import random

import pytest

from shopledger.llm import chains


def plain(links):
    """Nodes are numbers in their order."""
    before = {}
    for late, early in links:
        before.setdefault(late, set()).add(early)
    gone = set()
    for node in sorted(before):
        if any(e not in gone for e in before[node]):
            gone.add(node)
    return gone


def found(spark, links, at_once):
    rows = [(0, a, 0, b) for a, b in links]
    df = spark.createDataFrame(rows, "high long, low long, other_high long, other_low long")
    out = [r.low for r in chains.gone(df.repartition(3), at_once).collect()]
    assert len(out) == len(set(out))
    return set(out)


def graphs():
    rng = random.Random(5)
    yield "chain", [(k + 1, k) for k in range(300)]
    yield "chains", [(k + 1, k) for k in range(400) if k % 37]
    yield "tree", [(k, rng.randrange(k)) for k in range(1, 300)]
    yield "star", [(k, 0) for k in range(1, 50)] + [(200 + k, k) for k in range(1, 50)]
    yield "ladder", [(k, k - 1) for k in range(1, 120)] + [(k, k - 2) for k in range(2, 120, 3)]
    yield "sparse", [(k, rng.randrange(max(0, k - 9), k)) for k in range(1, 150) for _ in range(2)]
    yield "dense", [(a, b) for a in range(25) for b in range(a) if rng.random() < 0.5]
    yield "none", []


@pytest.mark.parametrize("name, links", list(graphs()), ids=[g[0] for g in graphs()])
def test_same_as_in_order(spark, name, links):
    assert found(spark, links, 10**6) == plain(links)
    if name in ("chain", "tree", "ladder", "dense"):
        assert found(spark, links, 0) == plain(links)
    if name in ("star", "sparse"):  # the last few by the driver
        assert found(spark, links, 40) == plain(links)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, names = 20_000, []
    keep = chains.stored
    monkeypatch.setattr(chains, "stored", lambda df, name: names.append(name) or keep(df, name))
    links = [(k + 1, k) for k in range(n)]
    assert found(spark, links, 100) == set(range(1, n + 1, 2))
    # The input and one contraction, of doublings to the chain's length: 2 ** 15 > n.
    assert names.count("chain-left") == 2 and names.count("chain-pointers") <= 17
