"""Largest inner products against all of them."""

import math
import random

import numpy as np
import pytest

from shopledger.llm import mtree


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def expected(rows, every, top):
    whole = [
        (k, i, [math.floor(256 * x) for x in v]) for k, (i, v) in enumerate(rows) if usable(v)
    ]
    out = []
    for k, i, v in whole:
        if i is None or i % every:
            continue
        others = [
            (-sum(a * b for a, b in zip(v, w)), j is None, j) for m, j, w in whole if m != k
        ]
        others.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(others[:top])]
    return sorted(map(str, out))


def case(seed, n=400, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for k in range(n):
        centre = rng.choice(centres)
        rows.append((k, [c + rng.gauss(0, 0.1) for c in centre]))
    rows += [(k, rows[10][1]) for k in range(1000, 1080)]  # a common vector
    rows += [(20, rows[20][1]), (20, rows[20][1]), (20, rows[5][1]), (None, rows[30][1]), (None, rows[30][1])]
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 6), (2030, [float("inf"), 0.0])]
    return rows + [(2040, []), (2050, [0.5]), (2060, [0.0] * 6), (2070, [9.0, *[0.0] * 8]), (-10, rows[3][1])]


@pytest.mark.parametrize("tree_rows, queries", [(mtree.TREE_ROWS, mtree.TREE_QUERIES), (40, 5)])
def test_same_as_all_products(spark, tree_rows, queries):
    rows = case(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as vector", "2 as query", "3 as score", "4 as rank"
    )
    found = mtree.nearest(df.repartition(3), 10, 5, tree_rows=tree_rows, tree_queries=queries)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(rows, 10, 5)


def test_long_vectors_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, [float(rng.randint(-(10**6), 10**6)) for _ in range(40)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.nearest(df, 7, 4, tree_rows=16).collect()
    assert sorted(str(tuple(r)) for r in found) == expected(rows, 7, 4)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, None)], [(1, [1.0]), (3, [2.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert mtree.nearest(df, 2, 5).collect() == []


def clustered(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 200, (40, dims))
    return np.floor(centres[rng.integers(0, 40, n)] + rng.normal(0, 8, (n, dims))).astype(np.int64)


def test_stored_bounds_spare_most_products():
    vectors = clustered(6000)
    space = mtree.Space(16, int((vectors * vectors).sum(1).max()))
    pages = mtree.build(space, vectors)
    for page in pages:
        page.vectors = page.vectors.astype(space.kind)
    ids = [[k] for k in range(len(vectors))]
    computed = 0
    for query in vectors[::100]:
        best = mtree.Best(6, mtree.NO_FLOOR)
        computed += mtree.search(space, pages, ids, query, best)
        scores = vectors @ query
        want = sorted((-int(s), False, k) for k, s in enumerate(scores))[:6]
        assert best.rows == want
    assert computed < 0.25 * 60 * len(vectors)


def test_pages_keep_the_metric_invariants():
    vectors = clustered(3000, 8)
    vectors[:400] = vectors[0]  # equal ones are cut by number
    space = mtree.Space(8, int((vectors * vectors).sum(1).max()))
    pages = mtree.build(space, vectors)
    seen = []

    def below(number, route):
        page = pages[number]
        assert len(page.vectors) <= max(mtree.PAGE, mtree.FANOUT)
        if route is not None:
            own = space.distances(page.vectors, route[None])[:, 0]
            assert np.allclose(own, page.parents)
        if page.leaf:
            seen.extend(page.children.tolist())
            return page.vectors
        parts = [below(int(c), v) for c, v in zip(page.children, page.vectors)]
        for part, vector, radius in zip(parts, page.vectors, page.radii):
            assert space.distances(part, vector[None]).max() <= radius + 1e-6
        return np.concatenate(parts)

    below(0, None)
    assert sorted(seen) == list(range(3000))
