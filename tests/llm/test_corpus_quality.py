"""Quality scores: parts against plain formulas, the whole by held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from shopledger.llm import quality
from shopledger.llm.common import table

SF = "/root/testdata/sf0.01"


def test_statistics_of_each_text_alone():
    texts = ["", "Good words, here.\nAnd there!", "AAA!! AAA!! AAA!!", None, "é€ 12\n12\n12", "x" * 90_000]
    together = quality.statistics(pa.array(texts))
    for row, text in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([text], pa.string()))[0], together[row])
    shares = together[1, : len(quality.CLASSES)]
    assert shares.sum() == pytest.approx(1)
    assert shares[0] == pytest.approx(2 / 28)
    assert (together[0] == 0).all() and (together[3] == 0).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, quality.STATISTICS))
    d, n = quality.STATISTICS, 20_000
    features = quality.Features(
        np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, n)), rng.uniform(0, 2 * np.pi, n)
    )
    z = features(x)[:, :-1]
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-square / (2 * d))).max() < 0.05


def test_normal_equations_are_sums_over_partitions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, quality.STATISTICS)), rng.integers(0, 2, 50).astype(float)
    features = quality.Features(
        x.mean(0), 1 / x.std(0), rng.normal(size=(x.shape[1], 8)), rng.uniform(0, 6, 8)
    )
    df = spark.createDataFrame(
        [(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double"
    ).repartition(7)
    left, right = quality._normal_equations(df, features)
    z = features(x)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)


def test_isotonic_is_the_best_non_decreasing_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        values, weights = rng.random(n), rng.integers(1, 5, n).astype(float)
        fit = quality.isotonic(values, weights)
        assert (np.diff(fit) >= -1e-12).all()
        # The min-max formula of isotonic regression.
        mean = lambda a, b: np.average(values[a : b + 1], weights=weights[a : b + 1])
        best = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(fit, best)


def test_held_out_accuracy(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.quality_scores(documents, labels).toPandas()
    assert len(rows) == documents.count() and rows.score.between(0, 1).all()
    crc = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (rows.held_out == crc).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    marked = rows.merge(labels.toPandas(), on="doc_id")
    held = marked[marked.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    accepted = quality.accepted(documents, labels)
    assert accepted.columns == documents.columns
    assert {r.doc_id for r in accepted.select("doc_id").collect()} == set(
        rows[rows.predicted == 1].doc_id
    )


def test_held_out_labels_change_nothing(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn(
        "quality",
        quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(
            quality.F.col("quality")
        ),
    )
    one, two = (
        quality.quality_scores(documents, x).toPandas().set_index("doc_id").score
        for x in (labels, flipped)
    )
    assert np.allclose(one, two.loc[one.index], atol=1e-6)


def test_edge_rows(spark):
    rows = [(1, "Plain words of a text."), (2, None), (3, ""), (None, "no id"), (1, "BAD!! BAD!!"),
            (4, "word " * 30_000), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as x", "0 as quality")
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (3, None), (None, 1), (77, 0), (4, 1)], "doc_id long, quality int"
    )
    for given in (labels, labels.limit(0)):
        found = quality.quality_scores(df, given).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).collect() == []
    assert quality.accepted(df, labels.limit(0)).count() == len(rows)
