"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes a fixed vector of statistics of its bytes, words and lines. Random
Fourier features of the standardised vector approximate a Gaussian kernel; every
partition sums its part of the normal equations, Spark adds the parts, and the driver
solves one system of ``features + 1`` unknowns. Scores of labelled rows held back from that
fit are pooled by an isotonic fit, which maps scores to probabilities.

What reaches the driver is bounded: means, one matrix, and ``BINS`` score bins.

A null text counts as empty, and empty texts are scored. Labels that are null are left
out; several labels of one id are averaged; repeated rows are each scored. Without
labels every score is 0.5. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shopledger.llm.common import map_batches, row_bytes, stored, text_bytes

BINS = 2048
LOWEST, HIGHEST = -0.5, 1.5

# Bytes counted together, as shares of all bytes.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t",
    b"\n\r",
    b".,",
    b"!?",
    b"#$%&*@^~",
    b"|<>{}[]()\\/=+_",
    b"\"'`:;-",
    bytes(range(128, 256)),
)
STATISTICS = len(CLASSES) + 8


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for number, members in enumerate(CLASSES):
        table[list(members)] = number
    return table


CLASS_OF = _class_table()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text of the column."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    found = np.zeros((n, STATISTICS))
    kinds = CLASS_OF[data]
    filled = np.flatnonzero(sizes)
    for number in range(len(CLASSES)):
        if len(filled):
            counts = np.add.reduceat(kinds == number, offsets[filled], dtype=np.int64)
            found[filled, number] = counts / sizes[filled]
    at = len(CLASSES)
    for row, text in enumerate(row_bytes(column)):
        if not text:
            continue
        words, lines = text.split(), text.split(b"\n")
        n_words = max(1, len(words))
        found[row, at:] = (
            np.log1p(len(text)),
            np.log1p(n_words / len(lines)),
            np.log1p(len(text) / n_words),
            # Shares of words and lines that are there for the first time.
            len(set(words)) / n_words,
            len(set(lines)) / len(lines),
            # Share of words equal to the one before, and to the one before that.
            sum(map(eq, words, words[1:])) / n_words,
            sum(map(eq, words, words[2:])) / n_words,
            sum(map(bytes.isupper, words)) / n_words,
        )
    return found


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(1))
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), vectors.cast(pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Features:
    """Standardisation and random directions; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        waves = ((x - self.mean) * self.scale) @ self.directions + self.phases
        cosines = np.cos(waves) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    features: Features | None
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(self.features(x) @ self.weights, LOWEST, HIGHEST)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(_crc(id_col) % 3 == 1, F.lit(False))


def _crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def _features(train: DataFrame, n_features: int, width: float, seed: int) -> Features | None:
    """Standardised by the means and deviations of the training rows."""
    sums = [f(F.col("x")[k]) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    row = train.agg(*sums).first()
    if row[0] is None:
        return None
    mean, deviation = np.array(row[::2], float), np.array(row[1::2], float)
    random = np.random.default_rng(seed)
    return Features(
        mean,
        1 / np.where(deviation > 1e-9, deviation, 1.0),
        random.normal(0, 1 / (width * np.sqrt(STATISTICS)), (STATISTICS, n_features)),
        random.uniform(0, 2 * np.pi, n_features),
    )


def _normal_equations(train: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of z zᵀ and z y; each partition hands on one matrix."""
    size = len(features.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack([z, y[:, None]])
        place = np.arange(size * (size + 1), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["at", "v"])

    parts = map_batches(train.select("x", "y"), run, "at int, v double")
    rows = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size * (size + 1))
    for row in rows:
        total[row["at"]] = row["v"]
    total = total.reshape(size, size + 1)
    return total[:, :-1], total[:, -1]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit, by pooling adjacent violators."""
    pooled: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist()):
        pooled.append([value, weight, 1])
        while len(pooled) > 1 and pooled[-2][0] >= pooled[-1][0]:
            value, weight, count = pooled.pop()
            last = pooled[-1]
            last[0] = (last[0] * last[1] + value * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += count
    return np.repeat([p[0] for p in pooled], [p[2] for p in pooled])


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """The model with isotonic levels over score bins of the given labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            step = ((raw - LOWEST) / (HIGHEST - LOWEST) * (BINS - 1)).round().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], ["bin", "y"])

    binned = map_batches(rows.select("x", "y"), run, "bin int, y double")
    found = sorted(binned.groupBy("bin").agg(F.avg("y"), F.count("y")).collect())
    if not found:
        return model
    bins, means, counts = (np.array(c, float) for c in zip(*found))
    knots = LOWEST + bins / (BINS - 1) * (HIGHEST - LOWEST)
    return Model(model.features, model.weights, knots, np.clip(isotonic(means, counts), 0, 1))


def fitted(
    train: DataFrame,
    calibration: DataFrame,
    n_features: int = 192,
    width: float = 1.0,
    ridge: float = 1e-3,
    seed: int = 7,
) -> Model:
    """Fitted on all rows of ``train`` and calibrated on ``calibration`` (``x``, ``y``)."""
    features = _features(train, n_features, width, seed)
    if features is None:
        return Model(None, None, np.array([0.5]), np.array([0.5]))
    left, right = _normal_equations(train, features)
    n = left[-1, -1]
    penalty = np.eye(len(left)) * ridge * n / len(left)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(left + penalty, right)
    model = Model(features, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return _calibrated(calibration, model)


def _learned(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, **options) -> Model:
    """The model out of stored statistics (``doc_id``, ``x``) and a table of labels."""
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .where(~held_out())
    )
    labelled = stored(
        rows.join(marked, "doc_id").withColumn("fold", F.floor(_crc("doc_id") / 3) % 4),
        "labelled",
    )
    return fitted(labelled.where("fold != 0"), labelled.where("fold = 0"), **options)


def quality_scores(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **options,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row.

    Learns from labelled rows that are not held out: three quarters of them, picked by
    the id's checksum, fit the ridge, the rest the calibration.
    """
    rows = stored(with_statistics(df, id_col, text_col), "statistics")
    model = _learned(rows, labels, id_col, label_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score)], ["doc_id", "score"]
            )

    scored = map_batches(rows, run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    least: float = 0.5,
    **options,
) -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``.

    Texts stay where they are: they are scored again in place instead of being joined.
    """
    rows = stored(with_statistics(df, id_col, text_col), "statistics")
    model = _learned(rows, labels, id_col, label_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(batch.column(text_col)))
            yield batch.filter(pa.array(score >= least))

    return map_batches(df, run, df.schema)
