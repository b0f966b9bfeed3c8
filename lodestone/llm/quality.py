"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text are standardised and mapped by fixed random cosines that approximate a Gaussian kernel.
Tasks sum the normal equations of their rows (a matrix of FEATURES + 1 squared); the driver adds GRAM_TASKS such
matrices and solves. Fold 1 is kept from the ridge fit and calibrates it: scores are counted in CALIBRATION_BINS
bins, and pooling adjacent violators makes their means monotone.

The fit takes every labelled row that may be learned from; statistics and scores are of every document.

Defined cases: a null or empty text has statistics of 0 and is scored like any other; very long texts are read whole; without labels, or with labels
of one class only, every score is the mean label (0.5 if there is none); repeated rows are scored alike; extra
columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, stored, table
from .labelled import fold, learnable, with_labels

FEATURES, SEED, RIDGE = 256, 20240, 1e-3
BANDWIDTH = 4.0
GRAM_TASKS = 16
CALIBRATION_BINS = 512
ACCEPT = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 sentence mark, 7 beyond ASCII
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), ((32, 9, 11, 12, 13), 4), ((10,), 5), (b".,;:?'\"-()", 6), (range(128, 256), 7)):
    _KIND[list(_chars)] = _k
N_STATS = 18


def statistics(text: str) -> list[float]:
    """Of the whole text: sizes, character classes, repetition of words, pairs and lines."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    share = np.bincount(_KIND[data], minlength=8) / len(data)
    counts = Counter(words)
    lines = text.split("\n")
    n = len(words)
    sizes = [len(w) for w in words]
    return [
        np.log1p(len(text)),
        np.log1p(n),
        sum(sizes) / n,
        np.log1p(max(sizes)),
        *share.tolist(),
        len(counts) / n,
        len(counts) / n**0.5,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    ]


def all_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                x = [list(map(float, statistics(t or ""))) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(x, pa.list_(pa.float64())), some.column(2)], names=["doc_id", "x", "key"])

    return docs.select("doc_id", "text", doc_key(F.col("doc_id"), F.col("text")).alias("key")).mapInArrow(run, "doc_id long, x array<double>, key long")


class Features:
    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, 1 / BANDWIDTH, (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8) @ self.w + self.b
        return np.hstack([np.cos(z) * (2 / FEATURES) ** 0.5, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_STATS)


def pooled(bins: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Isotonic fit of (x, weight, mean), by rising x: pool adjacent violators. Returns knots and values."""
    blocks: list[list[float]] = []  # weight, mean, first x, last x
    for x, w, y in bins:
        blocks.append([w, y, x, x])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, y2, _, last = blocks.pop()
            w1, y1, first, _ = blocks.pop()
            blocks.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), first, last])
    return [x for b in blocks for x in b[2:]], [b[1] for b in blocks for _ in "ab"]


class Model:
    def __init__(self, features: Features | None, beta: np.ndarray | None, knots: list[float], values: list[float]):
        self.features, self.beta, self.knots, self.values = features, beta, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    known = stored(learnable(labels, label), "quality-labels")
    n = known.count()
    rows = with_labels(stats, known, n)
    rows = stored(rows.select("x", "y", "fold").repartition(GRAM_TASKS), "quality-fit")
    at = [F.get("x", F.lit(i)) for i in range(N_STATS)]
    m = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high"), F.array(*[F.avg(c) for c in at]).alias("mean"), F.array(*[F.stddev_pop(c) for c in at]).alias("sd")).first()
    if not m["n"] or m["low"] == m["high"]:
        return Model(None, None, [], [0.5 if m["y"] is None else m["y"]])
    features = Features(np.array(m["mean"]), np.array(m["sd"]))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = features(matrix(batch.column(0))), np.asarray(batch.column(1))
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    # all but fold 1, where there is something else
    own = rows.where("fold != 1") if rows.where("fold != 1").agg(F.count_distinct("y")).first()[0] > 1 else rows
    parts = own.select("x", "y").mapInArrow(gram, "m binary").collect()  # as many matrices as stored partitions, GRAM_TASKS at most
    total = sum(np.frombuffer(r["m"]).reshape(FEATURES + 1, FEATURES + 2) for r in parts)
    beta = np.linalg.solve(total[:, :-1] + RIDGE * m["n"] * np.eye(FEATURES + 1) / FEATURES, total[:, -1])
    model = Model(features, beta, [], [])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(batch.column(0)))), batch.column(1)], names=["s", "y"])

    held = rows.where("fold = 1") if rows.where("fold = 1").limit(1).count() else rows
    held = held.select("x", "y").mapInArrow(scored, "s double, y double")
    b = F.least(F.greatest(F.floor((F.col("s") + 1) / 3 * CALIBRATION_BINS), F.lit(0)), F.lit(CALIBRATION_BINS - 1))
    bins = held.groupBy(b.alias("bin")).agg(F.avg("s").alias("s"), F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    knots, values = pooled([(r["s"], r["n"], r["y"]) for r in bins])
    return Model(features, beta, knots, values)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, score, key (of the row by id and text)."""
    stats = stored(all_statistics(docs), "quality-stats")
    model = fit(stats, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1)))), batch.column(2)], names=["doc_id", "score", "key"])

    return stats.mapInArrow(run, "doc_id long, score double, key long")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
