"""Approximate nearest vectors: an inverted file over k-means cells, and the exact search it is measured against.

There are some sqrt(n) cells, fitted on at most SAMPLE_ROWS vectors (by hash of the id); every vector is indexed, in a table
with a folder a cell, so that a search reads the cells it looks into and no others. How many these are is measured: the true
neighbours of TRIALS vectors, over the whole table, tell how far down the list of nearest cells the wanted share of them
lies. Vectors have one length; nulls, and
queries of another length, are left out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import spread, stored

from .products import contenders

SAMPLE_ROWS = 50_000
#: The centres, so many vectors, are held by the driver and each task.
MAX_CELLS = 4096
TRIALS = 256
#: Queries in a block: some 5 MB of vectors when broadcast.
BLOCK_QUERIES = 4096


def unit(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


class Index:
    """Unit vectors with their cell (``rows``: vec_id, v, cell), the cells' centres, and the number of cells to look into
    for ``recall`` of the ``k`` nearest (``probes``)."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 11):
        spark = vectors.sparkSession
        units = stored(vectors.where("embedding is not null").select("vec_id", unit(F.col("embedding")).alias("v")), "unit-vectors")
        n = units.count()
        fitted = units.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // SAMPLE_ROWS)))) == 0).select(array_to_vector("v").alias("features"))
        most = max(2, min(cells or math.isqrt(n), MAX_CELLS))
        centres = np.array(KMeans(k=most, seed=seed, maxIter=10).fit(fitted).clusterCenters()) if n > 1 else np.zeros((1, len(units.first()["v"]) if n else 0))
        self._centres = spark.sparkContext.broadcast((centres, (centres * centres).sum(axis=1) / 2))
        self._id = units.schema["vec_id"].dataType.simpleString()
        placed = units.mapInArrow(self._into_cells(1), f"vec_id {self._id}, v array<double>, cell int")
        self.rows = stored(placed.repartitionByRange("cell", "vec_id"), "cells", by="cell")
        self.probes = self._measured(units, recall, k, len(centres)) if n > 1 else 1

    def _into_cells(self, probes: int) -> Callable:
        """Of batches (id, vector), each row with each of its nearest cells."""
        shared = self._centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, half = shared.value
            for batch in batches:
                far = half - matrix(batch.column(1), centres.shape[1]) @ centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes] if probes > 1 else far.argmin(axis=1)[:, None]
                times = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(times) for i in (0, 1)), pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names[:2], "cell"])

        return run

    def _measured(self, units: DataFrame, recall: float, k: int, n_cells: int) -> int:
        """In which place of a trial's list of cells its k nearest neighbours are, ``recall`` of them at most."""
        trials = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).collect()
        asked = np.array([r["v"] for r in trials])
        shared = units.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in trials], asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            near, cells = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int32)
            own = {x: i for i, x in enumerate(ids)}
            for batch in batches:
                product = asked @ matrix(batch.column(1), asked.shape[1]).T
                for j, x in enumerate(batch.column(0).to_pylist()):
                    if x in own:
                        product[own[x], j] = -np.inf
                both = np.concatenate([near, product], axis=1)
                at = np.concatenate([cells, np.broadcast_to(batch.column(2).to_numpy(), product.shape)], axis=1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                near, cells = np.take_along_axis(both, best, axis=1), np.take_along_axis(at, best, axis=1)
            trial, j = np.nonzero(near > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(trial.astype(np.int32)), pa.array(cells[trial, j]), pa.array(near[trial, j])], names=["trial", "cell", "near"])

        found = self.rows.select("vec_id", "v", "cell").mapInArrow(run, "trial int, cell int, near double")
        nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("near"), "cell"))).where(F.col("r") <= k)
        centres, half = self._centres.value
        place = np.argsort(np.argsort(half - asked @ centres.T, axis=1, kind="stable"), axis=1, kind="stable")
        places = [place[r["trial"], r["cell"]] for r in nearest.select("trial", "cell").collect()]  # k a trial
        return int(np.quantile(places, recall, method="higher")) + 1 if places else n_cells

    def candidates(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, query_vector) to (query_id, q, vec_id, v) of the cells nearest to the query."""
        length = self._centres.value[0].shape[1]
        q = queries.where(F.size("query_vector") == length).select("query_id", unit(F.col("query_vector")).alias("q"))
        kind = q.schema["query_id"].dataType.simpleString()
        # Stored, so that Spark knows the size by which it broadcasts them or not.
        asked = stored(q.mapInArrow(self._into_cells(probes or self.probes), f"query_id {kind}, q array<double>, cell int"), "probes")
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
        return self.rows.where(F.col("cell").isin(wanted)).join(asked, "cell").select("query_id", "q", "vec_id", "v")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, query_vector) to (query_id, vec_id, similarity, rank), the k best of the ``probes`` nearest cells. A
        task multiplies a cell's vectors by the queries that look into it; no row is made of a pair that is not among its
        best."""
        length = self._centres.value[0].shape[1]
        q = queries.where(F.size("query_vector") == length).select("query_id", unit(F.col("query_vector")).alias("q"))
        into = self._into_cells(probes or self.probes)
        kind = q.schema["query_id"].dataType.simpleString()

        def of_block(block: DataFrame) -> DataFrame:
            probed: dict = {}
            for r in block.mapInArrow(into, f"query_id {kind}, q array<double>, cell int").select("query_id", "cell").collect():  # a block's
                probed.setdefault(r["query_id"], []).append(r["cell"])
            wanted = {c for cells in probed.values() for c in cells}
            return top(contenders(self.rows.where(F.col("cell").isin(sorted(wanted))).select("vec_id", "v", "cell"), block, k, cosine=False, probed=probed), k)

        return in_blocks(q, of_block)


def in_blocks(queries: DataFrame, search) -> DataFrame:  # noqa: ANN001
    n = max(1, -(-queries.count() // BLOCK_QUERIES))
    return reduce(DataFrame.unionByName, [search(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)])


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; each task keeps k a query before anything is shuffled."""
    return top(pairs.select("query_id", "vec_id", dot(F.col("v"), F.col("q")).alias("score")), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    scored = scored.select("query_id", "vec_id", F.round("score", 9).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same over all vectors: a stated set of queries, in blocks, against every row."""
    rows = spread(vectors).select("vec_id", unit(F.col("embedding")).alias("v"))
    q = queries.select("query_id", unit(F.col("query_vector")).alias("q"))
    return in_blocks(q, lambda block: top(contenders(rows, block, k, cosine=False), k))
