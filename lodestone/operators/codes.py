"""Exact nearest vectors by way of short codes: most vectors are ruled out by a bound and never read.

A unit vector is coded in a byte a number, scaled by its largest, and what the code loses (the length of the difference)
is kept beside. A query's product with the code is off by no more than that, so every vector has a lower and an upper
bound; those whose upper bound lies below the k-th best lower bound are out. The rest, a few times k, are compared in full.
The codes take a quarter of the vectors' bytes and are multiplied as matrices; queries are a stated set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import stored

from .ivf import best, in_blocks, unit

#: Added to what a code loses, for sums in single precision.
ROUNDING = 1e-5


def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) to vec_id, code, scale, lost; vectors may differ in length."""
    for batch in batches:
        codes, scales, lost = [], [], []
        for v in batch.column(1).to_pylist():
            v = np.array(v, np.float64)
            scale = float(np.abs(v).max(initial=0.0)) / 127
            c = np.rint(v / scale).astype(np.int8) if scale else np.zeros(len(v), np.int8)
            codes.append(c.tobytes())
            scales.append(scale)
            lost.append(float(np.linalg.norm(v - scale * c)) + ROUNDING)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(scales), pa.array(lost)], names=["vec_id", "code", "scale", "lost"])


class CodeIndex:
    """Unit vectors (``rows``: vec_id, v) and their codes, both stored."""

    def __init__(self, vectors: DataFrame):
        self.rows = stored(vectors.select("vec_id", unit(F.col("embedding")).alias("v")), "unit-vectors")
        kind = self.rows.schema["vec_id"].dataType.simpleString()
        self.codes = stored(self.rows.mapInArrow(code, f"vec_id {kind}, code binary, scale double, lost double"), "codes")

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q) to (query_id, vec_id) that may be among the k best; all that are are there. A task passes on what its
        own bounds leave, some k a query."""
        kind, id_kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (self.codes, "vec_id")))
        asked = queries.collect()  # a block
        ids = [r["query_id"] for r in asked]
        shared = queries.sparkSession.sparkContext.broadcast((ids, [np.array(r["q"], np.float32) for r in asked]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, qs = shared.value
            lengths = {len(q) for q in qs}
            least = np.full((len(qs), k), -np.inf, np.float32)  # the k best lower bounds of each query so far
            for batch in batches:
                raw = batch.column(1).to_pylist()
                for length in lengths:
                    mine = [i for i, q in enumerate(qs) if len(q) == length]
                    at = np.array([i for i, c in enumerate(raw) if len(c) == length], np.int64)
                    if not len(at):
                        continue
                    codes = np.frombuffer(b"".join(raw[i] for i in at), np.int8).reshape(len(at), length).astype(np.float32)
                    scale, lost = (batch.column(c).to_numpy()[at].astype(np.float32) for c in (2, 3))
                    near = np.stack([qs[i] for i in mine]) @ codes.T * scale
                    low = np.concatenate([least[mine], near - lost], axis=1)
                    least[mine] = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
                    q, v = np.nonzero(near + lost >= least[mine].min(axis=1)[:, None])
                    if len(q):
                        own = [ids[mine[i]] for i in q]
                        yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0).take(pa.array(at[v])), pa.array((near[q, v] - lost[v]).astype(float)), pa.array((near[q, v] + lost[v]).astype(float))], names=["query_id", "vec_id", "low", "high"])

        near = stored(self.codes.mapInArrow(run, f"query_id {kind}, vec_id {id_kind}, low double, high double"), "near-codes")
        kth = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("r") <= k)
        kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("least"))  # a row a query
        return near.join(F.broadcast(kth), "query_id").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "vec_id")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query_vector) to (query_id, vec_id, similarity, rank), the k best of each query."""
        q = queries.select("query_id", unit(F.col("query_vector")).alias("q"))
        return in_blocks(q, lambda block: best(self.candidates(block, k).join(self.rows, "vec_id").join(F.broadcast(block), "query_id"), k))
