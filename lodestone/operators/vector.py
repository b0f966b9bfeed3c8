"""Exact nearest vectors by cosine: one pass over the vectors for a block of queries, each task keeps its best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import spread

from .ivf import in_blocks
from .lexical import best
from .products import contenders


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank) for the queries (query_id, query_vector), a stated set that is broadcast in
    blocks; ``where`` filters vectors before the cut. Vectors of another length than the query's are left out; a vector
    of zeros is similar to none (0)."""
    rows = spread(vectors if where is None else vectors.where(where)).select("vec_id", "embedding")

    def search(block: DataFrame) -> DataFrame:
        near = contenders(rows, block, k, cosine=True).withColumn("cosine", F.round("score", 9))
        return best(near, k, F.col("cosine").desc(), F.col("vec_id")).select("query_id", "vec_id", F.greatest(F.lit(0.0), "cosine").alias("similarity"), "rank")

    return in_blocks(queries.select("query_id", "query_vector"), search)
