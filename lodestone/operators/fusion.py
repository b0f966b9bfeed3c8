"""Reciprocal rank fusion, forced results and the hybrid search over both rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.params import DEFAULTS, Params
from lodestone.sources.shared import stored

from .lexical import Index, best
from .order import numbered
from .vector import nearest


def rrf(lists: list[DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(query_id, id, rank) lists to (query_id, id, fused, first_list, first_rank): sum of 1 / (k + rank), ranks from 1.
    Equal sums keep the order of insertion: by the first list that has the id, then its rank there."""
    tagged = reduce(DataFrame.unionByName, [x.select("query_id", "id", F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)])
    first = F.min(F.struct("list", "rank")).alias("first")
    fused = tagged.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"), first)
    return fused.select("query_id", "id", F.round("fused", 12).alias("fused"), F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def force_include(ranking: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """(id, rank) and (id, ordinal) of forced ids to the final (id, position): the best k stay; forced ids outside
    them go first, in their order, and push the tail out beyond max(k, number forced)."""
    top = ranking.where(F.col("rank") <= k).select("id", F.lit(1).alias("part"), F.col("rank").alias("at"))
    extra = matches.join(top, "id", "left_anti").select("id", F.lit(0).alias("part"), F.col("ordinal").alias("at"))
    both = numbered(extra.unionByName(top), "position", "part", "at", "id")
    most = matches.agg(F.greatest(F.lit(k), F.count("*")).alias("most"))
    return both.crossJoin(F.broadcast(most)).where("position <= most").select("id", F.col("position").cast("int").alias("position"))


def hybrid(index: Index, vectors: DataFrame, questions: DataFrame, queries: DataFrame, p: Params = DEFAULTS, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, fused_score, score), the first ``most`` (by default top_k): vector and keyword candidates, fused; the shown score is the
    similarity where there is one, else 1 / rank."""
    n = p.top_k * p.candidates
    by_vector = stored(nearest(vectors, queries, n).withColumnRenamed("vec_id", "id"), "nearest")  # n rows a query
    by_words = index.search(questions, n).withColumnRenamed("doc_id", "id")
    fused = rrf([by_vector, by_words], p.rrf_k)
    top = best(fused, most or p.top_k, F.col("fused").desc(), F.col("first_list"), F.col("first_rank"))
    shown = top.join(by_vector.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    return shown.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("fused", 9).alias("fused_score"), F.round(F.coalesce("similarity", 1.0 / F.col("rank")), 6).alias("score"))
