"""The corpus pipeline: what is kept of the documents, mixed and dealt into shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again by
whoever runs them. All but the last return the columns of documents.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import doc_key, shared_dir, table
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.minhash import class_of, near_duplicates
from lodestone.llm.mixing import in_mixed_order, mix
from lodestone.llm.quality import ACCEPT, score_quality
from lodestone.llm.sharding import assign_shards

SHARDS = 8


def orderable(docs: DataFrame) -> list[str]:
    """The columns by which rows that are alike otherwise can be put in order."""
    return [f.name for f in docs.schema if not {"map", "variant", "geometry", "geography"} & {*re.findall(r"[a-z]+", f.dataType.simpleString())}]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text is scored like any other and goes or stays with
    all rows that share its id; so do repeated rows. Without labels of both kinds all documents stay."""
    scores = score_quality(docs, table(spark, sf_dir, "labels"))
    rejected = scores.where(F.col("score") < ACCEPT).select(F.col("key").alias("lodestone_key")).distinct()
    keyed = docs.withColumn("lodestone_key", doc_key(F.col("doc_id"), F.col("text")))
    return keyed.join(rejected, "lodestone_key", "left_anti").drop("lodestone_key")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id (nulls last); of several with it, the least by all
    columns that have an order. A null text counts as empty, and empty texts are one group, as repeated rows are."""
    found = near_duplicates(docs)
    kept = found.where(F.col("class") == F.col("kept_class")).select(F.col("class_id").alias("lodestone_id"), F.col("class").alias("lodestone_group")).distinct()
    keyed = docs.withColumn("lodestone_class", class_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("lodestone_id")) & (F.col("lodestone_class") == F.col("lodestone_group"))
    one = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.struct(*[docs[c] for c in orderable(docs)]))
    return keyed.join(kept, same, "left_semi").groupBy("lodestone_class").agg(one.alias("lodestone_doc")).select("lodestone_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none and stay, repeated rows stay or go
    alike, and without a benchmark all stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = found.where("contaminated").select(F.col("key").alias("lodestone_key")).distinct()
    keyed = docs.withColumn("lodestone_key", doc_key(F.col("doc_id"), F.col("text")))
    return keyed.join(hit, "lodestone_key", "left_anti").drop("lodestone_key")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream, a row per copy taken, by virtual finish time. Texts without words have size 0 and go with their
    neighbours in the queue; a null source is one of its own; rows that share id, text and source are taken as often as
    the first of them."""
    keyed = docs.withColumn("lodestone_key", F.xxhash64("doc_id", "text", "source"))
    mixed = mix(keyed.select(F.col("lodestone_key").alias("doc_id"), "text", "source"))
    mixed = mixed.groupBy(F.col("doc_id").alias("lodestone_key")).agg(F.min(F.struct("finish", "copies", "target", "source_size")).alias("lodestone_mix"))
    taken = mixed.where("lodestone_mix.copies > 0")
    both = keyed.join(taken, "lodestone_key")
    ordered = in_mixed_order(both.select("lodestone_mix.*", F.col("lodestone_key").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("lodestone_doc")))
    return ordered.select("lodestone_doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row of the stream: doc_id, size, text_crc32, shard, slot. A null text counts as empty; equal texts share a
    shard unless they are more than a fiftieth of it."""
    return assign_shards(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lodestone/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
