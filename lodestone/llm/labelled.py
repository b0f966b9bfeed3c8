"""Labels for the classifiers: which rows may be learned from, and how they reach the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Up to so many labels (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 500_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id counts as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, fold: one row per labelled document outside fold 0; repeated labels are averaged."""
    rows = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy("doc_id").agg(F.avg("y").alias("y")).withColumn("fold", fold(F.col("doc_id"))).where("fold != 0")


def with_labels(rows: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    return rows.join(F.broadcast(labels) if n_labels <= BROADCAST_LABELS else labels, "doc_id")
