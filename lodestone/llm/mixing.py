"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order. A document's virtual finish time is the cumulative size
of its source up to and with it, divided by the source's target; a source that may repeat goes on into a second and
third pass over its documents. All copies are ordered by finish time and cut at the total budget, so every source is
served in proportion to its target. The running sums are taken in two levels (sums of hash buckets, then rows within
a bucket), so a source with any share of the rows is spread over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken more than their neighbours and count nothing; if all sizes are 0, every target is 0 and nothing is
taken; very long texts are read whole; repeated rows follow each other in the queue; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import md5_key, stored, table

#: Rows of a source's hash bucket, and of the finish-time bucket in which the budget ends, are about this many.
BUCKET_ROWS = 1024
MAX_BUCKETS = 65536
#: A document may be taken so many times.
EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, epochs: int = EPOCHS) -> DataFrame:
    """(skey, source_size) to targets: weights 1..cycle by order of skey share the sum of all sizes; no target
    exceeds ``epochs`` times its size, the excess goes to the others by weight. One row per source.

    With sources by rising cap/weight, level k = (budget - caps before k) / (weights from k on) rises while caps
    bind and falls after, so the common level is its maximum and target = min(cap, level * weight).
    """
    s = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("skey")) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    every = Window.partitionBy()
    s = s.withColumn("caps_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.max((F.sum("source_size").over(every) - F.col("caps_before")) / F.col("weights_left")).over(every))
    return s.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, epochs: int = EPOCHS, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, finish (of its first copy); ``keep`` names
    further columns of ``docs`` to carry along.

    Copies counts the passes in which the document's finish time lies before the point at which the budget (the sum
    of all sizes) is used up.
    """
    size = word_count(F.col("text")) if size is None else size
    skey = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    text = F.md5(F.coalesce("text", F.lit(""))) if "text" in docs.columns else F.lit("")  # parts rows whose ids are null or repeat
    h = md5_key(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    base = docs.select("doc_id", size.alias("size"), skey.alias("skey"), h.alias("h"), *[F.col(k).alias(f"kept_{k}") for k in keep or []])
    base = stored(base, "mix-base")
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n_buckets = min(MAX_BUCKETS, max(64, total["n"] // BUCKET_ROWS))
    width = 2**60 // n_buckets + 1
    base = base.withColumn("b", F.floor(F.col("h") / F.lit(width)).cast("int"))

    sums = base.groupBy("skey", "b").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")))
    before = sums.join(goal, "skey").withColumn("before", F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("b")) - F.col("bucket_size"))
    within = Window.partitionBy("skey", "b").orderBy("h", "doc_id", "size")
    queued = base.join(before.drop("bucket_size"), ["skey", "b"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    queued = stored(queued.drop("b", "before"), "mix-queued")

    finish = lambda e: F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("upto")) / F.col("target"))
    times = queued.select("doc_id", "h", "size", F.explode(F.array(*[finish(F.lit(e)) for e in range(epochs)])).alias("t")).where("t is not null")
    slot = F.floor(F.col("t") * n_buckets)
    spent = times.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"))
    spent = spent.withColumn("upto", F.sum("size").over(Window.orderBy("slot")))
    end = spent.where(F.col("upto") > total["size"]).orderBy("slot").first()
    if end is None:  # everything fits
        taken = lambda e: finish(F.lit(e)).isNotNull()
    else:
        tied = Window.orderBy("t", "h", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
        inside = times.where(slot == end["slot"]).select("t", "h", "doc_id", (F.sum("size").over(tied) + (end["upto"] - end["size"])).alias("used"))
        last = inside.where(F.col("used") <= total["size"]).agg(F.max(F.struct("t", "h", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))).alias("m")).first()["m"]
        early = lambda e: F.floor(finish(F.lit(e)) * n_buckets) < F.lit(end["slot"])
        key = lambda e: F.struct(finish(F.lit(e)).alias("t"), F.col("h"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"))
        upper = None if last is None else F.struct(F.lit(last["t"]).alias("t"), F.lit(last["h"]).cast("long").alias("h"), F.lit(last["d"]).cast("long").alias("d"))
        taken = lambda e: early(e) if upper is None else early(e) | (finish(F.lit(e)).isNotNull() & (key(e) <= upper))
    copies = sum((F.coalesce(taken(e), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", copies.alias("copies"), finish(F.lit(0)).alias("finish"), *[F.col(f"kept_{k}").alias(k) for k in keep or []])


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The mixed stream itself: a row per copy, range-sorted by virtual finish time (column ``finish``)."""
    one = F.when(F.col("target") > 0, F.col("source_size") / F.col("target"))
    copies = mixed.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("finish", F.col("finish") + F.col("pass") * one)
    return copies.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS skey,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM d GROUP BY skey
), l AS (
  SELECT *, (sum(source_size) OVER () - (sum(source_size * 3) OVER o - source_size * 3)) /
    sum(weight) OVER (ORDER BY source_size * 3 / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY source_size * 3 / weight, skey ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT skey, source_size, least(CAST(source_size * 3 AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g USING (skey)
), c AS (
  SELECT doc_id, h, size, source_size, target, e, CASE WHEN target > 0 THEN (source_size * e + upto) / target END AS t
  FROM q, (SELECT unnest([0, 1, 2]) AS e)
), u AS (
  SELECT *, sum(size) OVER (ORDER BY t NULLS LAST, h, doc_id RANGE UNBOUNDED PRECEDING) AS used, (SELECT sum(size) FROM d) AS budget FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(sum(CASE WHEN t IS NOT NULL AND used <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM u GROUP BY doc_id, size, source_size, target
"""
