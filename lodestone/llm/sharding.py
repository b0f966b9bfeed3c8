"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the id). Size-weighted draws of that key give quantile boundaries;
records are range-partitioned between them, ranges that one large group of equal texts overfills are subdivided by
the id's hash, and exact sizes of the ranges then place every record on the scale from 0 to the sum of all sizes,
which the shards divide evenly. Law: ``bytes``.

Equal texts stay in one shard unless their group is larger than ``SPLIT_OVER`` of a shard's share; then the group is
cut record by record. So shards differ by at most about that share.

Defined cases: a null text counts as empty (size 1); a very long text is one record, whatever its share of a shard; ties by (id, size); repeated rows each get a slot; with fewer
records than shards some shards stay empty; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import md5_key, stored, table

RANGES = 4096
DRAWS_PER_RANGE = 16
SPLIT_OVER = 0.02
#: The range of a key is looked up by its first bits.
PREFIX_BITS = 12
KEY_BITS = 60


def assign_shards(docs: DataFrame, shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, and the columns named in ``keep``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        md5_key(text).alias("h"),
        md5_key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("g"),
        *[F.col(k).alias(f"kept_{k}") for k in keep or []],
    )
    base = stored(base, "shard-base")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    share = total / shards

    # Size-weighted draws: a record is drawn draws * size / total times, fractions by chance of its hash.
    draws = RANGES * DRAWS_PER_RANGE
    chance = F.pmod(F.xxhash64("g", "h"), F.lit(2**20)) / 2**20
    drawn = base.select("h", F.floor(F.col("size") * (draws / total) + chance).alias("times")).where("times > 0")
    sample = sorted((r["h"], r["times"]) for r in drawn.groupBy("h").agg(F.sum("times").alias("times")).collect())  # at most `draws` rows
    splitters: Counter = Counter()
    seen = 0
    for h, times in sample:
        splitters[h] += (seen + times) // DRAWS_PER_RANGE - seen // DRAWS_PER_RANGE
        seen += times
    # Overfull: groups of equal texts that hold more than one boundary; their exact sizes decide.
    often = [h for h, m in splitters.items() if m > 1]
    large = {}
    if often:
        keys = F.broadcast(spark.createDataFrame([(h,) for h in often], "h long"))  # at most RANGES rows
        large = {r["h"]: r["size"] for r in base.join(keys, "h").groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > SPLIT_OVER * share).collect()}
    values = sorted(h for h, m in splitters.items() if m)
    rows, at = [], 0
    for p in range(2**PREFIX_BITS):
        own = []
        while at + len(own) < len(values) and values[at + len(own)] >> (KEY_BITS - PREFIX_BITS) == p:
            own.append(values[at + len(own)])
        rows.append((p, at, [(v, max(1, round(large[v] / total * RANGES)) if v in large else 0) for v in own]))
        at += len(own)
    lookup = F.broadcast(spark.createDataFrame(rows, "p int, first int, own array<struct<v: long, parts: int>>"))  # 4096 rows

    # Range 2j is below the splitter j and above the one before it; 2j + 1 is the splitter's own key, if that is large.
    ranged = base.withColumn("p", F.shiftright("h", KEY_BITS - PREFIX_BITS).cast("int")).join(lookup, "p")
    parts = F.filter("own", lambda s: (s["v"] == F.col("h")) & (s["parts"] > 0))
    ranged = ranged.withColumn("parts", F.when(F.size(parts) > 0, parts[0]["parts"]).otherwise(0))
    below = F.size(F.filter("own", lambda s: s["v"] < F.col("h")))
    ranged = ranged.select(
        *base.columns,
        "parts",
        ((F.col("first") + below) * 2 + (F.col("parts") > 0).cast("int")).alias("r"),
        F.floor(F.col("g") / F.lit(float(2**KEY_BITS)) * F.col("parts")).cast("int").alias("sub"),
    )
    sums = ranged.groupBy("r", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    order = Window.orderBy("r", "sub").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("r", "sub", (F.sum("bytes").over(order) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(order) - F.col("n")).alias("n_before"))
    by = Window.partitionBy("r", "sub").orderBy("h", "g", "doc_id", "size")
    group = Window.partitionBy("r", "sub", "h")
    placed = ranged.join(sums, ["r", "sub"]).withColumn("start", F.col("bytes_before") + F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("nth", F.col("n_before") + F.row_number().over(by) - 1)
    placed = placed.withColumn("group_size", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
    whole = F.col("group_size") <= SPLIT_OVER * share
    middle = F.when((F.col("parts") == 0) & whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(share))).cast("int"))
    placed = stored(placed.drop("r", "sub", "parts", "bytes_before", "n_before", "start", "group_size", "group_start", "h", "g"), "shard-placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("nth").alias("first")))  # a row per shard
    out = placed.join(first, "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"), *[F.col(f"kept_{k}").alias(k) for k in keep or []])


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
