"""Numbers in a total order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import stored


def numbered(df: DataFrame, column: str, *order: Column | str) -> DataFrame:
    """``df`` with ``column``: its rows' places from 1 by ``order`` (unique). Rows are sorted in ranges, counted by
    range, and the ranges' counts (a row each) are summed up."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.select("*", F.monotonically_increasing_id().alias("lodestone_at")), "numbered")
    part = F.shiftright("lodestone_at", 33).alias("lodestone_part")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.select("lodestone_part", (F.sum("n").over(Window.orderBy("lodestone_part")) - F.col("n")).alias("lodestone_before"))
    both = rows.withColumn("lodestone_part", part).join(F.broadcast(before), "lodestone_part")  # a row per range
    place = F.col("lodestone_at").bitwiseAND((1 << 33) - 1) + F.col("lodestone_before") + 1
    return both.withColumn(column, place).drop("lodestone_at", "lodestone_part", "lodestone_before")
