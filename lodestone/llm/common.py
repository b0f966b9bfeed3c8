"""What the operators share: tables, the shared folder, tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_dir, stored

__all__ = ["WORD", "ascii_lower", "doc_key", "join_counted", "md5_key", "shared_dir", "stored", "table"]

#: Maximal runs of these are the words of a text (ASCII separators; every other character is part of a word).
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def md5_key(c: Column) -> Column:
    """The first 60 bits of md5 as a non-negative long: an order that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def doc_key(doc_id: Column, text: Column) -> Column:
    """Identifies a row by id and content, so that repeated ids with other texts stay apart."""
    return F.xxhash64(doc_id, text)


#: Keys that hold more than a HEAVY-th of the rows are few enough to broadcast: at most HEAVY of them.
HEAVY = 10_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", heavy: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which is unique by ``keys`` and holds in ``n`` how many rows have the
    key. Keys with more than a ``heavy``-th (by default HEAVY) of all these rows, at most so many, are broadcast, so that
    the shuffle of the rest has no hot key. Both sides are read twice: store them before."""
    heavy = heavy or HEAVY
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(counted.where(F.col(n) * heavy > total))  # under ``heavy`` rows
    light = counted.where(F.col(n) * heavy <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(light, keys))
