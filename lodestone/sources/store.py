"""Chunk tables: how a new version follows from the old one, and a table kept in versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Conflict, Versions

#: A change that other writers outrun so often is given up.
ATTEMPTS = 10


def upserted(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``incoming`` (one per key) and those of ``existing`` that it does not replace."""
    new = incoming.dropDuplicates([key])
    return existing.join(new, key, "left_anti").unionByName(new)


def without_files(existing: DataFrame, paths: DataFrame) -> DataFrame:
    return existing.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def refreshed(existing: DataFrame, incoming: DataFrame, changes: DataFrame) -> DataFrame:
    """Incremental re-index: chunks of changed and deleted files go, those of the new version come."""
    return upserted(without_files(existing, changes.select(F.col("path").alias("file_path"))), incoming)


class ChunkStore:
    """One chunk table in versions below a folder. A change is made from the last version and made again if another
    writer was first, so no writer's change is lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.versions = Versions(spark, folder)

    def read(self) -> DataFrame | None:
        last = self.versions.read()
        return None if last is None else self.versions.table(last["tables"]["chunks"])

    def change(self, to: Callable[[DataFrame | None], DataFrame]) -> None:
        for _ in range(ATTEMPTS):
            last = self.versions.read()
            entry = self.versions.write(to(None if last is None else self.versions.table(last["tables"]["chunks"])), "chunks")
            try:
                self.versions.commit({"tables": {"chunks": entry}}, last["version"] if last else 0)
                return
            except Conflict:
                self.versions.drop(entry)
        raise Conflict(f"{self.versions.folder} changed {ATTEMPTS} times meanwhile")

    def replace(self, chunks: DataFrame) -> None:
        self.change(lambda _: chunks)

    def upsert(self, incoming: DataFrame) -> None:
        self.change(lambda old: incoming.dropDuplicates(["chunk_id"]) if old is None else upserted(old, incoming))

    def delete_files(self, paths: DataFrame) -> None:
        if self.read() is not None:
            self.change(lambda old: without_files(old, paths))

    def stats(self) -> DataFrame:
        rows = self.read()
        if rows is None:
            return self.versions.spark.createDataFrame([], "repo_id string, chunks long, files long")
        return rows.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"))
