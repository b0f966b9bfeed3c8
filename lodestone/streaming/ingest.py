"""Indexing from a stream of files: each micro-batch is an incremental index run, a version of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.api import Engine


def files_stream(engine: Engine, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, length, content) of files as they appear below a folder, at most so many a batch; paths are relative."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = engine.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    prefix = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), "^file:/+", "/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(F.when(F.startswith(plain, prefix), F.substring(plain, F.length(prefix) + 1, F.length(plain))).otherwise(plain).alias("path"), "length", "content")


def index_stream(engine: Engine, repo_id: str, files: DataFrame, checkpoint: str, progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Starts a query over a stream of (path, length, content) that brings ``repo_id`` up to date with all files so far.

    A batch adds and replaces files and deletes none; of files that come twice in it one stays. Batches are numbered in
    the version's manifest, so one that is run again after a failure changes nothing. ``progress`` gets each stage's
    event with the batch's number. Stopping the query leaves the version of the last whole batch."""

    def run(batch: DataFrame, number: int) -> None:
        for event in engine.index(repo_id, batch.dropDuplicates(["path"]), whole=False, batch=number):
            if progress:
                progress({"batch": number, **event})

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
