"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestone-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session that has none, a folder of our own. A cluster must name one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (given or _own()).rstrip("/")


_ours: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """The session's folder within the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    if folder not in _ours:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ours.add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Removes all that the session has stored so far, in a session that goes on for long. What rests on it and is not
    written yet is lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(path, True)
    files.mkdirs(path)


def stored(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written to the session's folder and read back, so that it is computed once; with a folder per value of ``by``,
    readers that ask for some values leave the other files alone."""
    path = f"{session_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


T = TypeVar("T")
#: What was made from tables, by session, files and purpose; the oldest go.
_made: OrderedDict[tuple, object] = OrderedDict()
MADE_KEPT = 16


def version_of(df: DataFrame) -> tuple:
    """The files that ``df`` reads, with their sizes and times: other contents, another version."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def readable(df: DataFrame) -> bool:
    try:
        return bool(version_of(df))
    except Exception:  # as the file system says it
        return False


def once(df: DataFrame, purpose: str, make: Callable[[], T], rests_on: Callable[[T], list[DataFrame]]) -> T:
    """What ``make`` gives, made once for the same columns of the same files in a session. It has to rest on stored
    tables, so that it outlives the plan that made it; if these are gone it is made again."""
    key = (df.sparkSession.sparkContext.applicationId, purpose, tuple(df.columns), version_of(df))
    if key not in _made or not all(map(readable, rests_on(_made[key]))):
        _made[key] = make()
        while len(_made) > MADE_KEPT:
            _made.popitem(last=False)
    return _made[key]


#: Bytes of input a core below which a table is dealt over all cores first.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: Spark cannot split a file within a row group, so one file of a few megabytes would
    keep one core busy. Larger tables stay as their files lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if sum(size for _, size, _ in version_of(df)) < SMALL * cores else df
