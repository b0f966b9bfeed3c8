"""Versions of a set of tables: each is one small file, a manifest, that names the folders of its tables.

Data are written first, to folders of their own; a version exists when its manifest does. The manifest of version n + 1
is written beside and then renamed to its number, which fails if that number is taken: of two writers that began from
version n one succeeds, the other gets a Conflict and begins again. A writer that dies leaves folders that no manifest
names; ``vacuum`` removes these, and those of versions no longer kept. Readers keep the version they began with.

The file system must refuse to rename onto a file, as HDFS and local disks do through FileContext.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, *parts: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]).rstrip("/"))

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since it was changed) of what lies in a folder, but for hidden names."""
        at = self._path(folder)
        if not self._fs.exists(at):
            return []
        return sorted((s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self._fs.listStatus(at) if not s.getPath().getName().startswith("."))

    def matching(self, pattern: str) -> bool:
        found = self._fs.globStatus(self._path(pattern))
        return found is not None and len(found) > 0

    def numbers(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name, _ in self._names("versions")]

    def read(self, number: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None where there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return None
        stream = self._fs.open(self._path("versions", f"{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict, after: int) -> dict:
        """Makes ``manifest`` the version that follows number ``after``, or raises Conflict."""
        manifest = manifest | {"version": after + 1}
        to, beside = self._path("versions", f"{after + 1:012d}.json"), self._path("versions", f".{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf) if to.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, to, never_over)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.folder} is there already") from e
            raise
        return manifest

    def write(self, df: DataFrame, name: str) -> dict:
        """``df`` as a new folder of data; what a manifest says of it."""
        at = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{at}")
        return {"path": at, "schema": df.schema.json()}

    def table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.folder}/{entry['path']}")

    def drop(self, entry: dict) -> None:
        self._fs.delete(self._path(entry["path"]), True)

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Removes all but the last ``keep`` manifests, and the folders that none of these names and that have not
        changed for so many seconds (a writer may be at work in younger ones). Returns how many folders went."""
        numbers = self.numbers()
        kept = [self.read(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self._fs.delete(self._path("versions", f"{n:012d}.json"), False)
        named = {entry["path"].split("/")[1] for m in kept for entry in entries(m)}
        gone = [name for name, age in self._names("data") if name not in named and age >= older_than]
        for name in gone:
            self._fs.delete(self._path("data", name), True)
        return len(gone)


def entries(manifest: dict) -> list[dict]:
    """All folders of data that a manifest names: of single tables, and of tables in segments."""
    return [*manifest.get("tables", {}).values(), *[e for s in manifest.get("segments", []) for e in s["tables"].values()]]
