"""Versioned parquet snapshots: a run writes new data beside the old and claims the next version number at its end.

A reader sees one version or the other. Of runs that started from the same version one can claim the next; the others fail
and take their data away. A version is a small file that says where each part of each table lies; parts that a run did not
touch are those of the version before, so a run writes what it changed and no more.

Claiming needs a file system on which creating a name that exists fails: local and mounted ones, and those that Hadoop
renames atomically on (HDFS and the like). Everything but the claim is plain reading and writing through Spark.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class StaleSnapshot(RuntimeError):
    """Another run has committed since this one started."""


class LocalFiles:
    """Local and mounted file systems; a hard link is made only if its name is free."""

    def names(self, path: str) -> list[str]:
        return sorted(os.listdir(path)) if os.path.isdir(path) else []

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def claim(self, path: str, text: str) -> bool:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, path)
        except FileExistsError:
            return False
        finally:
            os.remove(tmp)
        return True

    def remove(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)


class HadoopFiles:
    """Any file system that Hadoop knows; a rename that must not replace decides who was first."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(path))) if fs.exists(self._path(path)) else []

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, path: str, text: str) -> bool:
        fs = self._fs(path)
        fs.mkdirs(self._path(path).getParent())
        tmp = f"{path}.{uuid.uuid4().hex}"
        out = fs.create(self._path(tmp), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self.conf)
        none = self.jvm.org.apache.spark.api.python.PythonUtils.toArray([self.jvm.java.lang.Enum.valueOf(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")])
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = none[0]
        try:
            context.rename(self._path(tmp), self._path(path), options)
        except Exception as e:
            fs.delete(self._path(tmp), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


def _folder(name: str) -> bool:
    return name.startswith("v") and name.endswith(".json") and name[1:-5].isdigit()


class SnapshotStore:
    """Versions of a set of tables under ``root``. Tables with a ``repo_id`` are kept in ``buckets`` parts by its hash; the
    number is that of the first version."""

    def __init__(self, root: str, buckets: int = 64, files: LocalFiles | HadoopFiles | None = None):
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._files = files

    @property
    def files(self) -> LocalFiles | HadoopFiles:
        if self._files is None:
            local = "://" not in self.root and not self.root.startswith("file:")
            self._files = LocalFiles() if local else HadoopFiles(SparkSession.active())
        return self._files

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self.files.names(f"{self.root}/versions") if _folder(n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "tables": {}, "note": {}}
        return json.loads(self.files.read(f"{self.root}/versions/v{version:08d}.json"))

    def bucket(self, repo_id: Column, version: int | None = None) -> Column:
        return F.pmod(F.xxhash64(repo_id.cast("long")), F.lit(self.manifest(version)["buckets"])).cast("int")

    def read(self, spark: SparkSession, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version (the current one), or those of its parts that hold ``buckets``."""
        entry = self.manifest(version)["tables"][table]
        schema = StructType.fromJson(entry["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [p for b, p in sorted(entry["parts"].items()) if wanted is None or b in wanted or b == "*"]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], expected: int, buckets: Iterable[int] | None = None, note: dict | None = None, sort: dict[str, tuple[str, ...]] | None = None) -> int:
        """Writes ``tables`` and claims the version after ``expected``. Tables left out stay as they are; with ``buckets`` the
        given ones hold the rows of these parts only, and the other parts stay as well. ``sort`` names the columns by which a table's files are
        sorted."""
        if self.version() != expected:
            raise StaleSnapshot(f"version {expected} is no longer current")
        old = self.manifest(expected)
        home = f"{self.root}/data/{expected + 1:08d}-{uuid.uuid4().hex}"
        touched = None if buckets is None else {str(b) for b in buckets}
        done = dict(old["tables"])
        try:
            for name, df in tables.items():
                at = f"{home}/{name}"
                before = old["tables"].get(name, {}).get("parts", {})
                if "repo_id" in df.columns:
                    # rows of one part to one task, a hot part to several
                    rows = df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col("repo_id").cast("long")), F.lit(old["buckets"])).cast("int"))
                    rows = rows.hint("rebalance", BUCKET)
                    if sort and name in sort:
                        rows = rows.sortWithinPartitions(BUCKET, *sort[name])
                    rows.write.partitionBy(BUCKET).parquet(at)
                    parts = {n.split("=")[1]: f"{at}/{n}" for n in self.files.names(at) if n.startswith(BUCKET + "=")}
                    kept = {} if touched is None else {b: p for b, p in before.items() if b not in touched}
                    if touched is not None and not set(parts) <= touched:
                        raise ValueError(f"{name} has rows outside the parts that are replaced")
                    parts = {**kept, **parts}
                else:
                    df.write.parquet(at)
                    parts = {"*": at}
                done[name] = {"schema": df.schema.jsonValue(), "parts": parts}
            text = json.dumps({"version": expected + 1, "buckets": old["buckets"], "tables": done, "note": {**old["note"], **(note or {})}})
            if not self.files.claim(f"{self.root}/versions/v{expected + 1:08d}.json", text):
                raise StaleSnapshot(f"version {expected} is no longer current")
        except BaseException:
            self.files.remove(home)
            raise
        return expected + 1
