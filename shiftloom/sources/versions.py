"""A keyed cache as a table of versions: readers see one whole version, writers don't wait for each other.

A key falls into one of ``buckets`` by hash. A version is a small JSON manifest that names, for each bucket, the folders that
hold its rows; it never changes. A write puts its rows into a new folder, partitioned by bucket, and then tries to make the
next manifest, which is an atomic act of the file system that only one writer can succeed in (a rename that doesn't replace,
as HDFS has it; a hard link on local disks; object stores without either need another commit). One that comes too late
takes the newer version as its base: if other buckets were written, its own folders are named beside those; if the same
buckets, its rows are worked out anew against what is there now. Readers list no folders and window no history: they
read the files that one manifest names, and an older version can be read as long as ``clean`` hasn't removed it.

``put`` replaces the rows of its keys, so it writes the touched buckets anew, and only those. ``add`` is for keys that the
table lacks: rows of keys that another writer added meanwhile are left out, and a bucket gets one more folder; one that would
have more than ``most`` is written anew instead (compaction). A key may have several rows; they come and go together. null keys
are keys. A failed write leaves folders that no manifest names; ``clean`` removes those older than a given age.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MOST = 16, 8


class Files:
    """What the table asks of the file system that a path lies in."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.at = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, milliseconds of its last change) of what a folder holds; none if it isn't there."""
        where = self.at(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a whole file, unless there is one of the name: of several writers, one has True."""
        draft = f".draft-{uuid.uuid4().hex}"
        self.fs.mkdirs(self.at(name).getParent())
        stream = self.fs.create(self.at(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":  # here a rename would replace; a hard link doesn't
                local = lambda x: self.jvm.java.io.File(self.fs.makeQualified(self.at(x)).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(name), local(draft))
                return True
            return bool(self.fs.rename(self.at(draft), self.at(name)))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.fs.exists(self.at(draft)):
                self.fs.delete(self.at(draft), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS, most: int = MOST) -> None:
        self.spark, self.files, self.keys, self.buckets, self.most = spark, Files(spark, path), list(keys), buckets, most
        self.schema = T.StructType.fromDDL(schema)

    # Versions.

    def version(self) -> int:
        """The latest version; 0 is the empty table."""
        return max([int(n.removesuffix(".json")) for n, _ in self.files.names("versions") if n.endswith(".json")], default=0)

    def manifest(self, version: int) -> dict[str, list[str]]:
        """Folders of each bucket."""
        return json.loads(self.files.read(f"versions/{version:010d}.json")) if version else {}

    def rows(self, version: int | None = None) -> DataFrame:
        """The table at a version (the latest one, unless given)."""
        return self._of(self.manifest(self.version() if version is None else version))

    def _of(self, manifest: dict[str, list[str]], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.files.path}/{f}" for k, folders in manifest.items() if only is None or int(k) in only for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # Writing.

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders with the rows, by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.files.path}/{folder}")
        return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n, _ in self.files.names(folder) if n.startswith("_bucket=")}

    def _unlike(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        """``rows`` whose keys ``other`` doesn't have."""
        keys = other.select(*[F.col(k).alias(f"_other_{k}") for k in self.keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in self.keys])
        return rows.join(keys, same, "left_anti")

    def _commit(self, work: Callable[[dict[str, list[str]]], tuple[dict[str, list[str]], list[int]]], touched: list[int]) -> int:
        """Makes a version of what ``work`` gives for a manifest: new folders of the touched buckets."""
        base, made = None, None
        while True:
            now = self.version()
            before = self.manifest(now)
            if base is None or any(before.get(str(k)) != base.get(str(k)) for k in touched):
                base, (made, touched) = before, work(before)
            if not touched:
                return now
            after = {k: f for k, f in (before | {str(k): made.get(str(k), []) for k in touched}).items() if f}
            if self.files.create(f"versions/{now + 1:010d}.json", json.dumps(after, sort_keys=True)):
                return now + 1

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets``

    def put(self, rows: DataFrame) -> int:
        """Replaces all rows of the keys in ``rows``; the new version."""
        touched = self._touched(rows)

        def work(before: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[int]]:
            return self._write(self._unlike(self._of(before, touched), rows).unionByName(rows.select(*self.schema.names))), touched

        return self._commit(work, touched)

    def add(self, rows: DataFrame) -> int:
        """Adds the rows whose keys the table lacks; the new version (the old one if it lacks none)."""
        touched = self._touched(rows)

        def work(before: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[int]]:
            full = [k for k in touched if len(before.get(str(k), [])) >= self.most]
            made = self._write(self._unlike(rows, self._of(before, touched)))
            new = [k for k in touched if str(k) in made]
            if anew := [k for k in new if k in full]:
                joined = {k: before.get(k, []) + made[k] for k in map(str, anew)}
                made |= self._write(self._of(joined))
            return {k: f if int(k) in full else before.get(k, []) + f for k, f in made.items()}, new

        return self._commit(work, touched)

    def remove(self, keys: DataFrame) -> int:
        """Removes all rows of the given keys."""
        touched = self._touched(keys)
        return self._commit(lambda before: (self._write(self._unlike(self._of(before, touched), keys)), touched), touched)

    def clean(self, keep: int = 1, older_s: float = 3600.0) -> None:
        """Removes all but the last ``keep`` versions, and folders that none of these names and that are older than ``older_s``
        seconds: what is being written has no version yet."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        named = {f.split("/")[1] for v in kept for folders in self.manifest(v).values() for f in folders}
        for n, _ in self.files.names("versions"):
            if n.endswith(".json") and int(n.removesuffix(".json")) not in kept:
                self.files.delete(f"versions/{n}")
        for n, changed in self.files.names("data"):
            if n not in named and changed < (time.time() - older_s) * 1000:
                self.files.delete(f"data/{n}")

    # Reading through.

    def missing(self, wanted: DataFrame) -> DataFrame:
        return self._unlike(wanted.select(*self.keys).distinct(), self.rows())

    def read_through(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the wanted keys; those that the table lacks are worked out and added."""
        absent = self.missing(wanted)
        if not absent.isEmpty():
            self.add(compute(absent))
        keys = wanted.select(*[F.col(k).alias(f"_wanted_{k}") for k in self.keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_wanted_{k}")) for k in self.keys])
        return self.rows().join(keys, same, "left_semi")
