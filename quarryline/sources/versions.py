"""Stored tables whose versions are lists of data files: changes rewrite the files they concern and no other.

Below the table's folder, ``data/`` holds Parquet files that are never changed and ``versions/`` one list of files for each
version. A version comes into being when its list takes its number, a single rename that fails if the number is taken. So
a reader finds the version before or the version after a change, and of two changes to the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import delete_rows, holds, update_rows

_DIGITS = 12


class Conflict(RuntimeError):
    """Somebody else made the version that this change was to make; nothing was changed."""


@dataclass(frozen=True)
class Change:
    """What a change did: the version it made, rows (of a merge, buckets) concerned, and files it read again, wrote and left alone."""

    version: int
    rows: int
    replaced: list[str] = field(default_factory=list)
    written: list[str] = field(default_factory=list)
    kept: int = 0


class _Folder:
    """The few things asked of the file system itself, on the driver, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = folder.rstrip("/")
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *below: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))

    def names(self, *below: str) -> list[str]:
        at = self._path(*below)
        if not self._fs.exists(at):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(at))

    def read(self, *below: str) -> str:
        stream = self._fs.open(self._path(*below))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *below: str) -> None:
        """A file that has all of its text from the moment it has its name. Raises when the name is taken."""
        hadoop = self._jvm.org.apache.hadoop.fs
        staged = self._path(*below[:-1], f"_{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            context = hadoop.FileContext.getFileContext(staged.toUri(), self._conf)
            # No overwriting: the second of two writers gets an error.
            options = self._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.NONE.getClass(), 1)
            options[0] = hadoop.Options.Rename.NONE
            context.rename(staged, self._path(*below), options)
        except Exception as error:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{'/'.join(below)} exists") from None
            raise

    def delete(self, *below: str) -> None:
        self._fs.delete(self._path(*below), True)


class StoredTable:
    """A table in a folder that all executors see. Opening reads nothing; every call looks at the newest version."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, _Folder(spark, folder)

    def versions(self) -> list[int]:
        return [int(name) for name in self._folder.names("versions") if name.isdigit()]

    def _stored(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no such version of the table in {self._folder.path}")
        version = known[-1] if version is None else version
        return version, json.loads(self._folder.read("versions", f"{version:0{_DIGITS}d}"))

    def _state(self, version: int | None = None) -> tuple[int, T.StructType, list[str]]:
        version, state = self._stored(version)
        return version, T.StructType.fromJson(state["schema"]), state["files"]

    def notes(self) -> dict:
        """What was written down beside the newest version, or the one it was changed from; nothing if there is none."""
        return self._stored()[1].get("notes", {}) if self.versions() else {}

    def _rows(self, schema: T.StructType, files: list[str]) -> DataFrame:
        if not files:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{self._folder.path}/data/{name}" for name in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named. The frame stays with its files whatever happens next."""
        _, schema, files = self._state(version)
        return self._rows(schema, files)

    def files(self, version: int | None = None) -> list[str]:
        return self._state(version)[2]

    def _written(self, rows: DataFrame) -> list[str]:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self._folder.path}/data/{part}")
        return [f"{part}/{name}" for name in self._folder.names("data", part) if name.endswith(".parquet")]

    def _commit(self, version: int, schema: T.StructType, files: list[str], notes: dict | None = None) -> None:
        text = json.dumps({"schema": schema.jsonValue(), "files": files, "notes": notes or {}})
        try:
            self._folder.create(text, "versions", f"{version:0{_DIGITS}d}")
        except Conflict:
            raise Conflict(f"version {version} of the table in {self._folder.path} was made by another change") from None

    def replace(self, rows: DataFrame) -> Change:
        """The rows as the table's next version, or its first one. Columns may differ from those before."""
        version = max(self.versions(), default=0) + 1
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        written = self._written(rows)
        self._commit(version, schema, written)
        return Change(version, self.read(version).count(), [], written)

    def append(self, rows: DataFrame) -> Change:
        """More rows, matched by column name: a column the table lacks is an error, one the rows lack is null."""
        version, schema, files = self._state()
        given = {name.lower(): name for name in rows.columns}
        unknown = sorted(set(given) - {f.name.lower() for f in schema.fields})
        if unknown:
            raise ValueError(f"the table has no column {', '.join(unknown)}")
        placed = [
            (F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        written = self._written(rows.select(*placed))
        self._commit(version + 1, schema, files + written, self._stored(version)[1].get("notes"))
        return Change(version + 1, self._rows(schema, written).count(), [], written, len(files))

    def change(self, predicate: str | Column, assignments: dict[str, str | Column] | None = None, confirm: bool = False) -> Change:
        """Deletes the rows the predicate holds for or, with ``assignments``, updates them.

        A first pass asks which files hold such rows, reading the predicate's columns only, and Parquet's own statistics pass
        over most others. Those files are written anew; all others are taken over by name. No row, no new version.
        """
        if not confirm:
            raise PermissionError(f"changing the table in {self._folder.path} needs confirmation")
        version, schema, files = self._state()
        name = F.substring_index("_metadata.file_path", "/", -1 - files[0].count("/")) if files else None
        hit = self._rows(schema, files).where(holds(predicate)).groupBy(name.alias("file")) if files else None
        found = {r["file"]: r["n"] for r in hit.agg(F.count("*").alias("n")).collect()} if hit else {}
        if not found:
            return Change(version, 0, kept=len(files))
        touched = self._rows(schema, sorted(found))
        changed = delete_rows(touched, predicate) if assignments is None else update_rows(touched, assignments, predicate)
        written = self._written(changed)
        kept = [f for f in files if f not in found]
        self._commit(version + 1, schema, kept + written, self._stored(version)[1].get("notes"))
        return Change(version + 1, sum(found.values()), sorted(found), written, len(kept))

    def delete(self, predicate: str | Column, confirm: bool = False) -> Change:
        return self.change(predicate, None, confirm)

    def update(self, assignments: dict[str, str | Column], predicate: str | Column, confirm: bool = False) -> Change:
        return self.change(predicate, assignments, confirm)

    def expire(self, keep: int = 1) -> list[str]:
        """Forgets all versions but the last ``keep`` and drops the files that only they named; readers of those lose them.

        Files of changes that are still being written are not named by any version yet and stay.
        """
        known = self.versions()
        old, left = known[:-keep], known[-keep:]
        named = {f for v in left for f in self.files(v)}
        gone = sorted({f for v in old for f in self.files(v)} - named)
        for version in old:
            self._folder.delete("versions", f"{version:0{_DIGITS}d}")
        for file in gone:
            self._folder.delete("data", *file.split("/"))
        return gone


class KeyedTable(StoredTable):
    """A stored table of one row per key, its files dealt out by a hash of the key.

    New rows concern the files of their own keys' buckets: these are read, merged and written anew, others are not opened.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, folder)
        self._keys, self._buckets = keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self._keys]), F.lit(self._buckets)).cast("int").alias("_bucket")

    def _written(self, rows: DataFrame) -> list[str]:
        part = uuid.uuid4().hex
        dealt = rows.select("*", self._bucket()).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self._folder.path}/data/{part}")
        return [
            f"{part}/{folder}/{name}"
            for folder in self._folder.names("data", part)
            if folder.startswith("_bucket=")
            for name in self._folder.names("data", part, folder)
            if name.endswith(".parquet")
        ]

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> Change:
        """The version in which ``combine`` has made one row per key of the rows held and the new ones.

        It gets both in one frame, with ``_new`` telling them apart, and gives back the table's columns. It sees all rows of the
        keys concerned and some others, which it must leave as they are.
        """
        if self.versions():
            version, schema, files = self._state()
        else:
            version, schema, files = 0, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]), []
        concerned = {f"_bucket={r[0]}" for r in rows.select(self._bucket()).distinct().collect()}
        touched = [f for f in files if f.split("/")[1] in concerned]
        held = self._rows(schema, touched).withColumn("_new", F.lit(False))
        merged = combine(held.unionByName(rows.withColumn("_new", F.lit(True))))
        written = self._written(merged.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]))
        kept = [f for f in files if f.split("/")[1] not in concerned]
        self._commit(version + 1, schema, kept + written, notes)
        return Change(version + 1, len(concerned), touched, written, len(kept))
