"""Versioned tables of records with keys: saved, deleted, read as of a version, compacted, published by swapping a manifest.

A store is a folder. ``data`` holds batches of Parquet files, in each a file a bucket of keys at most, so that
files do not grow in number with the keys. ``manifest`` holds a numbered file for each version, which names its
batches in order. A version is published by moving its finished manifest to its number, which fails if
another writer was first; until then, and if anything fails before, readers see the version before. Deletions are
rows that say so (tombstones). Reading merges: the last row of each key, by batch and then by time, unless it is a tombstone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16  #: buckets of keys, and files of a batch at most


class Taken(RuntimeError):
    """Another writer has published the version; save again."""


class Folder:
    """Small files of a shared folder, by the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path
        self._gateway = spark.sparkContext._gateway

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and move it to its own, in one step that fails where one stands already."""
        draft = f"drafts/{uuid.uuid4().hex}"
        stream = self._fs().create(self._at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        at = self._at(name)
        self._fs().mkdirs(at.getParent())
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(self._at(draft), at, self._gateway.new_array(rename, 0))
        except Exception as e:
            self.remove(draft)
            if "FileAlreadyExists" in str(e):
                raise Taken(name) from None
            raise

    def remove(self, name: str) -> None:
        self._fs().delete(self._at(name), True)


class Store:
    """Records (keys, time, ...) under a folder. ``schema`` is that of the records; the time orders the versions of a key within a batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: tuple[str, ...], time: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.time, self.buckets = spark, path, keys, time, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("manifest") if n.endswith(".json")]

    def batches(self, version: int | None = None) -> list[str]:
        """The batches of a version, by default of the last, in order; none before the first."""
        every = self.versions()
        if version is None and not every:
            return []
        return json.loads(self.folder.read(f"manifest/{max(every) if version is None else version:012d}.json"))["batches"]

    def _write(self, df: DataFrame, deleted: bool) -> str:
        """A batch of ``df``; rows without a key are refused."""
        blank = F.lit(False)
        for k in self.keys:
            blank = blank | (F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "")
        checked = df.withColumn(self.keys[0], F.when(blank, F.raise_error(F.lit(f"a record of a store needs {', '.join(self.keys)}"))).otherwise(F.col(self.keys[0])))
        name = uuid.uuid4().hex
        rows = checked.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(deleted).alias("_deleted"))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.repartition(self.buckets, bucket).write.parquet(f"{self.path}/data/{name}")
        return name

    def _publish(self, before: list[str], batches: list[str], based_on: int) -> int:
        self.folder.publish(f"manifest/{based_on + 1:012d}.json", json.dumps({"batches": batches}))
        return based_on + 1

    def _add(self, df: DataFrame, deleted: bool) -> int:
        last = max(self.versions(), default=0)
        before = self.batches(last) if last else []
        return self._publish(before, [*before, self._write(df, deleted)], last)

    def save(self, df: DataFrame) -> int:
        """Add records; those of a key that is there already become its last version. The number of the store's new version."""
        return self._add(df, False)

    def delete(self, keys: DataFrame) -> int:
        """Take the keys out; those that are not there are none the worse."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
        return self._add(keys.select(*self.keys, *rest), True)

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` all that there is: a batch that is read alone. Earlier versions stay as they are, until ``vacuum``."""
        return self._publish([], [self._write(df, False)], max(self.versions(), default=0))

    def load(self, version: int | None = None) -> DataFrame:
        """The last record of each key, as of a version; equal times of a batch are settled by the greater record."""
        names = self.batches(version)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType())])
        parts = [self.spark.read.schema(stored).parquet(f"{self.path}/data/{name}").withColumn("_batch", F.lit(i)) for i, name in enumerate(names)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        last = every.groupBy(*self.keys).agg(F.max(F.struct("_batch", F.col(self.time).alias("_time"), "_deleted", *[F.col(c) for c in rest])).alias("r"))
        return last.where("NOT r._deleted").select(*[F.col(f.name) if f.name in self.keys else F.col(f"r.{f.name}") for f in self.schema.fields])

    def list(self) -> DataFrame:
        """(keys, time), newest first, then by key."""
        return self.load().select(*self.keys, self.time).orderBy(F.desc(self.time), *self.keys)

    def compact(self) -> int:
        """Put all batches into one."""
        last = max(self.versions(), default=0)
        return self._publish([], [self._write(self.load(last), False)] if last else [], last)

    def restore(self, version: int) -> int:
        """Publish what an earlier version held as the new one."""
        return self._publish([], self.batches(version), max(self.versions(), default=0))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the versions before the last ``keep`` and the batches that no version names any more."""
        every = self.versions()
        for v in every[:-keep]:
            self.folder.remove(f"manifest/{v:012d}.json")
        named = {b for v in every[-keep:] for b in self.batches(v)}
        gone = [b for b in self.folder.names("data") if b not in named]
        for b in gone:
            self.folder.remove(f"data/{b}")
        return gone


def packages(spark: SparkSession, path: str, schema: str) -> Store:
    """Answered questions (conv_id, saved_at, ...)."""
    return Store(spark, path, schema, ("conv_id",), "saved_at")


#: What is kept of a project; outlines and reports are kept for each audience.
ARTIFACTS, FOR_AUDIENCES = ("brief", "research", "insights"), ("outline", "compliance")


def artifact(kind: str, audience: str = "") -> str:
    """The name of what is kept of a project: ``brief``, ``outline_patient`` ..."""
    if kind in ARTIFACTS and not audience:
        return kind
    if kind in FOR_AUDIENCES and audience:
        return f"{kind}_{audience}"
    raise ValueError(f"no artifact {kind!r} for {audience!r}")


def projects(spark: SparkSession, path: str) -> Store:
    """(project, artifact, saved_at, body): what is kept of projects, bodies as JSON."""
    return Store(spark, path, "project string, artifact string, saved_at timestamp, body string", ("project", "artifact"), "saved_at")


def project_names(store: Store) -> DataFrame:
    """Projects that have a brief, by name."""
    return store.load().where("artifact = 'brief'").select("project").orderBy("project")


#: Kinds of corrections.
CORRECTIONS = ("trial", "drug", "file_mapping", "rich_text", "sync_direction", "general")
CORRECTION = (
    "id string, timestamp timestamp, type string, context string, before string, after string, expected_algorithm_change string, test_case string, status string, source_project string, row_index int, slide_page string, doi_before string, doi_after string"
)


def corrections(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, CORRECTION, ("id",), "timestamp")


def record(store: Store, entries: DataFrame, now: datetime) -> int:
    """Add corrections. Without a time, an entry gets ``now``; without an id, one made of the time and of what it says; without a status, it is pending; unknown types are general."""
    named = {f.name: f.dataType for f in store.schema.fields}
    x = entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(t).alias(c) for c, t in named.items()])
    at = F.coalesce("timestamp", F.lit(now))
    said = F.sha1(F.to_json(F.struct(*[c for c in named if c not in ("id", "timestamp", "status")])))
    x = x.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("corr-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(said, 1, 12))).otherwise(F.col("id")))
    kind = F.when(F.col("type").isin(*CORRECTIONS), F.col("type")).otherwise("general")
    return store.save(x.withColumn("timestamp", at).withColumn("type", kind).withColumn("status", F.when(F.coalesce("status", F.lit("")) == "", "pending").otherwise(F.col("status"))))


def snapshot(cells: DataFrame, header: Iterable[str]) -> DataFrame:
    """Rows (row, header ...) of a sheet's range ``cells`` (row, values): row 1 is the header, and rows count to the last whose first value isn't blank.

    Short rows are filled with empty values, long ones cut to the header; rows between that are not there at all are not made up.
    A header of other names, or no row below it, is a ValueError.
    """
    names = list(header)
    first = cells.where("row = 1").select("values").first()
    given = [(v or "").strip().lstrip("﻿") for v in (first["values"] or [])] if first else []
    if given != names:
        raise ValueError(f"header {given} instead of {names}")
    last = cells.where(F.trim(F.coalesce(F.get("values", F.lit(0)), F.lit(""))) != "").agg(F.max("row").alias("n")).first()["n"]
    if not last or last < 2:
        raise ValueError("no rows below the header")
    x = cells.where(F.col("row").between(2, last))
    return x.select("row", *[F.coalesce(F.get("values", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum over them that tells tables apart whatever the order of rows."""
    columns = sorted(df.columns)
    both = [F.sum(F.xxhash64(F.lit(k), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("decimal(38,0)")) for k in (0, 1)]
    r = df.agg(F.count("*").alias("n"), F.concat_ws(":", *[b.cast("string") for b in both]).alias("h")).first()
    return r["n"], r["h"]


def direction(base: DataFrame, local: DataFrame, remote: DataFrame) -> str:
    """What to do with two tables that were equal to ``base``: ``push`` if only the local one has changed, ``pull`` if only the remote one has, ``same`` if they are equal, else ``conflict``."""
    b, here, there = digest(base), digest(local), digest(remote)
    if here == there:
        return "same"
    return "pull" if here == b else "push" if there == b else "conflict"


def pull(store: Store, cells: DataFrame, header: Iterable[str]) -> int:
    """Make a store of the rows (row, header ...) what a sheet holds. The version before is the backup: ``restore`` brings it back."""
    return store.replace(snapshot(cells, header))
