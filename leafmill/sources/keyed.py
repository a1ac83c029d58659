"""A keyed Parquet table of hash buckets under versioned manifests.

Rows go to one of a fixed number of buckets by a hash of their key. A manifest names the files of each bucket; it is
one small JSON file, as long as the number of buckets and files, never of rows. A change reads and rewrites the
buckets that it touches alone, then commits by creating the next manifest, which fails if another writer was first.
So readers see whole versions, a killed change leaves the old version as it was (and files that no manifest names,
which `vacuum` removes), and of two writers that touch different buckets neither works twice: the later one carries
the new files of the earlier one over.

A batch of a stream commits its number with its rows: a replay is a no-op.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
ATTEMPTS = 20
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer changed the same buckets first, again and again."""


@dataclass
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: str
    files: dict[int, list[str]] = field(default_factory=dict)  # relative to the table
    batches: dict[str, int] = field(default_factory=dict)  # of each stream the newest one

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def read(cls, text: str) -> Manifest:
        held = json.loads(text)
        return cls(**held | {"files": {int(b): f for b, f in held["files"].items()}})


@dataclass(frozen=True)
class Change:
    version: int
    touched: list[int]  # the buckets that were rewritten
    rows: int  # that the change brought, keys that repeat counted once


class KeyedTable:
    """A table at `path`, which any file system that Spark writes to may hold."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._paths(self.path).getFileSystem(self._conf)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> KeyedTable:
        """An empty table; the one that is there already if it has the same keys, buckets and columns."""
        table = cls(spark, path)
        first = Manifest(0, list(keys), buckets, schema.json())
        if not table._put(first):
            there = table.manifest()
            if (there.keys, there.buckets, _plain(there.schema)) != (first.keys, first.buckets, _plain(first.schema)):
                raise ValueError(f"{path} holds another table")
        return table

    def versions(self) -> list[int]:
        folder = self._paths(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        place = self._paths(f"{self.path}/manifests/{found[-1] if version is None else version:012}.json")
        stream = self._fs.open(place)
        try:
            return Manifest.read(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: Manifest) -> bool:
        """Create the manifest file whole, unless there is one of its version."""
        place = self._paths(f"{self.path}/manifests/{manifest.version:012}.json")
        draft = self._paths(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(manifest.text().encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        self._fs.mkdirs(place.getParent())
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), options)  # not over another file
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                return False
            raise e

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the newest or a named version, of all buckets or some."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        files = [f"{self.path}/{f}" for b, names in sorted(manifest.files.items()) if buckets is None or b in set(buckets) for f in names]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """The rows whose keys are among those asked for; only their buckets are read."""
        manifest = self.manifest()
        keys = asked.select(*manifest.keys).distinct()
        rows = self._rows(manifest, self._touched(keys, manifest))
        return rows.join(keys, _same(rows, keys, manifest.keys), "left_semi")

    def _touched(self, rows: DataFrame, manifest: Manifest) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(_bucket(manifest)).distinct().collect())

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> Change | None:
        """Rows take the place of those with equal keys. Of several new rows of a key the one with the highest other
        columns stays. None if this batch of the stream is in the table already."""

        def merged(old: DataFrame, new: DataFrame, manifest: Manifest) -> DataFrame:
            return old.join(new, _same(old, new, manifest.keys), "left_anti").unionByName(new)

        return self._change(rows, merged, stream, batch)

    def delete(self, gone: DataFrame) -> Change | None:
        """Rows with these keys go."""
        return self._change(gone, lambda old, new, manifest: old.join(new, _same(old, new, manifest.keys), "left_anti"))

    def update(self, changes: DataFrame, column: str) -> Change | None:
        """Rows that are there get new values of one column; other keys are left out."""

        def changed(old: DataFrame, new: DataFrame, manifest: Manifest) -> DataFrame:
            fresh = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(manifest.keys)], F.col(column).alias("_new"), F.lit(True).alias("_met"))
            same = [old[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(manifest.keys)]
            met = old.join(fresh, _all(same), "left")
            value = F.when(F.col("_met"), F.col("_new")).otherwise(F.col(column)).alias(column)
            return met.select(*[value if c == column else F.col(c) for c in old.columns])

        return self._change(changes, changed)

    def _change(self, rows: DataFrame, merge: Callable, stream: str | None = None, batch: int = 0) -> Change | None:
        base = self.manifest()
        if stream is not None and base.batches.get(stream, -1) >= batch:
            return None
        folder = f"data/{uuid.uuid4().hex}"
        held = f"{self.path}/{folder}"
        last(rows, base.keys).withColumn(BUCKET, _bucket(base)).write.parquet(f"{held}/new")  # read twice, computed once
        new = self.spark.read.parquet(f"{held}/new")
        counts = {r[0]: r[1] for r in new.groupBy(BUCKET).count().collect()}  # at most one number for each bucket
        touched = sorted(counts)
        made: dict[int, list[str]] = {}
        for _ in range(ATTEMPTS):
            redo = [b for b in touched if b not in made]
            if redo:
                made |= self._rewrite(base, new.where(F.col(BUCKET).isin(redo)).drop(BUCKET), redo, merge, f"{folder}/{uuid.uuid4().hex}")
            files = {b: f for b, f in (base.files | made).items() if f}
            batches = base.batches | ({stream: batch} if stream is not None else {})
            mine = Manifest(base.version + 1, base.keys, base.buckets, base.schema, files, batches)
            if self._put(mine):
                self._fs.delete(self._paths(f"{held}/new"), True)
                return Change(mine.version, touched, sum(counts.values()))
            now = self.manifest()
            if stream is not None and now.batches.get(stream, -1) >= batch:
                return None
            for b in touched:  # what another writer changed meanwhile is done again
                if now.files.get(b) != base.files.get(b):
                    made.pop(b, None)
            base = now
        raise Conflict(f"{ATTEMPTS} other changes of {self.path} came first")

    def _rewrite(self, base: Manifest, new: DataFrame, buckets: list[int], merge: Callable, folder: str) -> dict[int, list[str]]:
        """Write the changed buckets; the files of each."""
        merged = merge(self._rows(base, buckets), new, base).withColumn(BUCKET, _bucket(base))
        merged.repartition(len(buckets), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made: dict[int, list[str]] = {b: [] for b in buckets}
        for b in buckets:
            place = self._paths(f"{self.path}/{folder}/{BUCKET}={b}")
            if self._fs.exists(place):
                made[b] = sorted(f"{folder}/{BUCKET}={b}/{s.getPath().getName()}" for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".parquet"))
        return made

    def vacuum(self, keep: int = 1) -> int:
        """Remove the manifests of all but the newest `keep` versions and the folders that no kept one names.

        Returns the number of folders removed. No change may be under way.
        """
        found = self.versions()
        for v in found[:-keep]:
            self._fs.delete(self._paths(f"{self.path}/manifests/{v:012}.json"), False)
        named = {"/".join(f.split("/")[:3]) for v in found[-keep:] for files in self.manifest(v).files.values() for f in files}
        removed = 0
        top = self._paths(f"{self.path}/data")
        for change in self._fs.listStatus(top) if self._fs.exists(top) else []:
            for part in self._fs.listStatus(change.getPath()):
                name = f"data/{change.getPath().getName()}/{part.getPath().getName()}"
                if name not in named:
                    self._fs.delete(part.getPath(), True)
                    removed += 1
        return removed


def last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the one with the highest other columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    found = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"))
    return found.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def _plain(schema: str) -> list:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(schema)).fields]


def _bucket(manifest: Manifest) -> Column:
    types = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(manifest.schema)).fields}
    keys = [F.col(k).cast(types[k]) for k in manifest.keys]  # equal keys of another type go to the same bucket
    return F.pmod(F.xxhash64(*keys), F.lit(manifest.buckets)).cast("int").alias(BUCKET)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, null ones too."""
    return _all([a[k].eqNullSafe(b[k]) for k in keys])
