"""Size-tiered compaction of immutable shards, with versioned manifests that are committed atomically.

A shard is one Parquet file. Arrivals are appended as small shards; runs of similarly sized shards are
merged into files of about the target size. A manifest lists the shards of a version and their columns; a
version exists once its manifest does, so a failed or lost writer leaves files that no reader sees. Writers
may run beside each other: a change is planned on one version and committed against the latest, if that
still holds all shards that the change replaces.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from vecspark.llm.shared import hadoop


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class ShardStore:
    """Shards under ``root`` (any store that Spark reaches).

    Rows come back as they were appended: nulls in any column, empty and very long texts, repeated rows
    (each is kept). Columns may have any names. An arrival may lack columns of the store (they are null for
    its rows) or bring new ones (null for older rows); a column of another type than before is an error.
    Shards of equal size are taken in the order of their paths. An empty arrival makes a version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Manifests

    def version(self) -> int:
        """The latest version; 0 if nothing has been committed."""
        fs, p = hadoop(self.spark, f"{self.root}/_manifests")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Shard], T.StructType]:
        """The shards of a version (the latest, if unset) and their columns; nothing before the first."""
        version = self.version() if version is None else version
        if not version:
            return [], T.StructType()
        fs, p = hadoop(self.spark, f"{self.root}/_manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return [Shard(**s) for s in held["shards"]], T.StructType.fromJson(held["schema"])

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.manifest(version)[0]

    def commit(self, shards: list[Shard], schema: T.StructType, parent: int) -> int:
        """Makes ``shards`` the version after ``parent``; raises ``Conflict`` if there is one already.

        The manifest is written under another name and renamed to its own, which fails if that exists.
        """
        jvm = self.spark.sparkContext._jvm
        final, temp = f"{self.root}/_manifests/{parent + 1:012d}.json", f"{self.root}/_manifests/.{uuid.uuid4().hex}"
        fs, p = hadoop(self.spark, temp)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps({"version": parent + 1, "parent": parent, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").valueOf("NONE")
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(p, jvm.org.apache.hadoop.fs.Path(final), options)
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {parent + 1} exists") from e
            raise
        return parent + 1

    def replace(self, gone: list[Shard], new: list[Shard], schema: T.StructType) -> int:
        """Commits the latest version without ``gone`` and with ``new``, however many versions came meanwhile.

        Raises ``Conflict`` if another writer has replaced one of ``gone``.
        """
        while True:
            parent = self.version()
            held, before = self.manifest(parent)
            if not set(gone) <= set(held):
                raise Conflict("another writer has replaced these shards")
            try:
                out = set(gone)
                return self.commit([s for s in held if s not in out] + new, joined(before, schema), parent)
            except Conflict:
                continue  # the next version is there by now

    # Data

    def _write(self, df: DataFrame, by: str | None = None) -> list[Shard]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        fs, p = hadoop(self.spark, path)
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet"):
                found.append(Shard(s.getPath().toString(), int(s.getLen())))
        return sorted(found, key=lambda s: s.path)

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def append(self, df: DataFrame) -> int:
        """Writes each partition of ``df`` as a small shard and commits them as a new version. No shuffle."""
        joined(self.manifest()[1], df.schema)  # before anything is written
        return self.replace([], self._write(df), df.schema)

    def append_each(self, df: DataFrame, arrival: Column) -> int:
        """A backlog of arrivals, told apart by ``arrival``, in one pass and with a version for each. No shuffle."""
        joined(self.manifest()[1], df.schema)
        name = "_arrival"
        while name in df.columns:
            name += "_"
        by_arrival: dict[str, list[Shard]] = {}
        for s in self._write(df.withColumn(name, arrival), by=name):
            by_arrival.setdefault(s.path.rsplit("/", 2)[1], []).append(s)
        for _, shards in sorted(by_arrival.items()):
            self.replace([], shards, df.schema)
        return self.version() if by_arrival else self.replace([], [], df.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        shards, schema = self.manifest(version)
        if not schema.fields:
            raise ValueError("nothing has been appended")
        return self._read(shards, schema) if shards else self.spark.createDataFrame([], schema)

    def compact(self, target: int = 128 << 20, ratio: float = 4.0, least: int = 4) -> int:
        """Merges runs of similarly sized shards until none is left to merge; returns the latest version.

        A merge joins partitions without a shuffle, and its rows are counted by Spark's own writer. Each round
        is planned on one version and is one version. Where another writer has replaced a shard of the round
        meanwhile, the round's files are deleted and it is planned anew. Files of older versions stay until
        ``vacuum``.
        """
        while True:
            version = self.version()
            held, schema = self.manifest(version)
            runs = tiers(held, target, ratio, least)
            if not runs:
                return version
            merged = []
            for run in runs:
                total = sum(s.bytes for s in run)
                merged += self._write(self._read(run, schema).coalesce(max(1, round(total / target))))
            try:
                self.replace([s for run in runs for s in run], merged, schema)
            except Conflict:
                for s in merged:
                    fs, p = hadoop(self.spark, s.path)
                    fs.delete(p, False)

    def vacuum(self, grace_s: float = 86_400) -> int:
        """Deletes data files that the latest version doesn't list; returns how many. Older versions can't be read then.

        Files younger than ``grace_s`` stay: their writer may not have committed yet.
        """
        fs, p = hadoop(self.spark, f"{self.root}/data")
        files, old = fs.listFiles(p, True) if fs.exists(p) else None, []
        while files and files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet") and s.getModificationTime() <= (time.time() - grace_s) * 1000:
                old.append(s.getPath())
        live = {s.path for s in self.shards()}  # read after the files: what was committed meanwhile stays
        return sum(bool(fs.delete(f, False)) for f in old if f.toString() not in live)


def joined(before: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, by name; raises if a column's type differs."""
    kinds = {f.name: f.dataType.simpleString() for f in before}
    for f in new:
        if kinds.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {kinds[f.name]}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*before, *(f for f in new if f.name not in kinds)]])


def tiers(shards: list[Shard], target: int, ratio: float, least: int) -> list[list[Shard]]:
    """Runs to merge: at least ``least`` shards, each at most ``ratio`` times the smallest of its run, all under half the target.

    A run ends once it holds sixteen targets, so that a merge is bounded and can be done again if lost.
    """
    runs, run, held = [], [], 0
    for s in sorted((s for s in shards if s.bytes < target / 2), key=lambda s: (s.bytes, s.path)):
        if run and (s.bytes > ratio * max(1, run[0].bytes) or held >= 16 * target):
            runs.append(run)
            run, held = [], 0
        run.append(s)
        held += s.bytes
    return [r for r in [*runs, run] if len(r) >= least]
