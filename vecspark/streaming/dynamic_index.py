"""An index whose tables are stored and change: inserts, deletes, splits and reassignment, in versions.

A manifest names the files of a version and is renamed into place, so readers see whole versions only and
two writers of the same version are told. Postings and labels are segments: an insert or a delete appends a
small one, and a split rewrites only the buckets of the postings that it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.plans.index import BUCKETS, Config, VectorIndex, bucketed
from vecspark.streaming import dynamic

#: Label segments up to which they are read as they are; then they are merged.
SEGMENTS = 16


class DynamicIndex:
    """Tables under ``root`` (any store that Spark reaches); ``target`` rows a posting, split over twice as many."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = self._latest()

    @classmethod
    def create(cls, spark: SparkSession, root: str, vectors: DataFrame, centroids: DataFrame, target: int = 10000, reassign_k: int = 64, metric: str = "L2") -> DynamicIndex:
        """The first version: ``vectors(vec_id, embedding)``, each in its nearest of ``centroids(cid, centroid)``."""
        self = cls(spark, root)
        if self.state:
            raise ValueError("there is an index already")
        top = vectors.agg(F.max("vec_id")).first()[0]
        path = self._write(vectors.select("vec_id", "embedding"), "vectors")
        held, c = spark.read.parquet(path), self._write(centroids.select("cid", "centroid"), "centroids")
        postings = self._write(bucketed(dynamic.insert(spark.read.parquet(c), held).select("cid", "vec_id")), "postings", "cid_bucket")
        labels = self._write(held.select("vec_id", F.lit(0).alias("label")), "labels")
        self._commit({"target": target, "reassign_k": reassign_k, "metric": metric, "next_id": 0 if top is None else top + 1, "centroids": c, "vectors": [path], "labels": [labels], "postings": [[postings, None]]})
        return self

    # Versions

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _latest(self) -> dict:
        fs, p = self._fs(f"{self.root}/_versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/_versions/{names[-1]}").collect()))

    def _commit(self, state: dict) -> None:
        state = state | {"version": self.state.get("version", 0) + 1}
        fs, temp = self._fs(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/_versions/{state['version']:012d}.json")
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"version {state['version']} was written by another")
        self.state = state

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> str:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return path

    # Tables

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(*self.state["vectors"])

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(self.state["centroids"])

    @property
    def labels(self) -> DataFrame:
        """``(vec_id, label)``: the latest of each id."""
        parts = [self.spark.read.parquet(p).withColumn("seq", F.lit(k)) for k, p in enumerate(self.state["labels"])]
        held = parts[0]
        for p in parts[1:]:
            held = held.unionByName(p)
        return held.groupBy("vec_id").agg(F.max_by("label", "seq").alias("label"))

    @property
    def postings(self) -> DataFrame:
        """``(cid, vec_id, cid_bucket)``, deleted rows not yet collected among them."""
        parts = []
        for path, buckets in self.state["postings"]:
            df = self.spark.read.schema("cid int, vec_id long, cid_bucket int").parquet(path)
            parts.append(df if buckets is None else df.filter(F.col("cid_bucket").isin(buckets)))
        held = parts[0]
        for p in parts[1:]:
            held = held.unionByName(p)
        return held

    def _labelled(self, rows: DataFrame) -> list[str]:
        """Paths of the labels with ``rows(vec_id, label)`` on top."""
        paths = [*self.state["labels"], self._write(rows, "labels")]
        if len(paths) <= SEGMENTS:
            return paths
        self.state = self.state | {"labels": paths}
        return [self._write(self.labels, "labels")]

    # Updates

    def insert(self, arrivals: DataFrame, order: str) -> DataFrame:
        """Stores ``arrivals(embedding)`` in the order of a column; returns them as ``(vec_id, embedding)`` with their new ids.

        Each goes to its nearest posting with version 1. Splits are left to ``maintain``, once a batch.
        """
        sorted_ = arrivals.select("embedding", F.col(order).alias("_o")).orderBy("_o")
        held = self.spark.read.parquet(self._write(sorted_.select("embedding", F.monotonically_increasing_id().alias("row")), "arrivals"))
        part, place = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
        sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
        if not sizes:
            return self.spark.createDataFrame([], "vec_id long, embedding array<float>")
        first, base = self.state["next_id"], []
        for p, n in sizes:
            base += [F.lit(p), F.lit(first)]
            first += n
        path = self._write(held.select((F.create_map(*base)[part] + place).alias("vec_id"), "embedding"), "vectors")
        new = self.spark.read.parquet(path)
        segment = self._write(bucketed(dynamic.insert(self.centroids, new).select("cid", "vec_id")), "postings", "cid_bucket")
        labels = self._labelled(new.select("vec_id", dynamic.bumped(F.lit(None).cast("int")).alias("label")))
        self._commit(self.state | {"next_id": first, "vectors": [*self.state["vectors"], path], "labels": labels, "postings": [*self.state["postings"], [segment, None]]})
        return new

    def delete(self, ids: DataFrame) -> None:
        """Sets the deleted bit of ``ids(vec_id)``; their rows go when their posting is next rewritten."""
        gone = ids.select("vec_id").distinct().join(self.labels, "vec_id", "left").select("vec_id", dynamic.deleted(F.col("label")).cast("int").alias("label"))
        self._commit(self.state | {"labels": self._labelled(gone)})

    def sizes(self) -> DataFrame:
        return dynamic.posting_sizes(dynamic.live(self.postings, self.labels), self.state["target"], self.centroids)

    def maintain(self) -> int:
        """Splits the postings over twice the target (their deleted rows collected first) and reassigns; returns how many."""
        state = self.spark.read.parquet(self._write(dynamic.live(self.postings, self.labels).select("cid", "vec_id"), "work"))
        vectors, c, target = self.vectors, self.centroids, self.state["target"]
        split = dynamic.posting_sizes(state, target).filter("need_split").count()
        if not split:
            return 0
        fresh, moved = (self.spark.read.parquet(self._write(df, "work")) for df in dynamic.split(c, state, vectors, target))
        retired = moved.select(F.col("old").alias("cid")).distinct()
        path = self._write(c.join(retired, "cid", "left_anti").unionByName(fresh.select("cid", "centroid")), "centroids")
        now = self.spark.read.parquet(path)
        after = state.join(retired, "cid", "left_anti").unionByName(moved.select("cid", "vec_id"))
        old = c.select(F.col("cid").alias("old"), F.col("centroid").alias("old_centroid"))
        moves = self.spark.read.parquet(self._write(dynamic.reassign(now, fresh.join(old, "old"), after, vectors, self.state["reassign_k"]), "work"))
        touched = retired.union(fresh.select("cid")).union(moves.select("from_cid")).union(moves.select("to_cid"))
        buckets = sorted(r[0] for r in touched.select(F.pmod("cid", F.lit(BUCKETS)).cast("int")).distinct().collect())  # at most BUCKETS
        rows = bucketed(dynamic.moved(after, moves)).filter(F.col("cid_bucket").isin(buckets))
        segment = self._write(rows, "postings", "cid_bucket")
        kept = [[p, [b for b in (range(BUCKETS) if held is None else held) if b not in set(buckets)]] for p, held in self.state["postings"]]
        self._commit(self.state | {"centroids": path, "postings": [*[k for k in kept if k[1]], [segment, buckets]]})
        return split

    def search(self, queries: DataFrame, k: int = 10, n_probe: int = 20, max_check: int | None = None) -> DataFrame:
        """``(qid, vec_id, rank, dist)`` of ``queries(qid, embedding)`` among the rows that are not deleted."""
        config = Config(0, self.state["metric"], n_probe=n_probe, max_check=max_check)
        index = VectorIndex(config, self.vectors, self.centroids, self.postings, None)
        return index.search(queries, k, deleted=self.labels.filter(dynamic.is_deleted(F.col("label"))))
