"""Vector files: a data source for ``fvecs`` and ``ivecs`` records, and bundles of Parquet tables.

A record is a little-endian ``int32`` length and so many 4-byte components, so files are cut at record
boundaries and read in parallel. Ids are record numbers.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of a partition.
ROWS = 1 << 17


class Records(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    """Reads ranges of records of one file; the path must be mounted alike on every worker."""

    def __init__(self, options, kind: str):
        self.path, self.kind = options["path"].removeprefix("file://"), kind
        self.rows = int(options.get("rows", ROWS))

    def partitions(self):
        size = os.path.getsize(self.path)
        if not size:
            return [Records(0, 0)]
        with open(self.path, "rb") as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
        if dim <= 0 or size % (4 + 4 * dim):
            raise ValueError(f"{self.path} is no file of vectors of one length")
        n = size // (4 + 4 * dim)
        return [Records(k, min(self.rows, n - k)) for k in range(0, n, self.rows)]

    def read(self, partition):
        if not partition.count:
            return
        with open(self.path, "rb") as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
            f.seek(partition.first * (4 + 4 * dim))
            raw = np.fromfile(f, "<i4", partition.count * (dim + 1)).reshape(-1, dim + 1)
        if (raw[:, 0] != dim).any():
            raise ValueError(f"{self.path} holds vectors of several lengths")
        body = np.ascontiguousarray(raw[:, 1:])
        values = pa.array(body.view("<f4").ravel() if self.kind == "fvecs" else body.ravel())
        for s in range(0, len(raw), 8192):
            n = min(8192, len(raw) - s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values.slice(s * dim, n * dim))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + s, partition.first + s + n)), lists], names=["vec_id", "embedding"])


class FvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        return _Reader(self.options, "fvecs")


class IvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "ivecs"

    def schema(self):
        return "vec_id long, embedding array<int>"

    def reader(self, schema):
        return _Reader(self.options, "ivecs")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def read_fvecs(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    register(spark)
    return spark.read.format("fvecs").option("rows", rows).load(path)


def read_ivecs(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    register(spark)
    return spark.read.format("ivecs").option("rows", rows).load(path)


def truth_of(ivecs: DataFrame) -> DataFrame:
    """``(qid, rank, vec_id)`` of a table of neighbour lists."""
    return ivecs.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("pos", "v")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("v").cast("long").alias("vec_id"))


def write_vecs(df: DataFrame, path: str, kind: str = "fvecs") -> None:
    """Writes ``(vec_id, embedding)`` in the order of the ids, streamed partition by partition to one local file."""
    with open(path, "wb") as f:
        for r in df.orderBy("vec_id").toLocalIterator():
            v = np.array(r["embedding"], "<f4" if kind == "fvecs" else "<i4")
            f.write(np.array([len(v)], "<i4").tobytes() + v.tobytes())


def save_bundle(path: str, train: DataFrame, test: DataFrame, neighbors: DataFrame) -> None:
    """A dataset as three Parquet tables."""
    for name, df in (("train", train), ("test", test), ("neighbors", neighbors)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, max_queries: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test, neighbors = (spark.read.parquet(f"{path}/{n}") for n in ("train", "test", "neighbors"))
    if max_queries is not None:  # the feature: a bounded query set
        test, neighbors = test.filter(F.col("qid") < max_queries), neighbors.filter(F.col("qid") < max_queries)
    return train, test, neighbors


def load_dataset(spark: SparkSession, kind: str, path: str, max_queries: int | None = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(base, queries, truth)`` of a folder: ``vecs`` (``base.fvecs``, ``query.fvecs``, ``groundtruth.ivecs``, each
    perhaps behind a common prefix and ``_``) or ``bundle`` (``save_bundle``). Queries are those up to ``max_queries``."""
    if kind == "bundle":
        return load_bundle(spark, path, max_queries)
    if kind != "vecs":
        raise ValueError(f"unknown kind of dataset {kind!r}: vecs or bundle")
    names = sorted(os.listdir(path.removeprefix("file://")))

    def file(name: str) -> str:
        found = [n for n in names if n == name or n.endswith(f"_{name}")]
        if len(found) != 1:
            raise ValueError(f"{path} holds {len(found)} files for {name}")
        return f"{path}/{found[0]}"

    queries = read_fvecs(spark, file("query.fvecs")).withColumnRenamed("vec_id", "qid")
    truth = truth_of(read_ivecs(spark, file("groundtruth.ivecs")))
    if max_queries is not None:  # the feature: a bounded query set
        queries, truth = queries.filter(F.col("qid") < max_queries), truth.filter(F.col("qid") < max_queries)
    return read_fvecs(spark, file("base.fvecs")), queries, truth


def synthetic(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Seeded normal vectors, made where they are used."""

    def make(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            x = np.array([np.random.default_rng((seed, int(i))).standard_normal(dim) for i in ids], np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))], names=["vec_id", "embedding"])

    return spark.range(rows).withColumnRenamed("id", "vec_id").mapInArrow(make, "vec_id long, embedding array<float>")
