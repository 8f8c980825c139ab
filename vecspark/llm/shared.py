"""Intermediate tables in the folder that the whole cluster shares, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all of it runs on this machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"

#: A side is broadcast only when its counted rows times their width stay under this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = LOCAL_DEFAULT
    return path.rstrip("/")


class Workspace:
    """Written tables of one run of an operator.

    A staged table cuts the lineage: what reads it survives the loss of any executor, as the files
    lie in the shared folder and were committed by Spark's own writer.
    """

    #: Folders of the runs inside ``swept``.
    _open: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for held in self._open:
            held.append(self)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns it reread."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a staged table that no later plan reads."""
        fs, path = hadoop(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all staged tables but these, as no later plan reads them."""
        fs, path = hadoop(self.spark, self.path)
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in names:
                fs.delete(s.getPath(), True)


@contextmanager
def swept() -> Iterator[None]:
    """Deletes, at the end, the folders of all runs of operators that began inside: their results must be written by then."""
    held: list[Workspace] = []
    Workspace._open.append(held)
    try:
        yield
    finally:
        Workspace._open.remove(held)
        for work in held:
            fs, path = hadoop(work.spark, work.path)
            fs.delete(path, True)


def quoted(name: str) -> str:
    """A column's name as it has to be written where names may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names of its own (``_c0``, …) that clash with no operator's, and these by the names before."""
    names = {c: f"_c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def show(df: DataFrame, names: dict[str, str], *more: Column) -> DataFrame:
    """The columns that ``hide`` has renamed, under their names, and ``more``."""
    return df.select(*[F.col(h).alias(c) for c, h in names.items()], *more)


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``: works for any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def small(df: DataFrame, row_bytes: int, more: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its counted size is under ``limit``.

    ``more``: further bytes of a row, where its width isn't fixed. Beyond the limit the table is returned
    as it is, and the join shuffles (adaptive execution splits skewed partitions of it).
    """
    held = df.agg(F.count("*").alias("n"), F.sum(F.lit(0) if more is None else more).alias("more")).first()
    return F.broadcast(df) if held["n"] * row_bytes + (held["more"] or 0) <= limit else df
