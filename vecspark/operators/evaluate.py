"""Recall, balance, latency and storage measures."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.metrics import norm


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(qid, recall)``: the share of the ``k`` true neighbours that were found; a query without any has 0."""
    hits = truth.filter(F.col("rank") <= k).select("qid", "vec_id").join(found.select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def within(truth: DataFrame, rows: int) -> DataFrame:
    """The truth about a base table that was cut to its first ``rows`` vectors, ranked anew."""
    w = Window.partitionBy("qid").orderBy("rank")
    return truth.filter(F.col("vec_id") < rows).withColumn("rank", F.row_number().over(w))


def stage_seconds(stages: dict[str, DataFrame]) -> dict[str, float]:
    """Seconds that each plan takes by itself, run to its end without a result; for plans that grow by a stage each."""
    out = {}
    for name, df in stages.items():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - began
    return out


def mean_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    return recall(truth, found, k).agg(F.avg("recall").alias("recall"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Agreement of two searches."""
    return mean_recall(a, b, k)


def latency(times: DataFrame, column: str) -> DataFrame:
    """Percentiles (linear between ranks), mean and queries a second of durations in seconds."""
    p = [F.percentile(column, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)]
    return times.agg(*p, F.avg(column).alias("mean"), (F.count(column) / F.sum(column)).alias("qps"))


def balance(postings: DataFrame) -> DataFrame:
    """Sizes of clusters, and the ratio of their deviation to their mean."""
    n = postings.groupBy("cid").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_clusters"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.avg("n").alias("size_avg"), F.stddev_pop("n").alias("size_std"), (F.stddev_pop("n") / F.avg("n")).alias("ratio"))


def norm_profile(vectors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Least, largest and mean norm, and whether all are 1."""
    n = vectors.select(norm(F.col("embedding")).alias("n"))
    return n.agg(F.count("*").alias("n_vectors"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), F.avg("n").alias("norm_avg"), F.bool_and(F.abs(F.col("n") - 1) <= tolerance).alias("all_unit"))


def storage(codes: DataFrame) -> DataFrame:
    """Bytes of vectors, bytes of their stored codes (one a component, and an id) and the share saved."""
    n = F.size("code").cast("long")
    held = codes.agg(F.count("*").alias("n_vectors"), F.sum(4 * n).alias("vector_bytes"), F.sum(n + 4).alias("code_bytes"))
    return held.withColumn("saved", 1 - F.col("code_bytes") / F.col("vector_bytes"))


def disk_usage(spark, path: str) -> int:
    """Bytes under a path of any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())
