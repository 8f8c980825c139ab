"""From vectors and centroids to postings: replicas, filters, truncation. Postings are ``(cid, vec_id, dist)`` rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.metrics import distance, numpy_distance, numpy_pairs
from vecspark.operators.knn import _first, batch_matrix, matrix_blocks, nearest_centroids, ranked, rows_at_a_time


def nearest(vectors: DataFrame, centroids: DataFrame, metric: str = "L2") -> DataFrame:
    return top_r(vectors, centroids, 1, metric)


def top_r(vectors: DataFrame, centroids: DataFrame, r: int, metric: str = "L2") -> DataFrame:
    """``r`` replicas in the nearest centroids; ties to the smaller id."""
    return nearest_centroids(vectors, centroids, r, metric).select("cid", "vec_id", "dist", "rank")


def closure(vectors: DataFrame, centroids: DataFrame, factor: float, metric: str = "L2") -> DataFrame:
    """Replicas in every centroid within ``factor`` times the nearest distance."""
    near = nearest_centroids(vectors, centroids, 1, metric, within=factor)
    first = F.min("dist").over(Window.partitionBy("vec_id"))
    return near.withColumn("_d0", first).filter(F.col("dist") <= factor * F.col("_d0")).select("cid", "vec_id", "dist", "rank")


def kept_in_order(candidates: Column, between, most: int) -> Column:
    """Walks candidates (id, dist, vector) in order; drops one that lies nearer to a kept one than to the origin."""
    kept = F.filter(candidates, lambda x: F.lit(False))
    return F.aggregate(candidates, kept, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda p: between(p, x)), F.concat(acc, F.array(x))).otherwise(acc))


def nearer(p: Column, x: Column, factor: float, metric: str) -> Column:
    """Whether candidate ``x`` lies nearer to ``p`` than to its origin, by more than rounding (a tie is not nearer)."""
    limit = F.when(x["dist"] > 0, x["dist"] * (1 - 1e-9)).otherwise(x["dist"] * (1 + 1e-9))
    return factor * distance(metric, p["v"], x["v"]) < limit


def thin(at: np.ndarray, near: np.ndarray, dist: np.ndarray, c: np.ndarray, most: int, factor: float, pairs) -> np.ndarray:
    """Which candidates the neighbourhood rule keeps: at most ``most`` for each row.

    ``near``: rows of ``c``, in order of distance for each row ``at``. All rows are walked together, one place
    of their lists after the other.
    """
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(at)))
    kept, count, keep = np.zeros((len(begin), most), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(at), bool)
    for j in range(int(size.max(initial=0))):
        row = np.flatnonzero((size > j) & (count < most))
        if not len(row):
            break
        x, d = near[begin[row] + j], dist[begin[row] + j]
        limit, good = np.where(d > 0, d * (1 - 1e-9), d * (1 + 1e-9)), np.ones(len(row), bool)
        for s in range(int(count[row].max(initial=0))):
            has = np.flatnonzero(good & (count[row] > s))
            good[has[factor * pairs(c[kept[row[has], s]], c[x[has]]) < limit[has]]] = False
        held = row[good]
        kept[held, count[held]] = x[good]
        count[held] += 1
        keep[begin[held] + j] = True
    return keep


def rng_filtered(vectors: DataFrame, centroids: DataFrame, r: int = 8, candidates: int = 64, factor: float = 1.0, metric: str = "L2") -> DataFrame:
    """At most ``r`` replicas among the nearest ``candidates`` centroids, thinned by the neighbourhood rule.

    A centroid is left out if ``factor`` times its distance to one already kept is under its distance to
    the vector. Distances between centroids use the metric's sign on both sides. Without a shuffle where the
    centroids are one block (64 MB); beyond, candidates are joined with their vectors.
    """
    blocks = matrix_blocks(centroids.orderBy("cid"), "cid", "centroid")
    first, more = next(blocks, None), next(blocks, None)
    if first is not None and more is None:
        (cids, c), many, pairs = first, numpy_distance(metric), numpy_pairs(metric)

        def run(batches):
            for b in batches:
                x, step = batch_matrix(b.column(1)), rows_at_a_time(len(c))
                for s in range(0, len(x), step):
                    own = x[s : s + step]
                    at, near, d, _ = _first(many(own, c), own, c, cids, candidates, pairs, finite=False)
                    keep = thin(at, near, d, c, r, factor, pairs)
                    at, near, d = at[keep], near[keep], d[keep]
                    rank = np.arange(1, len(at) + 1) - np.searchsorted(at, at)
                    yield pa.RecordBatch.from_arrays([pa.array(cids[near].astype(np.int32)), b.column(0).take(pa.array(at + s)), pa.array(d), pa.array(rank.astype(np.int32))], names=["cid", "vec_id", "dist", "rank"])

        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.select("vec_id", "embedding").mapInArrow(run, f"cid int, vec_id {kind}, dist double, rank int")
    near = nearest_centroids(vectors, centroids, candidates, metric)
    c = centroids.select(F.col("cid").alias("_c"), F.col("centroid").alias("_v"))
    lists = near.join(c, F.col("cid") == F.col("_c")).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dist", "cid", F.col("_v").alias("v")))).alias("near"))
    rule = lambda p, x: nearer(p, x, factor, metric)
    kept = lists.select("vec_id", F.posexplode(kept_in_order(F.col("near"), rule, r)).alias("pos", "x"))
    return kept.select(F.col("x.cid").alias("cid"), "vec_id", F.col("x.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))


def by_tree(vectors: DataFrame, centroids: DataFrame, r: int = 8, candidates: int = 64, factor: float = 1.0, metric: str = "L2") -> DataFrame:
    """As ``rng_filtered``, with candidates from a best-first walk down a tree over the centroids (one block of them)."""
    from vecspark.operators.tree import build_bkt, search_bkt

    blocks = matrix_blocks(centroids.orderBy("cid"), "cid", "centroid")
    first, more = next(blocks, None), next(blocks, None)
    if first is None or more is not None:
        raise ValueError("a tree is built over one block of centroids (64 MB)")
    cids, c = first
    nodes, pairs = build_bkt(c, metric=metric), numpy_pairs(metric)

    def run(batches):
        for b in batches:
            found = [search_bkt(nodes, c, q, candidates, metric, leaves=2 * candidates) for q in batch_matrix(b.column(1))]
            at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            near, d = (np.concatenate([np.zeros(0), *(f[k] for f in found)]) for k in (0, 1))
            near = near.astype(np.int64)
            keep = thin(at, near, d, c, r, factor, pairs)
            at, near, d = at[keep], near[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(cids[near].astype(np.int32)), b.column(0).take(pa.array(at)), pa.array(d)], names=["cid", "vec_id", "dist"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"cid int, vec_id {kind}, dist double")


def centroid_distances(centroids: DataFrame, metric: str = "L2") -> DataFrame:
    """``(a, b, dist)`` of every two centroids: their matrix, in blocks."""
    side = centroids.withColumnRenamed("cid", "a")
    return nearest_centroids(side, centroids, 2**31 - 1, metric, "a", "centroid").select("a", F.col("cid").alias("b"), "dist")


def truncated(postings: DataFrame, limit: int) -> DataFrame:
    """The nearest ``limit`` rows of each posting."""
    return ranked(postings, "cid", [F.col("dist"), F.col("vec_id")], limit, "pos")


def first_come(postings: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest ids of each posting."""
    return ranked(postings, "cid", [F.col("vec_id")], limit, "pos")


def assign(vectors: DataFrame, centroids: DataFrame, r: int, limit: int, metric: str = "L2", rng: bool = True, rng_factor: float = 1.0) -> DataFrame:
    """Replicas thinned by the neighbourhood rule and the nearest kept; without it the first come."""
    if rng:
        return truncated(rng_filtered(vectors, centroids, r, factor=rng_factor, metric=metric), limit)
    return first_come(top_r(vectors, centroids, r, metric), limit)


def without_heads(postings: DataFrame, heads: DataFrame) -> DataFrame:
    """Postings without the vectors that are centroids themselves (``heads(vec_id)``)."""
    return postings.join(heads.select("vec_id"), "vec_id", "left_anti")


def replica_counts(vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """``(vec_id, replicas)`` of every vector, 0 included."""
    n = postings.groupBy("vec_id").agg(F.count("*").alias("n"))
    return vectors.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("replicas"))


def replica_histogram(vectors: DataFrame, postings: DataFrame) -> DataFrame:
    return replica_counts(vectors, postings).groupBy("replicas").agg(F.count("*").alias("n_vectors"))
