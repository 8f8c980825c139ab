"""Clusterings over vector tables: each round is one pass that adds rows up in its tasks, its centroids collected.

Centroids are ``(cid, centroid)``; there are few beside the vectors, and their size is checked where a matrix is sent.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.metrics import check_metric, normalize, numpy_distance, numpy_pairs
from vecspark.functions.params import DEFAULTS
from vecspark.operators import assign
from vecspark.operators.knn import _first, batch_matrix, nearest_centroids, ranked, rows_at_a_time


class ClusteringAlgorithm(Protocol):
    """What an index needs of a clustering."""

    def cluster(self, vectors: DataFrame, target: int | None) -> DataFrame: ...

    def assign_with_replicas(self, vectors: DataFrame, centroids: DataFrame, r: int, limit: int, rng: bool = True) -> DataFrame: ...


def seeds(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors with the smallest ids as centroids 0, 1, …"""
    first = vectors.select("vec_id", "embedding").orderBy("vec_id").limit(k)
    rows = [(i, [float(v) for v in r["embedding"]]) for i, r in enumerate(sorted(first.collect(), key=lambda r: r["vec_id"]))]
    return centroid_table(vectors.sparkSession, rows)


def centroid_table(spark, rows: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame(rows, "cid int, centroid array<double>")


def plus_plus(vectors: DataFrame, k: int, metric: str = "L2", seed: int = 0) -> DataFrame:
    """Seeds drawn with a probability in proportion to the distance to the nearest seed so far.

    Each draw is one pass: the row with the least ``-log(u) / weight`` is a weighted draw.
    """
    check_metric(metric)
    rows = []
    first = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(1).first()
    while first is not None and len(rows) < k:
        rows.append((len(rows), [float(v) for v in first["embedding"]]))
        centres = centroid_table(vectors.sparkSession, rows)
        near = nearest_centroids(vectors, centres, 1, metric).select("vec_id", "dist")
        low = near.agg(F.min("dist")).first()[0]
        weight = F.col("dist") if metric == "L2" else F.col("dist") - F.lit(low)
        u = (F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(len(rows))), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
        drawn = near.filter(weight > 0).orderBy(-F.log(u) / weight, "vec_id").limit(1).first()
        first = drawn and vectors.filter(F.col("vec_id") == drawn["vec_id"]).first()
    return centroid_table(vectors.sparkSession, rows)


def means(assigned: DataFrame) -> DataFrame:
    """``(cid, centroid, n)`` of ``(cid, embedding)`` rows: sums by component are combined before the shuffle."""
    parts = assigned.select("cid", F.posexplode("embedding").alias("pos", "x"))
    by = parts.groupBy("cid", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = by.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"), F.max("n").alias("n"))
    return packed.select("cid", F.transform("p", lambda x: x["m"]).alias("centroid"), "n")


#: Bytes of centroids up to which rounds hold them in the driver and in every task.
CENTROID_BYTES = 512 << 20


def _round(vectors: DataFrame, cids: np.ndarray, c: np.ndarray, cost: np.ndarray | None, metric: str) -> DataFrame:
    """``(cid, n, far, away, total)``: size, largest and summed distance and summed vector of each cluster.

    A task assigns its rows and adds them up, so what is shuffled is one row for each task and cluster.
    """
    many, pairs = numpy_distance(metric), numpy_pairs(metric)

    def run(batches):
        n, away, far, total = np.zeros(len(c), np.int64), np.zeros(len(c)), np.full(len(c), -np.inf), np.zeros(c.shape)
        step = rows_at_a_time(len(c))
        for b in batches:
            x = batch_matrix(b.column(0))
            for s in range(0, len(x), step):
                own = x[s : s + step]
                at, near, d, _ = _first(many(own, c), own, c, cids, 1, pairs, finite=False, cost=cost)
                order = np.argsort(near, kind="stable")
                held, begin = np.unique(near[order], return_index=True)
                total[held] += np.add.reduceat(own[at[order]], begin, axis=0)
                n += np.bincount(near, minlength=len(c))
                away += np.bincount(near, d, len(c))
                np.maximum.at(far, near, d)
        held = np.flatnonzero(n)
        rows = pa.array(total[held].tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(cids[held].astype(np.int32)), pa.array(n[held]), pa.array(far[held]), pa.array(away[held]), rows], names=["cid", "n", "far", "away", "total"])

    parts = vectors.select("embedding").mapInArrow(run, "cid int, n long, far double, away double, total array<double>")
    return _added(parts, "cid", far=F.max("far"), away=F.sum("away"))


def _added(parts: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """Sums by key of ``n`` and, component by component, of ``total``: one row for each task and key comes in."""
    one = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("total").alias("t"), *[c.alias(name) for name, c in more.items()])
    total = F.aggregate(F.slice("t", 2, F.size("t")), F.get("t", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return one.select(*keys, "n", *more, total.alias("total"))


def lloyd(vectors: DataFrame, centroids: DataFrame, rounds: int = 20, metric: str = "L2", tolerance: float = 1e-8, penalty: str | float | None = None) -> DataFrame:
    """Rounds of assignment and means from the given centroids; an empty cluster keeps its centroid.

    ``penalty``: ``None`` for plain k-means. ``"adaptive"`` adds ``weight * size in the round before`` to each
    distance, where weight is ``max(0, (largest - mean distance) / rows)`` in the largest cluster; ``"share"``
    adds the share of all rows that the cluster had; the first round has none, so a weight given by a caller
    would be inert. A number is a fixed weight. Assigning rows to the result has no penalty.
    """
    check_metric(metric)
    rows = sorted((r["cid"], r["centroid"]) for r in centroids.collect())
    if not rows:
        return centroids
    cids, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    if c.nbytes > CENTROID_BYTES:
        raise ValueError("the centroids are too large for rounds: cluster in levels")
    weight, cost = 0.0 if penalty is None or isinstance(penalty, str) else float(penalty), None
    for _ in range(rounds):
        new = {r["cid"]: r for r in _round(vectors, cids, c, cost, metric).collect()}  # one row for each centroid
        size = np.array([new[i]["n"] if i in new else 0 for i in cids.tolist()])
        if penalty == "adaptive" and size.any():
            largest = new[int(cids[size.argmax()])]
            weight = max(0.0, (largest["far"] - largest["away"] / largest["n"]) / size.sum())
        elif penalty == "share":
            weight = 1 / max(1, size.sum())
        cost = None if penalty is None else weight * size
        moved = np.array([np.array(new[i]["total"]) / new[i]["n"] if i in new else old for i, old in zip(cids.tolist(), c, strict=True)])
        if metric == "Cosine":
            length = np.linalg.norm(moved, axis=1, keepdims=True)
            moved = moved / np.where(length > 0, length, 1)
        change, c = ((moved - c) ** 2).sum(), moved
        if change < tolerance:
            break
    return centroid_table(vectors.sparkSession, list(zip(cids.tolist(), c.tolist(), strict=True)))


def balanced(vectors: DataFrame, k: int, rounds: int = 100, metric: str = "L2", fixed_weight: float | str | None = None) -> DataFrame:
    """Balanced k-means from the lowest ids; sizes of the round before keep each round parallel.

    ``fixed_weight``: a number, or ``"share"`` for one over the number of rows; unset, the weight adapts.
    """
    return lloyd(vectors, seeds(vectors, k), rounds, metric, 1e-3, "adaptive" if fixed_weight is None else fixed_weight)


def select_weight(vectors: DataFrame, k: int, weights: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), sample: int = 1000, rounds: int = 20, metric: str = "L2") -> float:
    """The fixed weight whose clusters of a sample are the most even (ratio of deviation to mean)."""
    part = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    best = []
    for w in weights:
        c = lloyd(part, seeds(part, k), rounds, metric, 1e-3, w)
        r = nearest_centroids(part, c, 1, metric).groupBy("cid").count().agg(F.stddev_pop("count") / F.avg("count")).first()[0]
        best.append((r, w))
    return min(best)[1]


def medoids(vectors: DataFrame, centroids: DataFrame, metric: str = "L2") -> DataFrame:
    """``(cid, vec_id, centroid)``: the nearest member of each centroid."""
    near = nearest_centroids(vectors, centroids, 1, metric)
    best = near.groupBy("cid").agg(F.min(F.struct("dist", "vec_id")).alias("b")).select("cid", "b.vec_id")
    return best.join(vectors, "vec_id").select("cid", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))


def mini_batch(vectors: DataFrame, k: int, samples: int = 1000, weight_factor: float = 100.0, rounds: int = 100, metric: str = "L2", seed: int = 0) -> DataFrame:
    """Balanced k-means on a seeded sample, its centres moved to their nearest members."""
    part = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(samples)
    n, scale = part.select(F.count("*"), F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) / F.size("embedding"))).first()
    c = lloyd(part, seeds(part, min(k, n)), rounds, metric, 1e-3, scale * scale / weight_factor / max(1, n))
    return medoids(vectors, c, metric)


def two_means(vectors: DataFrame, rounds: int = 3) -> DataFrame:
    """``(cid, vec_id, side)`` of ``(cid, vec_id, embedding)``: each posting split in two, from its two lowest ids.

    Rounds over all postings together, whatever their sizes: tasks add up the rows of each side, and the two
    centres of each posting are held in the driver. ``vectors`` are read once a round.
    """
    rows = vectors.select("cid", "vec_id", "embedding")
    lowest = sorted((r["cid"], r["n"], r["embedding"]) for r in ranked(rows, "cid", [F.col("vec_id")], 2, "n").collect())  # two rows a posting
    cids = np.array(sorted({r[0] for r in lowest}), np.int64)
    centres = np.zeros((2, len(cids), len(lowest[0][2]) if lowest else 0))
    if centres.nbytes > CENTROID_BYTES:
        raise ValueError("too many postings to split at once")
    for cid, n, v in lowest:
        centres[n - 1 :, np.searchsorted(cids, cid)] = v

    def sided(b: pa.RecordBatch, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, at = batch_matrix(b.column(2)), np.searchsorted(cids, b.column(0).to_numpy())
        side = ((x - c[1, at]) ** 2).sum(1) < ((x - c[0, at]) ** 2).sum(1)
        return x, at, side.astype(np.int32)

    for _ in range(rounds if len(cids) else 0):

        def add(batches, c=centres):
            n, total = np.zeros(c.shape[:2], np.int64), np.zeros(c.shape)
            for b in batches:
                x, at, side = sided(b, c)
                np.add.at(total, (side, at), x)
                np.add.at(n, (side, at), 1)
            side, at = np.nonzero(n)
            sums = pa.array(total[side, at].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[side, at]), sums], names=["side", "at", "n", "total"])

        new = centres.copy()
        for r in _added(rows.mapInArrow(add, "side int, at int, n long, total array<double>"), "side", "at").collect():
            new[r["side"], r["at"]] = np.array(r["total"]) / r["n"]
        centres = new

    def label(batches, c=centres):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sided(b, c)[2])], names=["cid", "vec_id", "side"])

    return rows.mapInArrow(label, "cid int, vec_id long, side int")


class KMeansClustering:
    """Plain k-means; ``target`` unset means one centroid for a hundred rows, ten at least."""

    def __init__(self, max_iters: int = 20, metric: str = "L2", seed: int | None = None):
        self.max_iters, self.metric, self.seed = max_iters, check_metric(metric), seed

    def cluster(self, vectors: DataFrame, target: int | None = None) -> DataFrame:
        n = vectors.count()
        k = min(n, target) if target else max(10, int(0.01 * n))
        start = seeds(vectors, k) if self.seed is None else plus_plus(vectors, k, self.metric, self.seed)
        return lloyd(vectors, start, self.max_iters, self.metric)

    def assign_with_replicas(self, vectors: DataFrame, centroids: DataFrame, r: int, limit: int, rng: bool = True) -> DataFrame:
        if rng:
            return assign.truncated(assign.rng_filtered(vectors, centroids, r, metric=self.metric), limit)
        near = assign.top_r(vectors, centroids, r, self.metric)
        if vectors.count() * r // max(1, centroids.count()) > limit:
            return assign.truncated(near, limit)
        return ranked(near, "cid", [F.col("dist"), F.col("vec_id")], 2**31 - 1, "pos")


class HierarchicalClustering:
    """Heads chosen from a tree over the vectors: centroids are vectors themselves."""

    def __init__(self, ratio: float = 0.01, kmeans_k: int = DEFAULTS["kmeans_k"], leaf_size: int = DEFAULTS["leaf_size"], metric: str = "L2", select_threshold: int = 0, split_threshold: int = 0, split_factor: int = 0, sample: int = 100_000):
        self.ratio, self.kmeans_k, self.leaf_size, self.metric, self.sample = ratio, kmeans_k, leaf_size, check_metric(metric), sample
        self.thresholds = (select_threshold, split_threshold, split_factor)

    def cluster(self, vectors: DataFrame, target: int | None = None) -> DataFrame:
        """Heads of every row's tree. Up to ``sample`` rows are one tree; more are dealt to cells about coarse
        centroids, and larger cells to parts, each with a tree of its own in a task."""
        import pandas as pd

        from vecspark.operators.tree import build_bkt, select_heads

        n = vectors.count()
        ratio = (target or max(1, round(self.ratio * n))) / max(1, n)
        rows = vectors.select("vec_id", "embedding")
        if n <= self.sample:
            cells = rows.withColumn("cid", F.lit(0)).withColumn("part", F.lit(0))
        else:
            few = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * self.sample / n))
            coarse = lloyd(few, seeds(few, -(-2 * n // self.sample)), 5, self.metric)
            near = nearest_centroids(rows, coarse, 1, self.metric).select("vec_id", "cid")
            sizes = {r["cid"]: r["n"] for r in near.groupBy("cid").agg(F.count("*").alias("n")).collect()}  # one row a cell
            parts = F.create_map(*[F.lit(v) for c, m in sizes.items() for v in (c, -(-m // self.sample))])
            cells = rows.join(near, "vec_id").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), parts[F.col("cid")]).cast("int"))
        kmeans_k, leaf_size, metric, thresholds = self.kmeans_k, self.leaf_size, self.metric, self.thresholds

        def heads(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("vec_id")
            x = np.array(pdf["embedding"].tolist(), np.float64)
            chosen = select_heads(build_bkt(x, kmeans_k, leaf_size, metric), len(x), max(ratio, 1 / len(x)), *thresholds)
            return pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[chosen], "centroid": [x[h].tolist() for h in chosen]})

        found = cells.groupBy("cid", "part").applyInPandas(heads, "vec_id long, centroid array<double>")
        # Numbered in one task: 8 bytes for each of the heads, a hundredth of the rows.
        number = found.select("vec_id").withColumn("cid", (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("int"))
        return found.join(number, "vec_id").select("cid", "centroid")

    def assign_with_replicas(self, vectors: DataFrame, centroids: DataFrame, r: int, limit: int, rng: bool = True) -> DataFrame:
        return assign.assign(vectors, centroids, r, limit, self.metric, rng)


def unit_centroids(centroids: DataFrame) -> DataFrame:
    return centroids.withColumn("centroid", normalize(F.col("centroid")))
