"""Neighbourhood graphs over centroids: nearest-neighbour edges, thinned edges, greedy search."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.metrics import numpy_distance
from vecspark.operators.assign import kept_in_order, nearer
from vecspark.operators.knn import nearest_centroids, ranked


def knn_graph(centroids: DataFrame, k: int, metric: str = "L2") -> DataFrame:
    """``(src, dst, rank, dist)``: the ``k`` nearest other centroids."""
    near = nearest_centroids(centroids.withColumnRenamed("cid", "src"), centroids, k + 1, metric, "src", "centroid")
    return ranked(near.filter("src <> cid").drop("rank"), "src", [F.col("dist"), F.col("cid")], k).select("src", F.col("cid").alias("dst"), "rank", "dist")


def thinned(edges: DataFrame, centroids: DataFrame, most: int, factor: float = 1.0, metric: str = "L2") -> DataFrame:
    """Edges in order of distance; one is dropped if a kept neighbour is nearer to it than the source is."""
    c = centroids.select(F.col("cid").alias("_c"), F.col("centroid").alias("_v"))
    lists = edges.join(c, F.col("dst") == F.col("_c")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst", F.col("_v").alias("v")))).alias("near"))
    rule = lambda p, x: nearer(p, x, factor, metric)
    kept = lists.select("src", F.posexplode(kept_in_order(F.col("near"), rule, most)).alias("pos", "x"))
    return kept.select("src", F.col("x.dst").alias("dst"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.dist").alias("dist"))


def with_neighbour(edges: DataFrame, added: DataFrame, centroids: DataFrame, most: int, factor: float = 1.0, metric: str = "L2") -> DataFrame:
    """The graph with new ``(src, dst, dist)`` edges put in their order and thinned again."""
    all_ = edges.select("src", "dst", "dist").unionByName(added.select("src", "dst", "dist")).dropDuplicates(["src", "dst"])
    return thinned(all_, centroids, most, factor, metric)


def adjacency(edges: DataFrame, n: int) -> list[np.ndarray]:
    """Neighbours of each centroid, in order; edges are few as centroids are."""
    out: list[list[int]] = [[] for _ in range(n)]
    for r in edges.orderBy("src", "rank").toLocalIterator():
        out[r["src"]].append(r["dst"])
    return [np.array(v, int) for v in out]


def greedy(graph: list[np.ndarray], x: np.ndarray, q: np.ndarray, k: int, entry: int = 0, metric: str = "L2", max_check: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Nearest first from an entry point; the best of all that were met."""
    far = numpy_distance(metric)
    met = {entry: float(far(q[None, :], x[[entry]])[0, 0])}
    queue, checked = [(met[entry], entry)], 0
    while queue and checked < max_check:
        _, at = heapq.heappop(queue)
        checked += 1
        new = np.array([v for v in graph[at].tolist() if v not in met], int)
        if len(new):
            for v, d in zip(new.tolist(), far(q[None, :], x[new])[0].tolist(), strict=True):
                met[v] = d
                heapq.heappush(queue, (d, v))
    rows, d = np.array(list(met), int), np.array(list(met.values()))
    order = np.lexsort((rows, d))[:k]
    return rows[order], d[order]
