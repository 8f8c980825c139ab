"""``VectorIndex``: build, save, load, describe and search. Presets name the usual combinations of its settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.metrics import check_metric, of_dim
from vecspark.functions.params import automatic_posting_limit, cluster_count
from vecspark.operators import assign, clustering, evaluate, quantize
from vecspark.plans import search as plan

#: Postings are stored in so many folders, sorted by posting within; a search reads the folders of its probes.
BUCKETS = 64

#: Probed postings up to which row groups are chosen by them, too.
CHOSEN = 1000


def bucketed(df: DataFrame) -> DataFrame:
    """Rows with ``cid_bucket``, dealt by it and sorted by posting, as they are stored."""
    return df.withColumn("cid_bucket", F.pmod("cid", F.lit(BUCKETS)).cast("int")).repartition("cid_bucket").sortWithinPartitions("cid", "vec_id")


@dataclass(frozen=True)
class Config:
    dim: int
    metric: str = "L2"
    clustering: str = "kmeans"  # kmeans, hierarchical, balanced, seeds
    target_posting_size: int | None = None
    clusters: int | None = None
    replica_count: int = 8
    assignment: str = "rng"  # rng, top_r, closure
    closure_factor: float = 1.5
    rng_factor: float = 1.0
    posting_limit: int | str | None = None  # "auto": by the bytes of a vector and of a page
    balance: float | str | None = None  # weight of sizes in balanced k-means: unset, it adapts
    bits: int | None = None  # 1, 2, 4, 8, or none for no codes
    rerank: bool = True
    pruned: bool = False
    rounds: int = 20
    centroid_ratio: float = 0.01
    n_probe: int = 64
    max_check: int | None = 4096
    max_dist_ratio: float | None = None


#: Settings by the name of the index they stand for.
PRESETS: dict[str, dict] = {
    "memory": {"target_posting_size": 10000, "replica_count": 2, "assignment": "top_r", "rounds": 50, "n_probe": 20, "max_check": None},
    "disk": {"target_posting_size": 10000, "assignment": "closure", "rounds": 50, "n_probe": 20, "max_check": None, "pruned": True},
    "disk_quantised": {"target_posting_size": 10000, "replica_count": 8, "assignment": "top_r", "bits": 4, "rounds": 50, "n_probe": 64, "max_check": 4096},
    "flagship": {"clustering": "hierarchical", "replica_count": 8, "assignment": "rng", "posting_limit": "auto", "bits": 4, "n_probe": 32, "max_check": 4096, "max_dist_ratio": 10000.0},
    "exact": {"clustering": "balanced", "balance": "share", "replica_count": 1, "assignment": "top_r", "n_probe": 20, "max_check": None, "rounds": 100},
    "quantised": {"clustering": "balanced", "balance": "share", "replica_count": 1, "assignment": "top_r", "bits": 4, "rerank": False, "n_probe": 64, "max_check": 4096, "rounds": 100},
    "quantised_replicas": {"clustering": "balanced", "balance": "share", "replica_count": 8, "assignment": "top_r", "bits": 4, "n_probe": 64, "max_check": 4096, "rounds": 50},
}


def preset(name: str, dim: int, **changes) -> Config:
    return replace(Config(dim), **(PRESETS[name] | changes))


class VectorIndex:
    """Tables ``centroids(cid, centroid)``, ``postings(cid, vec_id, dist)``, ``codes`` (if quantised) and the ``vectors``."""

    def __init__(self, config: Config, vectors: DataFrame, centroids: DataFrame, postings: DataFrame, codes: DataFrame | None):
        self.config, self.vectors, self.centroids, self.postings, self.codes = config, vectors, centroids, postings, codes

    @classmethod
    def build(cls, vectors: DataFrame, config: Config, centroids: DataFrame | None = None) -> VectorIndex:
        """``vectors(vec_id, embedding)``. Given centroids are taken as they are."""
        c = config
        check_metric(c.metric)
        vectors = vectors.select("vec_id", of_dim(F.col("embedding"), c.dim).alias("embedding"))
        if centroids is None:
            size = c.target_posting_size or automatic_posting_limit(c.dim, c.bits is not None)
            k = c.clusters or cluster_count(vectors.count(), size)
            if c.clustering == "hierarchical":
                centroids = clustering.HierarchicalClustering(c.centroid_ratio, metric=c.metric).cluster(vectors, c.clusters)
            elif c.clustering == "balanced":
                centroids = clustering.balanced(vectors, k, c.rounds, c.metric, c.balance)
            else:
                start = clustering.seeds(vectors, k)
                centroids = start if c.clustering == "seeds" else clustering.lloyd(vectors, start, c.rounds, c.metric)
        if c.assignment == "rng":
            postings = assign.rng_filtered(vectors, centroids, c.replica_count, factor=c.rng_factor, metric=c.metric)
        elif c.assignment == "closure":
            postings = assign.closure(vectors, centroids, c.closure_factor, c.metric)
        else:
            postings = assign.top_r(vectors, centroids, c.replica_count, c.metric)
        postings = postings.select("cid", "vec_id", "dist")
        limit = automatic_posting_limit(c.dim, c.bits is not None) if c.posting_limit == "auto" else c.posting_limit
        if limit:
            postings = assign.truncated(postings, limit).select("cid", "vec_id", "dist")
        codes = None
        if c.bits:
            codes = quantize.encode(postings.join(vectors, "vec_id").select("cid", "vec_id", "embedding"), c.bits, c.metric)
        return cls(config, vectors, centroids, postings, codes)

    def save(self, path: str) -> None:
        """Parquet tables and the settings as JSON."""
        stored = lambda df, name: bucketed(df.drop("cid_bucket")).write.mode("overwrite").partitionBy("cid_bucket").parquet(f"{path}/{name}")
        self.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        stored(self.postings, "postings")
        if self.codes is not None:
            stored(self.codes, "codes")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        spark = self.vectors.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        config = Config(**json.loads(spark.read.text(f"{path}/config").first()[0]))
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(config, read("vectors"), read("centroids"), read("postings"), read("codes") if config.bits else None)

    def preload(self) -> VectorIndex:
        """The index with its postings and codes held by the executors after the first search."""
        codes = self.codes.persist() if self.codes is not None else None
        return VectorIndex(self.config, self.vectors, self.centroids, self.postings.persist(), codes)

    def _probed(self, table: DataFrame, probes: DataFrame) -> DataFrame:
        """Of a stored table, the folders (and row groups, if they are few) of the probed postings."""
        if "cid_bucket" not in table.columns:
            return table
        cids = [r[0] for r in probes.select("cid").distinct().collect()]  # at most one for each centroid
        table = table.filter(F.col("cid_bucket").isin(sorted({c % BUCKETS for c in cids})))
        return (table.filter(F.col("cid").isin(cids)) if len(cids) <= CHOSEN else table).drop("cid_bucket")

    def stats(self) -> DataFrame:
        """Vectors, clusters, sizes of postings, replication and bytes of centroids, in one row."""
        n = self.vectors.agg(F.count("*").alias("n_vectors"))
        b = evaluate.balance(self.postings).select("n_clusters", "size_min", "size_max", "size_avg", "size_std")
        total = self.postings.agg(F.count("*").alias("n_postings"))
        both = n.join(b).join(total)  # one row each
        return both.withColumn("replication", F.col("n_postings") / F.col("n_vectors")).withColumn("centroid_bytes", F.col("n_clusters") * self.config.dim * 4)

    def search(self, queries: DataFrame, k: int = 10, n_probe: int | None = None, max_check: int | None = None, max_dist_ratio: float | None = None, per_posting: int | None = None, rerank_top_n: int | None = None, early_stop_postings: int | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """``(qid, vec_id, rank, dist)`` of ``queries(qid, embedding)``; a single query is a table of one row.

        ``per_posting``: the first rows of each posting by id. ``deleted(vec_id)``: rows not to be found.
        """
        c = self.config
        probes = plan.probe(queries, self.centroids, n_probe or c.n_probe, c.metric, max_dist_ratio or c.max_dist_ratio)
        limit = lambda df: assign.first_come(df, per_posting).drop("pos") if per_posting else df
        gone = lambda df: df if deleted is None else df.join(deleted.select("vec_id"), "vec_id", "left_anti")
        if c.bits:
            found = gone(plan.scored_by_codes(probes, limit(self._probed(self.codes, probes)), c.bits, c.metric))
            if early_stop_postings:
                found = plan.early_stop(found, early_stop_postings, k)
            met = plan.first_met(found, max_check or c.max_check)
        else:
            postings = gone(limit(self._probed(self.postings, probes)))
            found = plan.nearest_met(probes, postings, self.vectors, max(k, rerank_top_n or 0), c.metric)
            met = plan.checked(found, k, max_check or c.max_check, early_stop_postings)
        if c.pruned:
            met = plan.pruned(met, k)
        if rerank_top_n:
            met = plan.ranked(met, "qid", [F.col("est"), F.col("vec_id")], rerank_top_n, "_n").drop("_n")
        return plan.rerank(met, queries, self.vectors, k, c.metric) if c.bits and c.rerank else plan.top_k(met, k)
