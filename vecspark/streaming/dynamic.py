"""Updates in batches: version labels, posting sizes, inserts, deletes, splits and reassignment.

Every operation takes tables and returns new ones, so a micro-batch of a stream (``foreachBatch``) or a
batch job applies them alike. A batch checks for splits once at its end. A split retires its posting id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.metrics import squared_l2
from vecspark.operators.assign import nearest
from vecspark.operators.clustering import means, two_means
from vecspark.operators.knn import nearest_centroids

DELETED, VERSION = 128, 127


def is_deleted(label: Column) -> Column:
    return F.coalesce(label.bitwiseAND(DELETED), F.lit(0)) != 0


def version(label: Column) -> Column:
    return F.coalesce(label.bitwiseAND(VERSION), F.lit(0))


def deleted(label: Column) -> Column:
    return F.coalesce(label, F.lit(0)).bitwiseOR(DELETED)


def undeleted(label: Column) -> Column:
    return label.bitwiseAND(VERSION)


def bumped(label: Column) -> Column:
    """The next version modulo 128; the deleted bit stays; a missing label becomes version 1."""
    old = F.coalesce(label, F.lit(0))
    return old.bitwiseAND(DELETED).bitwiseOR((old + 1).bitwiseAND(VERSION))


def with_version(label: Column, v: Column) -> Column:
    return F.coalesce(label, F.lit(0)).bitwiseAND(DELETED).bitwiseOR(v.bitwiseAND(VERSION))


def label_counts(labels: DataFrame) -> DataFrame:
    gone = is_deleted(F.col("label"))
    return labels.agg(F.count("*").alias("n_total"), F.count_if(gone).alias("n_deleted"), F.count_if(~gone).alias("n_active"))


def posting_sizes(postings: DataFrame, target: int, centroids: DataFrame | None = None) -> DataFrame:
    """``(cid, n, need_split, need_merge)``: over twice the target, under half of it; with ``centroids`` also postings without rows."""
    n = postings.groupBy("cid").agg(F.count("*").alias("n"))
    if centroids is not None:
        n = centroids.select("cid").join(n, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("need_split", F.col("n") > 2 * target).withColumn("need_merge", F.col("n") < int(0.5 * target))


def updated_sizes(sizes: DataFrame, changes: DataFrame) -> DataFrame:
    """Sizes ``(cid, n)`` after ``changes(cid, delta)``, any number of them for a posting."""
    both = sizes.select("cid", "n").unionByName(changes.select("cid", F.col("delta").alias("n")))
    return both.groupBy("cid").agg(F.sum("n").alias("n"))


def size_totals(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("n_postings"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("size_avg"))


def insert(centroids: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Postings rows of new vectors, each in its nearest centroid's."""
    return nearest(arrivals, centroids).select("cid", "vec_id", "dist")


def live(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings without deleted vectors."""
    return postings.join(labels.filter(is_deleted(F.col("label"))).select("vec_id"), "vec_id", "left_anti")


def delete(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels with the deleted bit of ``ids(vec_id)`` set; deleting again changes nothing."""
    gone = ids.select("vec_id").distinct().withColumn("_gone", F.lit(True))
    both = labels.join(gone, "vec_id", "full")
    return both.select("vec_id", F.when(F.col("_gone"), deleted(F.col("label"))).otherwise(F.col("label")).cast("int").alias("label"))


def split(centroids: DataFrame, assigned: DataFrame, vectors: DataFrame, target: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(new centroids (old, cid, centroid), moved (old, cid, vec_id))`` of the postings over twice the target.

    New ids follow the largest old one, two for each split posting in the order of its id.
    """
    over = posting_sizes(assigned, target).filter("need_split").select("cid")
    rows = assigned.join(over, "cid", "left_semi").select("cid", "vec_id").join(vectors, "vec_id")
    sides = two_means(rows, rounds)
    top = centroids.agg(F.max("cid")).first()[0]
    old = [r["cid"] for r in over.orderBy("cid").collect()]  # postings over the limit of one batch
    numbers = assigned.sparkSession.createDataFrame([(c, top + 1 + 2 * i) for i, c in enumerate(old)], "old int, base int")
    moved = sides.join(numbers, F.col("cid") == F.col("old")).select("old", (F.col("base") + F.col("side")).alias("cid"), "vec_id")
    new = means(moved.join(vectors, "vec_id").select("cid", "embedding")).select("cid", "centroid")
    names = moved.select("old", "cid").distinct()
    return new.join(names, "cid").select("old", "cid", "centroid"), moved


def reassign(centroids: DataFrame, new: DataFrame, assigned: DataFrame, vectors: DataFrame, k: int = 64) -> DataFrame:
    """``(vec_id, from_cid, to_cid)`` of vectors that a split moves.

    ``centroids`` hold the new ones and not the retired, ``assigned(cid, vec_id)`` the state after the split;
    ``new(old, cid, centroid, old_centroid)``. A vector of a split posting moves if it was no farther from the
    old centroid than from its new one, and another is nearest. A vector of the ``k`` postings nearest to an
    old centroid moves if a new centroid is no farther than its own, and is the nearest of all.
    """
    best = nearest_centroids(vectors, centroids, 1).select("vec_id", F.col("cid").alias("to_cid"))
    state = assigned.join(vectors, "vec_id").join(best, "vec_id")
    own = new.select(F.col("cid").alias("nc"), F.col("centroid").alias("nv"), "old_centroid")
    one = state.join(own, F.col("cid") == F.col("nc"))
    one = one.filter((squared_l2(F.col("embedding"), F.col("old_centroid")) <= squared_l2(F.col("embedding"), F.col("nv"))) & (F.col("to_cid") != F.col("cid")))
    olds = new.select(F.col("old").alias("cid"), F.col("old_centroid").alias("centroid")).dropDuplicates(["cid"])
    near = nearest_centroids(olds.withColumnRenamed("cid", "old"), centroids, k, "L2", "old", "centroid").select("cid").distinct()
    fresh = new.select(F.col("cid").alias("nc"))
    near = near.join(fresh, F.col("cid") == F.col("nc"), "left_anti")
    mine = centroids.select(F.col("cid").alias("mc"), F.col("centroid").alias("mv"))
    two = state.join(near, "cid", "left_semi").join(mine, F.col("cid") == F.col("mc")).join(own, F.col("to_cid") == F.col("nc"))
    two = two.filter(squared_l2(F.col("embedding"), F.col("nv")) <= squared_l2(F.col("embedding"), F.col("mv")))
    pick = lambda df: df.select("vec_id", F.col("cid").alias("from_cid"), "to_cid")
    return pick(one).union(pick(two)).distinct()


def moved(assigned: DataFrame, moves: DataFrame) -> DataFrame:
    """Assignments after the moves; the row leaves its old posting."""
    return assigned.join(moves.select("vec_id", "to_cid"), "vec_id", "left").select(F.coalesce("to_cid", "cid").alias("cid"), "vec_id")


def apply_operations(labels: DataFrame, operations: DataFrame) -> DataFrame:
    """Labels after a batch of ``(op_seq, vec_id, op)`` with ``op`` insert or delete, in the order of ``op_seq``.

    Only the last operation of an id decides whether it is deleted; each insert makes a new version.
    """
    last = operations.groupBy("vec_id").agg(F.max_by("op", "op_seq").alias("last"), F.count_if(F.col("op") == "insert").cast("int").alias("n"))
    both = labels.join(last, "vec_id", "full")
    old = F.coalesce("label", F.lit(0))
    v = (old.bitwiseAND(VERSION) + F.coalesce("n", F.lit(0))).bitwiseAND(VERSION)
    gone = F.when(F.col("last").isNull(), old.bitwiseAND(DELETED)).when(F.col("last") == "delete", DELETED).otherwise(0)
    return both.select("vec_id", v.bitwiseOR(gone).cast("int").alias("label"))


def stream_updates(operations: DataFrame, on_batch, checkpoint: str):
    """Runs ``on_batch(batch, number)`` for every micro-batch of a stream of operations (exactly once by its number)."""
    return operations.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
