"""Approximate nearest neighbours by cosine: probed lists with an adaptive scan over dimensions.

Unit vectors are rotated at random, so any leading dimensions are a fair sample of a distance. Within a
probed list, distances are summed over blocks of columns; after each block a hypothesis test drops the
candidates whose partial distance is too large for them to be among the nearest. What is left is scored
exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace

#: Columns that are added to the distances at a time.
COLUMNS = 16

#: Numbers of a matrix that are at hand at a time, in the driver and in tasks (32 MB).
VALUES = 1 << 22


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def nearest_lists(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The list of each row, in blocks of rows that hold about 32 MB of products."""
    block = max(1, VALUES // len(c))
    return np.concatenate([np.zeros(0, np.int64), *[(x[k : k + block] @ c.T).argmax(1) for k in range(0, len(x), block)]])


def centroids(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means over unit vectors; an empty list keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    for _ in range(rounds):
        at = nearest_lists(x, c)
        order = np.argsort(at, kind="stable")
        held, begin = np.unique(at[order], return_index=True)
        total = np.add.reduceat(x[order], begin, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[held] = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c[held])
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, tests: int, seed: int) -> int:
    """How many lists have to be probed for ``recall``: measured for ``tests`` rows of the sample against all of it.

    The lists of the true neighbours are ranked as a search would visit them; the answer is the least
    number of visits that meets the wanted share of them.
    """
    own = np.random.default_rng(seed).choice(len(x), min(tests, len(x)), replace=False)
    at, ranks = nearest_lists(x, c), []
    for i in own.tolist():
        near = x @ x[i]
        near[i] = -np.inf
        true = np.argpartition(-near, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, np.int64)
        place = np.empty(len(c), np.int64)
        place[np.argsort(-(c @ x[i]), kind="stable")] = np.arange(len(c))
        ranks.append(place[at[true]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def tasks_of(c: np.ndarray, count: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(task, parts)`` of each list: lists near each other share a task of about ``block`` rows; a longer list is dealt to parts."""
    parts = np.maximum(1, -(-count // block))
    coarse = nearest_lists(c, centroids(c, max(1, int(len(c) ** 0.5)), 5, seed))
    order = np.argsort(coarse, kind="stable")
    task = np.empty(len(c), np.int64)
    task[order] = np.cumsum(np.where(parts > 1, 0, count)[order]) // block * 2
    task[parts > 1] = np.flatnonzero(parts > 1) * 2 + 1
    return task, parts


def scan(x: np.ndarray, q: np.ndarray, keep: int, doubt: float, order: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``x`` that may be among the ``keep`` nearest to ``q`` (both rotated unit vectors).

    Rows are taken in tiles, in the given order (best lists first) or as they are. The bound is the ``keep``-th least full distance so far; after ``d`` of ``D``
    columns a row goes if ``partial * D / d > bound * (1 + doubt / sqrt(d)) ** 2``.
    """
    dim, found, at, bound = x.shape[1], [], [], np.inf
    order = np.arange(len(x)) if order is None else order
    for begin in range(0, len(order), 1024):
        rows = order[begin : begin + 1024]
        partial = np.zeros(len(rows))
        for d in range(0, dim, COLUMNS):
            part = x[rows, d : d + COLUMNS] - q[d : d + COLUMNS]
            partial += np.einsum("ij,ij->i", part, part)
            done = min(d + COLUMNS, dim)
            if done < dim and np.isfinite(bound):
                near = partial * (dim / done) <= bound * (1 + doubt / np.sqrt(done)) ** 2 + 1e-9
                rows, partial = rows[near], partial[near]
                if not len(rows):
                    break
        at.append(rows)
        found.append(partial)
        best = np.concatenate(found)
        if len(best) > keep:
            bound = np.partition(best, keep - 1)[keep - 1]
            near = best <= bound * (1 + 1e-6) + 1e-9  # rounding must not part ties
            at, found = [np.concatenate(at)[near]], [best[near]]
    return np.concatenate(at) if at else np.zeros(0, np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components present and finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that squares of very large or small numbers stay finite and over zero."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed alike wherever a row stands (a matrix product's rounding depends on it)."""
    return (np.ascontiguousarray(x) * w).sum(1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, list_size: int = 64, max_lists: int = 4096, recall: float = 0.96, min_probes: int = 8, doubt: float = 3.0, sample: int = 50_000, block: int | None = None, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row where ``is_query`` holds.

    Fitted on a random sample of at most about ``sample`` vectors (and 32 MB of numbers), every row
    indexed. There is a list for ``list_size`` rows, at most ``max_lists``; how many lists a query probes is
    measured on the sample so that they hold ``recall`` of the true neighbours (``min_probes`` at least, and
    more until these hold ``k`` candidates). Ties go to the smaller id. A row is no candidate of itself;
    other rows that share its id are.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part; nor do null ids. Fewer than ``k`` other rows: all of them. Other columns are not carried, whatever
    their names. Empty table: empty result.

    Lists near each other are grouped to tasks of about ``block`` rows (unset: 512 to 16,384, by the number
    of rows), longer ones dealt to several tasks, and queries beyond 50,000 meet them in parts; a task returns
    ``k`` rows for a query at most. These numbers only set how work is dealt.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "adaptivescan")
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("q").alias("asked")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, total, asked_rows = sizes[0]["n"], sizes[0]["rows"], sizes[0]["asked"]
    rows = rows.filter(F.size("v") == dim)

    def matrix(column) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))

    most = max(k + 1, min(sample, VALUES // dim))
    taste = rows if total <= most else rows.filter(F.rand(seed) < most / total)
    x = unit(matrix(taste.select("v").toArrow().column(0)))  # about ``most`` rows
    if not len(x):
        x = unit(matrix(rows.limit(most).select("v").toArrow().column(0)))
    lists = int(max(1, min(max_lists, total // list_size, len(x))))
    turn, centre = rotation(dim, seed), centroids(x, lists, 12, seed)
    probes = min(lists, max(min_probes, probes_for(x, centre, k, recall, 400, seed)))
    del x

    def place(batches):
        for b in batches:
            near = nearest_lists(unit(matrix(pa.chunked_array([b.column(1)]))), centre).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near, pa.int32())], names=["id", "v", "q", "list"])

    index = work.stage(rows.mapInArrow(place, f"id long, v array<{kind}>, q boolean, list int").withColumn("row", F.monotonically_increasing_id()), "index")
    count = np.zeros(lists, np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most ``max_lists`` rows
        count[r["list"]] = r["n"]
    block = block or int(min(1 << 14, max(512, total // 32)))
    task, parts = tasks_of(centre, count, block, seed)
    shares = max(1, -(-asked_rows // 50_000))

    def route(batches):
        step = max(1, VALUES // 4 // lists)
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                order = np.argsort(-(unit(matrix(pa.chunked_array([b.column(1)]))) @ centre.T), axis=1, kind="stable")
                need = np.maximum(probes, (np.cumsum(count[order], axis=1) < k + 1).sum(1) + 1)
                at, to, part, which = [], [], [], []
                for i, n in enumerate(need.tolist()):
                    own = order[i, :n]
                    own = own[np.argsort(task[own], kind="stable")]  # nearest list first within each task
                    for cs in np.split(own, np.flatnonzero(np.diff(task[own])) + 1):
                        for p in range(parts[cs[0]]):
                            at.append(i)
                            to.append(task[cs[0]])
                            part.append(p)
                            which.append(cs)
                picked = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), b.column(2).take(picked), pa.array(to, pa.int64()), pa.array(part, pa.int32()), pa.array(which, pa.list_(pa.int32()))], names=["id", "v", "row", "task", "part", "lists"])

    share = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shares)).cast("int")
    asked = index.filter("q").select("id", "v", "row").mapInArrow(route, f"id long, v array<{kind}>, row long, task long, part int, lists array<int>").withColumn("share", share)
    tasks, several = F.array(*[F.lit(int(g)) for g in task]), F.array(*[F.lit(int(b)) for b in parts])
    part = F.pmod(F.xxhash64("row"), F.get(several, F.col("list"))).cast("int")
    held = index.select("id", "v", "list", "row", F.get(tasks, F.col("list")).cast("long").alias("task"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def nearest(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "row": "int64", "vec_id": "int64"})
        own = own.sort_values("list", kind="stable")
        ids, place_of, of = own["id"].to_numpy(), own["row"].to_numpy(), own["list"].to_numpy()
        v, w = scaled(np.array(own["v"].tolist(), np.float64)), scaled(np.array(queries["v"].tolist(), np.float64))
        u, turned = unit(v) @ turn, unit(w) @ turn
        norm, wide = np.sqrt(products(v, v)), np.sqrt(products(w, w))
        found = []
        for i, (name, row, wanted) in enumerate(zip(queries["id"].tolist(), queries["row"].tolist(), queries["lists"], strict=True)):
            spans = zip(np.searchsorted(of, wanted, "left").tolist(), np.searchsorted(of, wanted, "right").tolist(), strict=True)
            rows = scan(u, turned[i], k + 1, doubt, np.concatenate([np.arange(a, b) for a, b in spans]))
            rows = rows[place_of[rows] != row]
            score = products(v[rows], w[i]) / (norm[rows] * wide[i])
            best = np.lexsort((ids[rows], -score))[:k]
            found.append((np.full(len(best), name), np.full(len(best), row), ids[rows][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "row", "vec_id", "score"), cols, strict=True)))

    keys = ("task", "part", "share")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(nearest, "query_id long, row long, vec_id long, score double")
    first = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
