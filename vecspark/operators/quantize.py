"""Scalar quantisation of residuals, by posting, with distance estimates from codes.

``mu`` is the mean of a posting, ``r = x - mu``. One bit: ``b = (r > 0)`` and ``s = b - 1/2`` with factors for
an estimate. More bits: codes on the range of all residuals of the posting, estimates from what they decode to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from vecspark.functions.metrics import check_metric, distance, dot, numpy_rounded, subtract, total
from vecspark.operators.clustering import means
from vecspark.operators.knn import BLOCK_BYTES, EMPTY, batch_matrix, hold, matrix_blocks, ranked, rows_at_a_time, spread, within_reach


def posting_means(rows: DataFrame) -> DataFrame:
    """``(cid, mu)`` of ``(cid, embedding)`` rows."""
    return means(rows).select("cid", F.col("centroid").alias("mu"))


def residuals(rows: DataFrame) -> DataFrame:
    """``rows(cid, vec_id, embedding)`` with ``mu`` and ``r``."""
    mu = posting_means(rows).withColumnRenamed("cid", "_c")
    return rows.join(mu, F.col("cid") == F.col("_c")).drop("_c").withColumn("r", subtract(F.col("embedding"), F.col("mu")))


def one_bit(rows: DataFrame, metric: str = "L2", debias: bool = False) -> DataFrame:
    """``(cid, vec_id, code, mu, f_add, f_rescale, f_error)`` of each row.

    The documented factor holds a centroid term that the estimate subtracts once more; ``debias`` leaves it
    out, which ranks far better on data away from the origin.
    """
    check_metric(metric)
    df = residuals(rows).withColumn("code", F.transform("r", lambda x: (x > 0).cast("int")))
    s = F.transform("code", lambda b: b - F.lit(0.5))
    l2, irs, ics, s2 = dot(F.col("r"), F.col("r")), dot(F.col("r"), s), dot(F.col("mu"), s), dot(s, s)
    df = df.withColumn("_l2", l2).withColumn("_irs", irs).withColumn("_ics", F.lit(0.0) if debias else ics).withColumn("_s2", s2).withColumn("_rm", dot(F.col("r"), F.col("mu")))
    over = lambda c: F.when(F.col("_irs") == 0, F.lit(0.0)).otherwise(c / F.col("_irs"))
    if metric == "L2":
        add, scale = F.col("_l2") + over(2 * F.col("_l2") * F.col("_ics")), over(-2 * F.col("_l2"))
    else:
        add, scale = 1 - F.col("_rm") + over(F.col("_l2") * F.col("_ics")), over(-F.col("_l2"))
    spread = F.greatest(F.lit(0.0), over(over(F.col("_l2") * F.col("_s2"))) - 1)
    error = 2 * F.sqrt("_l2") * 1.9 * F.sqrt(spread / (F.size("r") - 1))
    return df.select("cid", "vec_id", "code", "mu", add.alias("f_add"), scale.alias("f_rescale"), error.alias("f_error"))


def multi_bit(rows: DataFrame, bits: int) -> DataFrame:
    """``(cid, vec_id, code, mu, lo, scale)``: codes 0..2^bits-1, rounded half to even; a zero range has scale 1."""
    if bits not in (2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    df = residuals(rows)
    top = (1 << bits) - 1
    span = df.groupBy(F.col("cid").alias("_c")).agg(F.min(F.array_min("r")).alias("lo"), F.max(F.array_max("r")).alias("hi"))
    df = df.join(span, F.col("cid") == F.col("_c")).withColumn("scale", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / top).otherwise(F.lit(1.0)))
    code = F.transform("r", lambda x: F.least(F.lit(top), F.greatest(F.lit(0), F.rint((x - F.col("lo")) / F.col("scale")).cast("int"))))
    return df.select("cid", "vec_id", code.alias("code"), "mu", "lo", "scale")


def delta(code: Column, r: Column, bits: int) -> Column:
    """Length of a residual along its code: ``|r| / |s| * cos(r, s)``."""
    s = F.transform(code, lambda b: b - F.lit(((1 << bits) - 1) / 2))
    return dot(r, s) / dot(s, s)


def estimate_one_bit(q: Column, metric: str = "L2") -> Column:
    """Estimated distance of a query to a row of ``one_bit``."""
    qr = subtract(q, F.col("mu"))
    ip = dot(F.col("code"), qr) - 0.5 * total(qr)
    g = dot(qr, qr) if metric == "L2" else -dot(q, F.col("mu"))
    est = F.col("f_add") + g + F.col("f_rescale") * ip
    return F.greatest(est, F.lit(0.0)) if metric == "L2" else est


def decoded() -> Column:
    """The vector that a row of ``multi_bit`` stands for."""
    return F.zip_with("code", "mu", lambda c, m: c * F.col("scale") + F.col("lo") + m)


def estimate_multi_bit(q: Column, metric: str = "L2") -> Column:
    return distance(metric, q, decoded())


def encode(rows: DataFrame, bits: int, metric: str = "L2", debias: bool = True) -> DataFrame:
    return one_bit(rows, metric, debias) if bits == 1 else multi_bit(rows, bits)


def estimate(bits: int, q: Column, metric: str = "L2") -> Column:
    return estimate_one_bit(q, metric) if bits == 1 else estimate_multi_bit(q, metric)


#: What an estimate reads of a code: by one bit, by more.
READ = {True: ("code", "mu", "f_add", "f_rescale"), False: ("code", "mu", "lo", "scale")}

#: Queries whose differences to a vector are at hand at a time (1 MB at 64 components), rows that leave a task at a time.
AT_HAND, ROWS_OUT = 2048, 1 << 19


#: No value is null, which spares each of the many rows its marks.
ESTIMATE = StructType([StructField("qid", LongType(), False), StructField("vec_id", LongType(), False), StructField("est", DoubleType(), False)])


def _by_posting(batches, one: bool) -> Iterator[tuple]:
    """``(ids, code, mu, *numbers)`` of each posting in each batch of ``cid, vec_id`` and what ``READ`` names; ``mu`` is one vector."""
    for b in batches:
        cid, ids, code, mu = b.column(0).to_numpy(), b.column(1).to_numpy(), batch_matrix(b.column(2)), batch_matrix(b.column(3))
        numbers = [b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
        for c in np.unique(cid):
            rows = np.flatnonzero(cid == c)
            yield ids[rows], code[rows], mu[rows[0]], *(v[rows] for v in numbers)


def _one_bit_estimates(q: np.ndarray, code: np.ndarray, mu: np.ndarray, add: np.ndarray, rescale: np.ndarray, metric: str) -> np.ndarray:
    """``estimate_one_bit`` of rows by queries, by one matrix product."""
    qr = q - mu
    est = code @ qr.T
    est -= 0.5 * qr.sum(1)
    est *= rescale[:, None]
    est += (qr * qr).sum(1) if metric == "L2" else -(q @ mu)
    est += add[:, None]
    return np.maximum(est, 0.0, out=est) if metric == "L2" else est


def _multi_bit_estimates(q: np.ndarray, code: np.ndarray, mu: np.ndarray, lo: np.ndarray, scale: np.ndarray, metric: str) -> np.ndarray:
    """``estimate_multi_bit`` of rows by queries; squares are summed directly, as a product of large vectors cancels."""
    x = code * scale[:, None] + lo[:, None] + mu
    if metric != "L2":
        return -(x @ q.T)
    est, held = np.empty((len(x), len(q))), np.empty((min(AT_HAND, len(q)), q.shape[1]))
    for i, v in enumerate(x):
        for s in range(0, len(q), AT_HAND):
            d = np.subtract(q[s : s + AT_HAND], v, out=held[: len(q[s : s + AT_HAND])])
            np.einsum("ij,ij->i", d, d, out=est[i, s : s + AT_HAND])
    return est


def _multi_bit_rounded(q: np.ndarray, code: np.ndarray, mu: np.ndarray, lo: np.ndarray, scale: np.ndarray, digits: int) -> np.ndarray:
    """``_multi_bit_estimates`` (L2), rounded: by a matrix product, and directly where its error could round another way."""
    r, qr = code * scale[:, None] + lo[:, None], q - mu
    x = r + mu
    est = r @ qr.T
    est *= -2
    est += (qr * qr).sum(1)
    est += (r * r).sum(1)[:, None]
    length = lambda v: np.sqrt((v * v).sum(-1)).max()
    off = 16 * np.finfo(np.float64).eps * (q.shape[1] + 4) * (length(q) + length(x) + 2 * length(mu)) ** 2 * 10.0**digits
    scaled = est * 10.0**digits
    scaled -= np.rint(scaled)
    at, near = np.nonzero(~(np.abs(scaled) < 0.5 - off))
    for s in range(0, len(at), 65536):
        a, b = at[s : s + 65536], near[s : s + 65536]
        d = q[b] - x[a]
        est[a, b] = np.einsum("ij,ij->i", d, d)
    return numpy_rounded(est, digits)


def estimates(codes: DataFrame, queries: DataFrame, bits: int, metric: str = "L2", digits: int | None = None, n: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(qid, vec_id, est)`` of every row of ``codes`` for each of ``queries(qid, embedding)``, rounded if ``digits`` are given.

    ``n``: rows of ``codes``, counted if unknown; they are dealt so that a task makes about as many estimates as another.
    """
    check_metric(metric)
    one, parts = bits == 1, []
    make = _one_bit_estimates if one else _multi_bit_estimates
    rows = codes.select("cid", F.col("vec_id").cast("long"), *READ[one])
    for qids, q in matrix_blocks(queries, "qid", "embedding", block_bytes):

        def run(batches, qids=qids, q=q):
            step = max(1, ROWS_OUT // len(q))
            for ids, code, mu, *numbers in _by_posting(batches, one):
                for s in range(0, len(ids), step):
                    part = slice(s, s + step)
                    read = q, code[part], mu, *(v[part] for v in numbers)
                    if digits is None:
                        est = make(*read, metric)
                    else:
                        est = _multi_bit_rounded(*read, digits) if metric == "L2" and not one else numpy_rounded(make(*read, metric), digits)
                    cols = [np.tile(qids, len(ids[part])), np.repeat(ids[part], len(q)), est.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "vec_id", "est"])

        n = rows.count() if n is None else n
        parts.append(spread(rows, n, len(q)).mapInArrow(run, ESTIMATE))
    if not parts:
        return codes.sparkSession.createDataFrame([], ESTIMATE)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def nearest_by_one_bit(codes: DataFrame, queries: DataFrame, k: int, n: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(qid, vec_id, rank, dist)``: the ``k`` first by one-bit estimates (L2), a row of several postings by its least.

    Each task gives at most ``k`` candidates a query.
    """
    in_order = lambda v: np.add.accumulate(v, 1)[:, -1]  # noqa: E731  # as expressions add, to the last bit
    parts = []
    rows = codes.select("cid", F.col("vec_id").cast("long"), *READ[True])
    for qids, q in matrix_blocks(queries, "qid", "embedding", block_bytes):

        def run(batches, qids=qids, q=q):
            best, held, everyone = np.full((len(q), k), np.nan), np.full((len(q), k), EMPTY), np.arange(len(q))
            for ids, code, mu, add, rescale in _by_posting(batches, True):
                qr = q - mu
                g, half, reach = in_order(qr * qr), 0.5 * in_order(qr), np.abs(qr).sum(1)
                step = rows_at_a_time(len(q))
                for s in range(0, len(ids), step):
                    part = slice(s, s + step)
                    own, c, f, r = ids[part], code[part], add[part], rescale[part]
                    # a matrix product only chooses, so that equal rows tie wherever they stand in it
                    d = np.ascontiguousarray(_one_bit_estimates(q, c, mu, f, r, "L2").T)
                    off = 16 * np.finfo(np.float64).eps * (q.shape[1] + 4) * (np.abs(f).max() + g + np.abs(r).max() * reach)
                    off[~np.isfinite(off)] = np.inf
                    d[~np.isfinite(d)] = np.inf
                    at, near = np.nonzero(within_reach(d, best[:, k - 1], off, k))
                    for t in range(0, len(at), 65536):
                        a, b = at[t : t + 65536], near[t : t + 65536]
                        est = f[b] + g[a] + r[b] * (in_order(c[b] * qr[a]) - half[a])
                        hold(best, held, (everyone,), a, np.maximum(est, 0.0), own[b])
            at, j = np.nonzero(held != EMPTY)
            for s in range(0, len(at), ROWS_OUT):
                a, b = at[s : s + ROWS_OUT], j[s : s + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(held[a, b]), pa.array(best[a, b])], names=["qid", "vec_id", "dist"])

        n = rows.count() if n is None else n
        parts.append(spread(rows, n, len(q)).mapInArrow(run, "qid long, vec_id long, dist double"))
    if not parts:
        return codes.sparkSession.createDataFrame([], "qid long, vec_id long, rank int, dist double")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    once = found.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
    return ranked(once, "qid", [F.col("dist"), F.col("vec_id")], k).select("qid", "vec_id", "rank", "dist")


def rotated(rows: DataFrame, queries: DataFrame, k: int, seed: int = 0, turn: np.ndarray | None = None) -> DataFrame:
    """``(qid, vec_id, rank, dist)`` by one-bit estimates of rotated residuals (L2); the rotation is random unless given."""
    first = rows.select("embedding").first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "qid long, vec_id long, rank int, dist double")
    dim = len(first[0])
    if turn is None:
        turn, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        turn = turn * np.sign(np.diag(r))

    @F.pandas_udf("array<double>")
    def spin(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(v.tolist(), np.float64).reshape(-1, dim) @ turn)) if len(v) else pd.Series([], dtype=object)

    codes = one_bit(rows.withColumn("embedding", spin("embedding")), "L2", debias=True)
    return nearest_by_one_bit(codes, queries.select("qid", spin("embedding").alias("embedding")), k, rows.count())


def best_rescale(magnitudes: np.ndarray, bits: int, steps: int = 200) -> float:
    """The factor by which magnitudes are scaled before rounding down, so that codes point most like them."""
    top = (1 << bits) - 1
    largest = float(magnitudes.max(initial=0.0))
    if largest == 0:
        return 1.0
    factors = np.unique(np.concatenate([(np.arange(1, top + 1)[:, None] / magnitudes[magnitudes > 0]).ravel(), np.linspace(0.3, 1, steps) * top / largest]))
    factors = factors[(factors > 0) & (factors <= (top + 1) / largest)]
    codes = np.minimum(np.floor(magnitudes[None, :] * factors[:, None] + 1e-5), top) + 0.5
    cosine = (codes * magnitudes).sum(1) / np.sqrt((codes * codes).sum(1))
    return float(factors[cosine.argmax()])
