"""Distances and vector functions as Column expressions. Smaller is nearer for every metric.

``L2`` is the squared Euclidean distance, ``IP`` the negative inner product, and ``Cosine`` the same
expression as ``IP`` (callers normalise first). All arithmetic is in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("L2", "IP", "Cosine")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return metric


def total(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(metric: str, a: Column, b: Column) -> Column:
    return squared_l2(a, b) if check_metric(metric) == "L2" else -dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def of_dim(a: Column, dim: int) -> Column:
    """The vector, or an error if it has another length."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")))


def rounded(value: Column, digits: int = 6) -> Column:
    """For comparing results: rounded, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def numpy_rounded(values, digits: int = 6):
    """As ``rounded``, of an array."""
    scaled = values * 10.0**digits
    near = np.rint(scaled)
    half = np.abs(scaled - near) == 0.5  # these go away from zero
    if half.any():
        near[half] = np.trunc(scaled[half]) + np.sign(scaled[half])
    near /= 10.0**digits
    lost = ~np.isfinite(near)
    if lost.any():
        near[lost] = values[lost]
    return near + 0.0


def numpy_distance(metric: str) -> Callable:
    """``f(x, c)``: distances of every row of ``x`` to every row of ``c``, by one matrix product."""
    check_metric(metric)

    def f(x, c):
        p = x @ c.T
        return (x * x).sum(1)[:, None] - 2 * p + (c * c).sum(1)[None, :] if metric == "L2" else -p

    return f


def numpy_pairs(metric: str) -> Callable:
    """``f(x, c)``: distances of row pairs, summed directly."""
    check_metric(metric)
    return (lambda x, c: ((x - c) ** 2).sum(-1)) if metric == "L2" else (lambda x, c: -(x * c).sum(-1))
