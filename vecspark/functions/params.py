"""Sizing of postings and the default settings. Plain arithmetic."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 4096
#: Bytes of an id beside each stored vector.
ID_BYTES = 4
#: Default settings (fixed values).
DEFAULTS = {
    "replica_count": 8, "posting_page_limit": 3, "posting_vector_limit": 118, "rng_factor": 1.0,
    "internal_result_num": 64, "max_check": 4096, "max_dist_ratio": 10000.0, "centroid_ratio": 0.01,
    "select_threshold": 6, "split_threshold": 25, "split_factor": 5, "kmeans_k": 32, "leaf_size": 8,
}


def posting_page_limit(vectors: int, dim: int, value_size: float = 4) -> int:
    """Pages that hold so many vectors with their ids."""
    return ceil(vectors * (dim * value_size + ID_BYTES) / PAGE)


def posting_size_limit(pages: int, dim: int, value_size: float = 4) -> int:
    """Vectors that fit in so many pages."""
    return int(pages * PAGE / (dim * value_size + ID_BYTES))


def posting_limit(dim: int, value_size: float = 4, vectors: int = 118, pages: int = 3) -> int:
    """Vectors of a posting: as many as fill the larger of the two limits."""
    return posting_size_limit(max(pages, posting_page_limit(vectors, dim, value_size)), dim, value_size)


def automatic_posting_limit(dim: int, quantised: bool, vectors: int = 118, pages: int = 3) -> int:
    """The limit with the bytes that a component takes: a quarter when quantised, whatever the bits."""
    return posting_limit(dim, ((dim + 3) // 4) / dim if quantised else 4, vectors, pages)


def cluster_count(rows: int, posting_size: int) -> int:
    return max(1, rows // posting_size)


def posting_limit_column(dim: Column, value_size: Column, vectors: int = 118, pages: int = 3) -> Column:
    """``posting_limit`` as an expression."""
    row = dim * value_size + ID_BYTES
    need = F.greatest(F.lit(pages), F.ceil(F.lit(vectors) * row / PAGE))
    return F.floor(need * PAGE / row).cast("int")
