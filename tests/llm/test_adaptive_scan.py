import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import adaptive_scan as A


def exact(rows, k, every):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            s = [(-float(x[q] @ v / (np.sqrt(x[q] @ x[q]) * np.sqrt(v @ v))), i) for i, v in x.items() if i != q]
            out[q] = sorted(s)[:k]
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((20, 64)) * 1.5
    rows = [(i, (centre[i % 20] + rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in A.search(df, F.col("vec_id") % 50 == 0, k=5, block=100).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = exact(rows, 5, 50)
    assert set(got) == set(want)
    x = dict(rows)
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        for r in rs:
            a, b = np.array(x[q], np.float64), np.array(x[r["vec_id"]], np.float64)
            assert abs(r["score"] - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
        hits += len({r["vec_id"] for r in rs} & {i for _, i in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_odd_vectors_ties_and_few_rows(spark):
    v = [0.5, 1.0, 0.0, 2.0]
    rows = [(0, v), (3, v), (2, [2 * a for a in v]), (7, [-1.0, 0.0, 1.0, 0.0]), (50, None), (100, [0.0] * 4), (150, [1.0, None, 0.0, 0.0]), (200, [float("nan"), 1.0, 0.0, 0.0]), (250, [float("inf"), 1.0, 0.0, 0.0]), (300, [1.0]), (None, v), (350, [])]
    df = spark.createDataFrame([(i, e, "x", 1.0) for i, e in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = sorted(map(tuple, A.search(df, F.col("vec_id") % 50 == 0, k=5).collect()))
    assert [g[:3] for g in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 7)]
    assert A.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_many_equal_vectors_come_in_the_order_of_their_ids(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 7))
    rows = [(int(i), base[rng.integers(60)].tolist()) for i in rng.permutation(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for block in (None, 37):
        got = {}
        for r in A.search(df, F.col("vec_id") % 50 == 0, k=5, block=block).collect():
            got.setdefault(r["query_id"], []).append(r)
        x = dict(rows)
        for q, rs in got.items():
            rs.sort(key=lambda r: r["rank"])
            equal = sorted(i for i, v in x.items() if v == x[q] and i != q)[:5]
            assert len(equal) == 5 and [r["vec_id"] for r in rs] == equal
            assert len({r["score"] for r in rs}) == 1


def test_products_do_not_depend_on_the_place_of_a_row():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 64, 101):
        x = np.repeat(rng.standard_normal((1, 67)), n, axis=0)
        assert len(set(A.products(x, rng.standard_normal(67)).tolist())) == 1


def test_very_large_and_small_numbers(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1e200, 1e199]), (3, [-1e-300, -1e-300])]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1, 3]
    assert abs(got[0]["score"]) <= 1 + 1e-12


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1", "check_s"])
def test_recall_on_the_given_tables(spark, table):
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    df = spark.read.parquet(path)
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect() if r["embedding"] is not None]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in A.search(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        true = set(ids[np.argsort(-near)[:5]].tolist())
        hits, total = hits + len(true & got[ids[i]]), total + len(true)
    assert hits / total >= 0.9


def test_repeated_rows_are_candidates_of_each_other(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in A.search(df, F.col("vec_id") == 0, k=5).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (2, 1)]


def test_scan_keeps_the_nearest_with_much_doubt():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(20):
        rows = A.scan(x, x[k], 6, doubt=50.0)
        near = np.argsort(((x - x[k]) ** 2).sum(1))[:6]
        assert set(near) <= set(rows)
        assert len(A.scan(x, x[k], 6, doubt=2.1)) < 5000
