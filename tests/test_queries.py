"""Every query of the catalogue against its SQL on an independent engine, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from vecspark.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    asked = duckdb.sql(f"SELECT vec_id FROM '{DIR}/embeddings.parquet' WHERE vec_id % 20 = 0").fetchall()
    got = __spark_entry__.entry(spark).collect()
    assert sorted((r["qid"], r["rank"]) for r in got) == sorted((q, k) for (q,) in asked for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
