"""The registered queries over the smallest tables: against their SQL, or brute force where there is none."""

import os
import zlib

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tests.llm.test_mixing import brute as mixed  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402
from tests.llm.test_tokens import check_places, ids_of  # noqa: E402
from vecspark.llm import mixing  # noqa: E402
from vecspark.llm.queries import LEVELS, ORACLE_SQL, QUERIES, WEIGHTS  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_the_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, DIR).toPandas()
    key = lambda x: sorted((tuple(None if v is None or v != v else v for v in r) for r in x[sorted(x.columns)].itertuples(index=False)), key=str)
    assert sorted(got.columns) == sorted(want.columns) and key(got.astype(object)) == key(want.astype(object))


def test_op1(spark, docs):
    want = [(i, len((t or "").encode()), n := len(ids_of(BYTES, t)), n > 512) for i, t, *_ in docs]
    assert rows(QUERIES["op1_token_counts"](spark, DIR), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_op2(spark, docs):
    got = QUERIES["op2_best_fit_packing"](spark, DIR)
    want = []
    for i, t, *_ in docs:
        own = np.array(ids_of(WORDS, t) + [1], "<u4")
        want += [(i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes())) for k in range(0, len(own), 4096)]
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    assert check_places(rows(got, "sequence_id", "offset", "length"), 4096) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_op5(spark):
    held = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r["embedding"] is not None}
    got, hits, total = QUERIES["op5_adaptive_scan"](spark, DIR).collect(), 0, 0
    for q in (i for i in held if i % 50 == 0):
        cos = {i: float(v @ held[q] / np.sqrt((v @ v) * (held[q] @ held[q]))) for i, v in held.items() if i != q}
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r["score"] - cos[r["vec_id"]]) < 1e-12 for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(sorted(cos, key=lambda i: (-cos[i], i))[:5])), total + 5
    assert hits >= 0.9 * total and len(got) == total


def test_op6(spark, docs):
    got = QUERIES["op6_quality_gam"](spark, DIR).collect()
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in docs)
    right = [r["predicted"] == good[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in good]
    assert np.mean(right) >= 0.8


def test_op8(spark, docs):
    fps = {i: plain_fingerprint(t, 4) for i, t, *_ in docs}
    comp = plain_components(set(fps.values()), 4)
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(comp[f], i)
    assert rows(QUERIES["op8_simhash"](spark, DIR), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", least[comp[f]]) for i, f in fps.items()), key=str)


def test_op9(spark, docs):
    want, start = [], 0
    for i, t, *_ in sorted(docs):
        own = np.array(ids_of(BYTES, t) + [2], "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert rows(QUERIES["op9_token_files"](spark, DIR), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op10(spark, docs):
    leaf = [(i, f"domain{zlib.crc32((s or '').encode()) % 4}", g, s, len(ids_of(BYTES, t)), 0) for i, t, g, s in docs]
    assert rows(QUERIES["op10_mixing"](spark, DIR), "doc_id", "epoch") == mixed(leaf, mixing.weights(WEIGHTS, LEVELS), 1.0, 2, 11)
