import zlib

import numpy as np
import pytest

from vecspark.llm import quality_gam as G


def corpus(n=400):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{k}" for k in rng.integers(0, 300, rng.integers(5, 80))]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + "$$$" if bad else w for w in words), "x", 1.0, "c"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    docs += [(1000, None, "x", 1.0, None), (1001, "", "x", 1.0, None), (None, "some text", "x", 1.0, None), (1, docs[1][1], "x", 1.0, "c"), (1002, "long " * 20000, "x", 1.0, "c")]
    return docs, labels + [(None, 1, 0), (5, None, 0)]


SCHEMA = "doc_id long, text string, lang string, score double, f_words string"


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    got = G.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    good = {r[0]: r[1] for r in labels}
    right = [r["predicted"] == good[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in good]
    assert len(right) > 30 and np.mean(right) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    kept = G.accepted(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] for r in got)


def test_learns_from_rows_that_are_not_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    other = [(i, q if i is None or zlib.crc32(str(i).encode()) % 5 else 1 - (q or 0), t) for i, q, t in labels]
    a = G.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    b = G.classify(df, spark.createDataFrame(other, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = G.classify(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    assert G.classify(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_tree_1d_finds_the_cut():
    g = np.array([1.0, 1, 1, -1, -1])
    value = G.tree_1d(g, np.ones(5), 2, 0.0)
    assert value == pytest.approx([-1, -1, -1, 1, 1])


def test_columns_with_the_operators_names(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t, *_ in docs], "doc_id long, text string, _t string, _w string, `f_x.y` string, _score int")
    kept = G.accepted(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns and {(r["_t"], r["_w"], r["f_x.y"], r["_score"]) for r in kept.collect()} == {("a", "b", "c", 1)}


def test_very_many_rows_of_one_labelled_id(spark):
    df = spark.createDataFrame([(7, f"text {k}", "x") for k in range(500)] + [(8, "other", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = G.train(df, labels, max_rows=50)
    assert 0 < model.score(np.zeros((1, len(model.cuts))))[0] < 1
