import pytest
from pyspark.sql import functions as F

from vecspark.llm import queries
from vecspark.llm.shared import Workspace
from vecspark.llm.sharding import Conflict, Shard, ShardStore, tiers


@pytest.fixture
def store(spark):
    return ShardStore(spark, f"{Workspace(spark, 'test').path}/store")


def test_append_compact_read(spark, store):
    want = []
    for k in range(5):
        rows = [(k * 100 + i, None if i % 7 == 0 else f"text {i} " * (50 if i % 11 else 5000), "b", 1) for i in range(40)] + [(None, "", None, None)]
        want += rows
        assert store.append(spark.createDataFrame(rows, "doc_id long, text string, path string, bytes int").repartition(3)) == k + 1
    before = store.shards()
    assert len(before) == 15
    last = store.compact(target=1 << 20)
    assert last > 5 and len(store.shards()) < 5
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(store.read()) == sorted(want, key=str)
    assert key(store.read(version=5)) == sorted(want, key=str)  # older versions stay readable
    assert len(store.read(version=1).collect()) == 41
    assert store.vacuum() == 0  # all files are young
    assert store.vacuum(grace_s=0) == 15
    assert key(store.read()) == sorted(want, key=str)
    assert store.compact(target=1 << 20) == last


def test_a_version_is_committed_once(spark, store):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    store.append(df)
    with pytest.raises(Conflict):
        store.commit([], df.schema, 0)
    assert store.version() == 1 and len(store.read().collect()) == 1


def test_files_without_a_manifest_are_not_seen(spark, store):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    store.append(df)
    store._write(df)  # a writer that was lost before its commit
    assert store.read().count() == 1
    assert store.vacuum(grace_s=0) == 1


def test_empty_store_and_empty_arrival(spark, store):
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.compact() >= 1
    assert store.read().collect() == []


def test_runs_are_of_similar_size():
    shards = [Shard(str(k), b) for k, b in enumerate([10, 11, 12, 13, 500, 510, 520, 9000, 30, 35])]
    runs = tiers(shards, target=1000, ratio=4, least=4)
    assert [sorted(s.bytes for s in r) for r in runs] == [[10, 11, 12, 13, 30, 35]]


def texts(spark, n, word="x"):
    return spark.createDataFrame([(i, word) for i in range(n)], "doc_id long, text string").coalesce(1)


def test_two_compactors_keep_every_row_once(spark, store, monkeypatch):
    for _ in range(8):
        store.append(texts(spark, 5))
    other, write = ShardStore(spark, store.root), store._write
    ran = []

    def slow(df, by=None):
        if not ran:  # the other one plans, merges and commits while this one writes
            ran.append(other.compact())
        return write(df, by)

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert store.read().count() == 40 and len(store.shards()) == 1
    assert store.vacuum(grace_s=0) == 8  # the files of the lost round are gone already


def test_an_arrival_during_a_compaction_stays(spark, store, monkeypatch):
    for _ in range(4):
        store.append(texts(spark, 5))
    other, write = ShardStore(spark, store.root), store._write
    ran = []

    def slow(df, by=None):
        if not ran:
            ran.append(other.append(texts(spark, 3, "late")))
        return write(df, by)

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert store.read().count() == 23 and len(store.shards()) == 2


def test_vacuum_during_a_write(spark, store):
    store.append(texts(spark, 5))
    written = store._write(texts(spark, 4))
    assert store.vacuum() == 0
    store.replace([], written, texts(spark, 1).schema)
    assert store.read().count() == 9


def test_arrivals_with_other_columns(spark, store):
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([("b", 7.0)], "text string, `_arrival` double"))
    for _ in range(3):
        store.append(texts(spark, 1, "c"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("z",)], "doc_id string"))
    want = sorted([(1, "a", None), (None, "b", 7.0)] + [(0, "c", None)] * 3, key=str)
    for _ in range(2):
        assert sorted((tuple(r) for r in store.read().collect()), key=str) == want
        store.compact()
    assert len(store.shards()) == 1


def test_a_backlog_has_a_version_for_each_arrival(spark, store):
    df = spark.createDataFrame([(i, i % 3, None) for i in range(30)], "doc_id long, `_arrival` int, `_arrival_` string")
    assert store.append_each(df, F.col("doc_id") % 6) == 6
    assert store.read(version=1).count() == 5
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))
    assert store.append_each(df.limit(0), F.col("doc_id") % 6) == 7


def test_the_query_compacts_and_returns_every_document(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, None), (5, ""), (5, "")], "doc_id long, text string")
    store = queries.arrived(spark, docs)
    before = len(store.shards())
    store.compact()
    assert before >= queries.ARRIVALS and len(store.shards()) == 1 and store.version() > queries.ARRIVALS
    assert store.read().count() == 303
