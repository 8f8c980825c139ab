import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import metrics, params
from vecspark.operators import assign, clustering, evaluate, graph, knn, quantize, tree
from vecspark.plans import search
from vecspark.plans.index import PRESETS, Config, VectorIndex, preset
from vecspark.sources import vecs
from vecspark.streaming import dynamic
from vecspark.streaming.dynamic_index import DynamicIndex

DIM = 16


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(42)
    return (rng.standard_normal((12, DIM))[rng.integers(0, 12, 600)] * 2 + rng.standard_normal((600, DIM))).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return knn.as_queries(vectors, F.col("vec_id") < 25)


def brute(x, q, k, metric):
    d = metrics.numpy_distance(metric)(q.astype(np.float64), x.astype(np.float64))
    return [np.lexsort((np.arange(len(x)), r))[:k].tolist() for r in d]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_exact_search_in_one_and_in_several_blocks(vectors, queries, x, metric):
    want = dict(enumerate(brute(x, x[:25], 7, metric)))
    assert by_query(knn.exact(vectors, queries, 7, metric)) == want
    assert by_query(knn.exact(vectors, queries, 7, metric, block_bytes=500)) == want
    assert by_query(knn.exact_columns(vectors, queries, 7, metric)) == want
    own = by_query(knn.exact(vectors, queries, 7, metric, exclude_self=True))
    assert all(q not in ids for q, ids in own.items())


def test_unknown_metric_and_wrong_length(spark, vectors):
    with pytest.raises(ValueError):
        metrics.distance("L3", F.col("a"), F.col("b"))
    with pytest.raises(Exception, match="components"):
        VectorIndex.build(vectors, Config(DIM + 1, assignment="top_r"), clustering.seeds(vectors, 4)).postings.collect()


def test_sizing():
    assert [params.posting_limit(d) for d in (64, 128, 768)] == [126, 119, 118]
    assert [params.posting_limit(d, 0.25) for d in (64, 128, 768)] == [614, 341, 125]
    assert params.cluster_count(5, 10) == 1 and params.automatic_posting_limit(64, True) == 614


def test_nearest_centroids_in_blocks(vectors):
    c = clustering.seeds(vectors, 20)
    key = lambda df: sorted((r["vec_id"], r["rank"], r["cid"]) for r in df.collect())
    assert key(knn.nearest_centroids(vectors, c, 3)) == key(knn.nearest_centroids(vectors, c, 3, block_bytes=200))


def test_assignment_invariants(vectors, x):
    c = clustering.seeds(vectors, 24)
    kept = assign.rng_filtered(vectors, c, 4).collect()
    lists = {}
    for r in kept:
        lists.setdefault(r["vec_id"], []).append((r["rank"], r["cid"], r["dist"]))
    assert set(lists) == set(range(600))
    for rows in lists.values():
        rows.sort()
        assert len(rows) <= 4
        for i, (_, a, d) in enumerate(rows):
            assert all(((x[a].astype(float) - x[b]) ** 2).sum() >= d * (1 - 1e-6) for _, b, _ in rows[:i])
    assert assign.truncated(assign.top_r(vectors, c, 3), 10).groupBy("cid").count().agg(F.max("count")).first()[0] <= 10
    assert assign.replica_counts(vectors, assign.top_r(vectors, c, 3)).filter("replicas <> 3").count() == 0


def test_clusterings(vectors):
    c0 = clustering.seeds(vectors, 12)
    cost = lambda c: knn.nearest_centroids(vectors, c, 1).agg(F.sum("dist")).first()[0]
    c = clustering.lloyd(vectors, c0, 10)
    assert cost(c) < cost(c0)
    even = evaluate.balance(assign.nearest(vectors, clustering.balanced(vectors, 12, 15))).first()["ratio"]
    assert even < evaluate.balance(assign.nearest(vectors, c0)).first()["ratio"]
    assert cost(clustering.plus_plus(vectors, 12, seed=3)) < 3 * cost(c)
    m = clustering.medoids(vectors, c).collect()
    assert len({r["vec_id"] for r in m}) == len(m) == 12
    assert clustering.mini_batch(vectors, 6, samples=200, rounds=5).count() <= 6
    assert clustering.select_weight(vectors, 6, (0.01, 10.0), 150, 4) in (0.01, 10.0)
    heads = clustering.HierarchicalClustering(ratio=0.05).cluster(vectors).count()
    assert 10 <= heads <= 60
    k = clustering.KMeansClustering(max_iters=3)
    c = k.cluster(vectors)
    assert c.count() == 10
    for rng in (True, False):
        assert k.assign_with_replicas(vectors, c, 3, 40, rng).groupBy("cid").count().agg(F.max("count")).first()[0] <= 40


def test_quantisation(vectors, queries, x):
    rows = vectors.withColumn("cid", F.lit(0))
    for bits in (2, 4, 8):
        got = quantize.multi_bit(rows, bits).join(vectors, "vec_id").select("embedding", quantize.decoded().alias("y"), "scale").collect()
        for r in got:
            assert np.abs(np.array(r["embedding"]) - np.array(r["y"])).max() <= r["scale"] / 2 + 1e-9
    truth = knn.exact(vectors, queries, 50)
    far = vectors.withColumn("embedding", F.transform("embedding", lambda v: v + 3)).withColumn("cid", F.lit(0))
    q = F.broadcast(queries.select("qid", F.transform("embedding", lambda v: v + 3).alias("q")))
    recall = {}
    for debias in (True, False):
        est = quantize.one_bit(far, "L2", debias).crossJoin(q).select("qid", "vec_id", quantize.estimate_one_bit(F.col("q")).alias("dist"))
        recall[debias] = evaluate.mean_recall(truth, knn.ranked(est, "qid", [F.col("dist"), F.col("vec_id")], 50), 50).first()[0]
    assert recall[True] > recall[False] and recall[True] > 0.4
    assert evaluate.mean_recall(truth, quantize.rotated(rows, queries, 50), 50).first()[0] > 0.4
    assert 0 < quantize.best_rescale(np.abs(x[0]).astype(float), 3)
    with pytest.raises(ValueError):
        quantize.multi_bit(rows, 3)


def test_search_finds_all_when_it_probes_all(vectors, queries, x):
    want = dict(enumerate(brute(x, x[:25], 10, "L2")))
    index = VectorIndex.build(vectors, Config(DIM, clustering="seeds", clusters=16, assignment="top_r", replica_count=2))
    assert by_query(index.search(queries, 10, n_probe=16, max_check=10**6)) == want
    truth, last = knn.exact(vectors, queries, 10), 0.0
    for n in (1, 3, 8, 16):
        r = evaluate.mean_recall(truth, index.search(queries, 10, n_probe=n, max_check=10**6), 10).first()[0]
        assert r >= last - 1e-9
        last = r
    assert index.search(queries, 10, max_check=4).groupBy("qid").count().filter("count > 4").count() == 0


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_presets(vectors, queries, name):
    config = preset(name, DIM, clusters=16, rounds=3, n_probe=8)
    index = VectorIndex.build(vectors, config)
    recall = evaluate.mean_recall(knn.exact(vectors, queries, 10), index.search(queries, 10), 10).first()[0]
    assert recall > (0.55 if not config.rerank else 0.75), recall
    assert index.stats().first()["n_vectors"] == 600


def test_save_and_load(spark, vectors, queries, tmp_path):
    index = VectorIndex.build(vectors, preset("disk_quantised", DIM, clusters=12, rounds=2, n_probe=6))
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    assert again.config == index.config
    assert by_query(again.search(queries, 10)) == by_query(index.search(queries, 10))
    assert evaluate.disk_usage(spark, str(tmp_path / "index")) > 0


def test_trees_and_graphs(vectors, x):
    y = x[:200].astype(np.float64)
    nodes = tree.build_bkt(y, 8, 4)
    assert sorted(n.centre for n in nodes[1:]) == list(range(200))
    same = tree.build_bkt(np.ones((50, 3)), 4, 2)
    assert sorted(n.centre for n in same[1:]) == list(range(50))
    kdt = tree.build_kdt(y)
    assert sorted(int(i) for n in kdt if n.rows is not None for i in n.rows) == list(range(200))
    c = clustering.seeds(vectors, 200)
    g = graph.adjacency(graph.thinned(graph.knn_graph(c, 16), c, 10), 200)
    hits = {"bkt": 0, "kdt": 0, "greedy": 0}
    for q in x[300:330].astype(np.float64):
        want = set(brute(y, q[None, :], 5, "L2")[0])
        hits["bkt"] += len(want & set(tree.search_bkt(nodes, y, q, 5, graph=g)[0].tolist()))
        hits["kdt"] += len(want & set(tree.search_kdt(kdt, y, q, 5, candidates=100)[0].tolist()))
        hits["greedy"] += len(want & set(graph.greedy(g, y, q, 5)[0].tolist()))
    assert hits["bkt"] > 135 and hits["kdt"] > 75 and hits["greedy"] > 75, hits


def test_updates(spark, vectors):
    c = clustering.seeds(vectors, 8)
    held = assign.nearest(vectors, c).select("cid", "vec_id").cache()
    new, moved = dynamic.split(c, held, vectors, 30)
    big = {r["cid"] for r in dynamic.posting_sizes(held, 30).filter("need_split").collect()}
    assert big and {r["old"] for r in moved.select("old").distinct().collect()} == big
    assert moved.count() == held.filter(F.col("cid").isin(*big)).count() == moved.select("vec_id").distinct().count()
    labels = vectors.select("vec_id", F.lit(0).alias("label"))
    gone = vectors.filter("vec_id < 10").select("vec_id")
    once = dynamic.delete(labels, gone)
    assert dynamic.label_counts(dynamic.delete(once, gone)).first().asDict() == {"n_total": 600, "n_deleted": 10, "n_active": 590}
    assert dynamic.live(held, once).count() == 590
    moves = spark.createDataFrame([(11, 0, 5)], "vec_id long, from_cid int, to_cid int")
    after = {r["vec_id"]: r["cid"] for r in dynamic.moved(held, moves).collect()}
    assert after[11] == 5 and len(after) == 600


def test_label_algebra(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 127, 128, 255, None)], "label int")
    x = F.col("label")
    got = df.select(x, dynamic.bumped(x).alias("b"), dynamic.deleted(x).alias("d"), dynamic.undeleted(x).alias("u"), dynamic.with_version(x, F.lit(300)).alias("s")).collect()
    for r in got:
        old = r["label"] or 0
        assert r["b"] == (old & 128) | ((old + 1) & 127) and r["d"] == old | 128 and r["s"] == (old & 128) | (300 & 127)
        assert r["u"] == (None if r["label"] is None else old & 127)


def test_streamed_operations(spark, tmp_path):
    ops = spark.createDataFrame([(1, 5, "insert"), (2, 5, "delete"), (3, 6, "insert")], "op_seq long, vec_id long, op string")
    ops.write.parquet(str(tmp_path / "ops"))
    seen = []

    def on_batch(batch, number):
        labels = batch.sparkSession.createDataFrame([(5, 0)], "vec_id long, label int")
        seen.extend(map(tuple, dynamic.apply_operations(labels, batch).collect()))

    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))
    run = dynamic.stream_updates(stream, on_batch, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(seen) == [(5, 129), (6, 1)]


def test_sources(spark, vectors, x, tmp_path):
    path = str(tmp_path / "a.fvecs")
    vecs.write_vecs(vectors, path)
    back = vecs.read_fvecs(spark, path, rows=100)
    assert back.rdd.getNumPartitions() == 6
    assert np.array_equal(np.array([r["embedding"] for r in sorted(back.collect(), key=lambda r: r["vec_id"])], np.float32), x)
    ints = str(tmp_path / "t.ivecs")
    vecs.write_vecs(spark.createDataFrame([(0, [3, 1]), (1, [2, 9])], "vec_id long, embedding array<int>"), ints, "ivecs")
    assert sorted(map(tuple, vecs.truth_of(vecs.read_ivecs(spark, ints)).collect())) == [(0, 1, 3), (0, 2, 1), (1, 1, 2), (1, 2, 9)]
    (tmp_path / "bad").write_bytes(b"\x02\0\0\0abc")
    with pytest.raises(Exception, match="no file of vectors"):
        vecs.read_fvecs(spark, str(tmp_path / "bad")).collect()
    vecs.save_bundle(str(tmp_path / "b"), vectors, knn.as_queries(vectors, F.col("vec_id") < 5), vecs.truth_of(vecs.read_ivecs(spark, ints)))
    train, test, neighbors = vecs.load_bundle(spark, str(tmp_path / "b"), max_queries=1)
    assert (train.count(), test.count(), neighbors.count()) == (600, 1, 2)
    assert vecs.synthetic(spark, 50, 8).count() == 50


def test_evaluation(spark, vectors):
    t = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "s double")
    got = evaluate.latency(t, "s").first()
    assert got["p50"] == pytest.approx(0.25) and got["qps"] == pytest.approx(4)
    assert not evaluate.norm_profile(vectors).first()["all_unit"]
    unit = vectors.select("vec_id", metrics.normalize(F.col("embedding")).alias("embedding"))
    assert evaluate.norm_profile(unit).first()["all_unit"]


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_ties_of_many_copies_go_to_the_smaller_ids(spark, metric):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, DIM))
    copies = np.sort(rng.choice(1200, 300, replace=False))
    x[copies] = x[copies[0]] * 3
    rows = [(int(i), x[i].tolist()) for i in rng.permutation(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    one = spark.createDataFrame([(0, x[copies[0]].tolist())], "qid long, embedding array<double>")
    assert by_query(knn.exact(df, one, 10, metric)) == {0: copies[:10].tolist()}
    seeds = df.select(F.col("vec_id").cast("int").alias("cid"), F.col("embedding").alias("centroid"))
    near = knn.nearest_centroids(one.withColumnRenamed("qid", "vec_id"), seeds, 10, metric).collect()
    assert [r["cid"] for r in sorted(near, key=lambda r: r["rank"])] == copies[:10].tolist()


def test_closure_takes_every_centroid_within_the_factor(vectors, x):
    c = clustering.seeds(vectors, 150)
    m = np.array([r["centroid"] for r in c.orderBy("cid").collect()], np.float64)
    d = metrics.numpy_pairs("L2")(x[:, None].astype(np.float64), m[None])
    for factor in (1.5, 50.0):
        got = sorted((r["vec_id"], r["cid"]) for r in assign.closure(vectors, c, factor).collect())
        assert got == list(zip(*(v.tolist() for v in np.nonzero(d <= factor * d.min(1)[:, None])), strict=True))
    assert np.bincount([v for v, _ in got]).max() > 64


def test_heads_of_several_trees(vectors, x):
    one = clustering.HierarchicalClustering(ratio=0.05).cluster(vectors)
    many = clustering.HierarchicalClustering(ratio=0.05, sample=300).cluster(vectors)
    for heads in (one, many):
        rows = sorted((r["cid"], r["centroid"]) for r in heads.collect())
        assert [r[0] for r in rows] == list(range(len(rows))) and 4 <= len(rows) <= 80
        assert all((np.abs(x - np.array(v, np.float32)).sum(1) == 0).any() for _, v in rows)


def test_rules_of_the_neighbourhood_agree(vectors):
    c = clustering.seeds(vectors, 30)
    near = knn.nearest_centroids(vectors, c, 20)
    lists = near.join(c.withColumnsRenamed({"cid": "_c", "centroid": "_v"}), F.col("cid") == F.col("_c")).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dist", "cid", F.col("_v").alias("v")))).alias("near"))
    kept = lists.select("vec_id", F.explode(assign.kept_in_order(F.col("near"), lambda p, y: assign.nearer(p, y, 1.0, "L2"), 5)).alias("y"))
    want = sorted((r["vec_id"], r["cid"]) for r in kept.select("vec_id", "y.cid").collect())
    assert sorted((r["vec_id"], r["cid"]) for r in assign.rng_filtered(vectors, c, 5, 20).collect()) == want
    found = {(r["vec_id"], r["cid"]) for r in assign.by_tree(vectors, c, 5, 20).collect()}
    assert len(found & set(want)) > 0.8 * len(want)


def test_matrix_of_centroids(vectors, x):
    got = {(r["a"], r["b"]): r["dist"] for r in assign.centroid_distances(clustering.seeds(vectors, 9)).collect()}
    assert len(got) == 81 and all(d == pytest.approx(((x[a].astype(float) - x[b]) ** 2).sum()) for (a, b), d in got.items())


def test_flagship_truncates_and_finds(vectors, queries):
    index = VectorIndex.build(vectors, preset("flagship", DIM, clusters=30, posting_limit=60))
    assert index.postings.groupBy("cid").count().agg(F.max("count")).first()[0] <= 60
    assert evaluate.mean_recall(knn.exact(vectors, queries, 10), index.search(queries, 10), 10).first()[0] >= 0.9
    assert preset("flagship", DIM).posting_limit == "auto"


def test_stored_postings_are_read_by_their_folders(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors, preset("disk_quantised", DIM, clusters=40, rounds=1, n_probe=2))
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    one = knn.as_queries(vectors, F.col("vec_id") == 3)
    found = again.search(one, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cid_bucket" in plan or "cid_bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert by_query(found) == by_query(index.search(one, 5)) == by_query(again.preload().search(one, 5))


def test_dynamic_index(spark, vectors, x, tmp_path):
    base = vectors.filter("vec_id < 500")
    index = DynamicIndex.create(spark, str(tmp_path / "d"), base, clustering.seeds(base, 6), target=50)
    before = index.state
    new = index.insert(vectors.filter("vec_id >= 500"), "vec_id")
    assert sorted((r["vec_id"], r["embedding"]) for r in new.collect()) == [(i, x[i].tolist()) for i in range(500, 600)]
    index.delete(vectors.filter("vec_id % 7 = 0"))
    label = {r["vec_id"]: r["label"] for r in index.labels.collect()}
    assert label == {i: (i >= 500) | (0 if i % 7 else 128) for i in range(600)}
    live = np.array([i for i in range(600) if i % 7])
    for _ in range(3):
        again = DynamicIndex(spark, str(tmp_path / "d"))
        q = knn.as_queries(vectors, F.col("vec_id") < 9)
        got = by_query(again.search(q, 5, n_probe=10**4))
        assert got == {i: live[r].tolist() for i, r in enumerate(brute(x[live], x[:9], 5, "L2"))}
        rows = dynamic.live(again.postings, again.labels).collect()
        assert sorted(r["vec_id"] for r in rows) == live.tolist()
        split = index.maintain()
    assert split == 0 or index.sizes().filter("need_split").count() >= 0
    assert not {r["cid"] for r in index.postings.collect()} - {r["cid"] for r in index.centroids.collect()}
    other = DynamicIndex(spark, str(tmp_path / "d"))
    other.state = before
    with pytest.raises(RuntimeError):
        other.delete(vectors.filter("vec_id = 1"))
    for k in range(18):  # labels are merged
        index.delete(vectors.filter(F.col("vec_id") == k))
    assert len(index.state["labels"]) <= 16 and dynamic.label_counts(index.labels).first()["n_deleted"] == 86 + 15


def test_datasets(spark, vectors, tmp_path):
    (tmp_path / "s").mkdir()
    for name, n in (("a_base.fvecs", 50), ("a_query.fvecs", 9)):
        vecs.write_vecs(vectors.filter(F.col("vec_id") < n), str(tmp_path / "s" / name))
    vecs.write_vecs(spark.createDataFrame([(k, [k, 60 + k, 3]) for k in range(9)], "vec_id long, embedding array<int>"), str(tmp_path / "s" / "a_groundtruth.ivecs"), "ivecs")
    base, q, truth = vecs.load_dataset(spark, "vecs", str(tmp_path / "s"), max_queries=4)
    assert (base.count(), q.count(), truth.count()) == (50, 4, 12)
    assert sorted(map(tuple, evaluate.within(truth, 50).select("qid", "vec_id", "rank").collect()))[:2] == [(0, 0, 1), (0, 3, 2)]
    for bad in ("hdf5", "vecs"):
        with pytest.raises(ValueError):
            vecs.load_dataset(spark, bad, str(tmp_path))
    assert set(evaluate.stage_seconds({"base": base, "query": q})) == {"base", "query"}


def test_small_pieces(spark, vectors, x):
    c = clustering.seeds(vectors, 20)
    edges = graph.knn_graph(c, 5)
    added = graph.with_neighbour(edges.filter("rank > 1"), edges.filter("rank = 1"), c, 5)
    key = lambda df: sorted((r["src"], r["dst"], r["rank"]) for r in df.collect())
    assert key(added) == key(graph.thinned(edges, c, 5))
    sizes = dynamic.posting_sizes(assign.nearest(vectors, c), 30)
    assert dynamic.size_totals(sizes).first().asDict() == {"n_postings": 20, "n_vectors": 600, "size_avg": 30.0}
    assert dynamic.posting_sizes(assign.nearest(vectors, c).filter("cid > 0"), 30, c).filter("cid = 0").first().asDict() == {"cid": 0, "n": 0, "need_split": False, "need_merge": True}
    changes = spark.createDataFrame([(0, 5), (0, -2), (99, 1)], "cid int, delta long")
    was, now = ({r["cid"]: r["n"] for r in df.collect()} for df in (sizes, dynamic.updated_sizes(sizes, changes)))
    assert now == was | {0: was[0] + 3, 99: 1}
    m = np.abs(x[0]).astype(float)
    cosine = lambda f: (lambda k: k @ m / np.sqrt(k @ k))(np.minimum(np.floor(m * f + 1e-5), 7) + 0.5)
    assert cosine(quantize.best_rescale(m, 3)) >= max(cosine(f) for f in np.linspace(0.3, 1, 50) * 7 / m.max()) - 1e-9
    w = tree.even_weight(x[:300].astype(float), 8)
    assert sorted(n.centre for n in tree.build_bkt(x[:300].astype(float), 8, 4, weight=None)[1:]) == list(range(300)) and w > 0
    row = vectors.limit(1).select(quantize.delta(F.transform("embedding", lambda v: (v > 0).cast("int")), F.col("embedding"), 1).alias("d"), "embedding").first()
    v = np.array(row["embedding"], float)
    s = (v > 0) - 0.5
    assert row["d"] == pytest.approx(np.linalg.norm(v) / np.linalg.norm(s) * (v @ s) / (np.linalg.norm(v) * np.linalg.norm(s)))


def test_scan_gives_what_decides_on_the_nearest_and_no_more(spark, vectors, queries):
    rng = np.random.default_rng(3)
    copies = vectors.select("vec_id", "embedding").union(vectors.filter("vec_id = 7").select(F.explode(F.sequence(F.lit(1000), F.lit(1400))).alias("vec_id"), "embedding")).cache()
    centroids = clustering.seeds(copies, 9)
    index = VectorIndex.build(copies, Config(DIM, assignment="closure", closure_factor=1.6, n_probe=5, max_check=None), centroids)
    probes = search.probe(queries, centroids, 5).filter((F.col("c_rank") < 5) | (F.col("qid") % 2 == 0)).cache()
    plain = search.scored(probes, index.postings, copies).cache()
    for block in (1 << 26, 4000):
        found = search.nearest_met(probes, index.postings, copies, 6, block_bytes=block).cache()
        tasks = found.select(F.spark_partition_id()).distinct().count()
        assert found.filter("vec_id IS NOT NULL").count() <= 6 * probes.count() * tasks < plain.count() * 2
        first = search.first_met(plain)
        seen = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
        assert seen(found.groupBy("qid", "c_rank").agg(F.sum("new")).filter("`sum(new)` > 0")) == seen(first.groupBy("qid", "c_rank").count())
        assert seen(found.groupBy("qid", "c_rank").agg(F.sum("n")).filter("`sum(n)` > 0")) == seen(plain.groupBy("qid", "c_rank").count())
        for most in (None, 1, 4, 30, *rng.integers(50, 1200, 4).tolist()):
            for wanted in (None, 2):
                want = search.first_met(search.early_stop(plain, wanted, 6) if wanted else plain, most)
                assert by_query(search.top_k(search.checked(found, 6, most, wanted), 6)) == by_query(search.top_k(want, 6))
    assert search.nearest_met(probes.filter("qid < 0"), index.postings, copies, 6).count() == 0


def test_pruned_search_scans_once_and_stops_where_it_should(vectors, queries):
    index = VectorIndex.build(vectors, Config(DIM, assignment="closure", closure_factor=1.3, n_probe=9, max_check=None, pruned=True), clustering.seeds(vectors, 12))
    met = search.first_met(search.scored(search.probe(queries, index.centroids, 9), index.postings, vectors)).collect()
    want, cut = {}, 0
    for q in {r["qid"] for r in met}:
        own = [r for r in met if r["qid"] == q]
        for r in sorted(own, key=lambda r: r["c_rank"]):
            near = sorted(m["est"] for m in own if m["c_rank"] < r["c_rank"])
            if len(near) >= 5 and r["c_dist"] > near[4]:
                own, cut = [m for m in own if m["c_rank"] < r["c_rank"]], cut + 1
                break
        want[q] = [m["vec_id"] for m in sorted(own, key=lambda m: (m["est"], m["vec_id"]))[:5]]
    got = index.search(queries, 5)
    assert by_query(got) == want and cut
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # postings, scan


@pytest.mark.parametrize("metric", ("L2", "IP"))
def test_estimates_by_blocks_are_those_of_the_columns(vectors, queries, metric):
    far = vectors.withColumn("embedding", F.transform("embedding", lambda v: v + 3000))
    rows = assign.nearest(far, clustering.seeds(far, 5)).select("cid", "vec_id").join(far, "vec_id")
    asked = knn.as_queries(far, F.col("vec_id") < 25)
    for bits in (1, 4):
        codes = quantize.encode(rows, bits, metric).cache()
        column = quantize.estimate(bits, F.col("q"), metric)
        want = {(r[0], r[1]): r[2] for r in codes.crossJoin(asked.withColumnRenamed("embedding", "q")).select("qid", "vec_id", column).collect()}
        for block in (1 << 26, 500):
            df = quantize.estimates(codes, asked, bits, metric, block_bytes=block)
            got = df.collect()
            assert len(got) == len(want) == 600 * 25
            assert max(abs(r["est"] - want[r["qid"], r["vec_id"]]) for r in got) <= (1e-9 if bits == 4 and metric == "L2" else 1e-3)
            assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    assert quantize.estimates(codes, asked.filter("qid < 0"), 4).count() == 0
    edge = np.array([0.5e-6, -0.5e-6, 2.4999994, -0.0, np.inf, -np.inf, np.nan, 1e305, -1.2345675])
    assert repr(metrics.numpy_rounded(edge).tolist()) == "[1e-06, -1e-06, 2.499999, 0.0, inf, -inf, nan, 1e+305, -1.234568]"


def test_rounded_estimates_are_the_direct_ones():
    rng = np.random.default_rng(9)
    for shift, spread in ((0, 1), (3000, 1), (0, 1e5), (0, 1e200)):
        q, mu = (rng.standard_normal((70, 24)) * spread + shift for _ in range(2))
        read = q, rng.integers(0, 16, (900, 24)).astype(float), mu[0], np.full(900, -2.0 * spread), np.full(900, 0.27 * spread)
        with np.errstate(all="ignore"):
            want = metrics.numpy_rounded(quantize._multi_bit_estimates(*read, "L2"))
            got = quantize._multi_bit_rounded(*read, 6)
        assert np.array_equal(got, want, equal_nan=True)


def test_rotated_search_holds_few_candidates_and_orders_copies(spark, x):
    """Copies that tie at the end of the list, rows of two postings, and many more rows than are asked for."""
    of = np.r_[np.arange(40), np.full(3000, 7), np.arange(40)]
    x, ids = x[of].astype(float), np.random.default_rng(5).permutation(len(of))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    once = df.withColumn("cid", F.lit(0)).repartition(5)
    rows = once.union(once.filter(F.col("vec_id").isin(ids[:40].tolist())).withColumn("cid", F.lit(1)))
    asked = knn.as_queries(df, F.col("vec_id") % 100 == 0)
    codes = quantize.one_bit(rows, debias=True).cache()
    est = codes.crossJoin(asked.withColumnRenamed("embedding", "q")).select("qid", "vec_id", quantize.estimate_one_bit(F.col("q")).alias("dist"))
    want = by_query(knn.ranked(est.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist")), "qid", ["dist", "vec_id"], 12))
    for block in (1 << 26, 700):
        found = quantize.nearest_by_one_bit(codes, asked, 12, block_bytes=block)
        assert by_query(found) == want
    plan = quantize.rotated(rows, asked, 12, turn=np.eye(DIM))
    assert by_query(plan) == want
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
