"""The engine's query catalogue over ``embeddings``, and the SQL that each must agree with."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import metrics as M
from vecspark.functions import params
from vecspark.operators import assign, clustering, evaluate, graph, knn, quantize, tree
from vecspark.plans import search as plan
from vecspark.plans.index import Config, VectorIndex, preset
from vecspark.sources import vecs
from vecspark.streaming import dynamic
from vecspark.streaming.dynamic_index import DynamicIndex

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Seeds and neighbours of the catalogue. Queries are the rows whose id this divides.
K, TOP, EVERY = 16, 10, 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL in pieces


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


E_ = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
C_ = f"{E_}, c AS (SELECT vec_id::INT AS cid, v AS c FROM e WHERE vec_id < {K})"
Q_ = f"q AS (SELECT vec_id AS qid, v AS q FROM e WHERE vec_id % {EVERY} = 0)"
NEAR = f"{C_}, near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid)::INT AS rank FROM (SELECT vec_id, v, cid, {l2('v', 'c')} AS dist FROM e, c))"
FINAL = f"SELECT qid, vec_id, rank, {r6('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id)::INT AS rank FROM found) WHERE rank <= {TOP}"


def fold(most: int) -> str:
    """Kept candidates of a list ``l`` of (dist, id, v), in order."""
    return f"list_reduce(l, lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda p: {l2('p.v', 'x.v')} < x.dist * (1 - 1e-9))) = 0 THEN list_append(acc, x) ELSE acc END, []::STRUCT(dist DOUBLE, id INT, v DOUBLE[])[])"


# Tables


def table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def queries_of(vectors: DataFrame) -> DataFrame:
    return knn.as_queries(vectors, F.col("vec_id") % EVERY == 0)


def seeds(vectors: DataFrame, k: int = K) -> DataFrame:
    return clustering.seeds(vectors, k)


def dist6(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", M.rounded(F.col("dist")))


# Exact search and vector functions


def _knn_sql(d: str) -> str:
    return f"WITH {E_}, {Q_}, found AS (SELECT qid, vec_id, {d} AS dist FROM q, e) {FINAL}"


@query(_knn_sql(l2("q", "v")))
def knn_l2(spark, d):
    v = table(spark, d)
    return dist6(knn.exact(v, queries_of(v), TOP, "L2"))


@query(_knn_sql("-" + dot("q", "v")))
def knn_ip(spark, d):
    v = table(spark, d)
    return dist6(knn.exact(v, queries_of(v), TOP, "IP"))


@query(_knn_sql("-" + dot("q", "v")))
def knn_cosine(spark, d):
    v = table(spark, d)
    return dist6(knn.exact_columns(v, queries_of(v), TOP, "Cosine"))


#: Every vector is one of the first forty, so that all distances tie many times.
COPIES = "e AS (SELECT a.vec_id, b.embedding::DOUBLE[] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 40)"


@query(_knn_sql(l2("q", "v")).replace(E_, COPIES))
def knn_ties(spark, d):
    v = table(spark, d)
    of = v.select(F.col("vec_id").alias("of"), "embedding")
    copies = v.select("vec_id", (F.col("vec_id") % 40).alias("of")).join(of, "of").select("vec_id", "embedding")
    return dist6(knn.exact(copies, queries_of(copies), TOP, "L2"))


@query(f"WITH {E_}, n AS (SELECT sqrt({dot('v', 'v')}) AS n FROM e) SELECT count(*) AS n_vectors, {r6('min(n)')} AS norm_min, {r6('max(n)')} AS norm_max, {r6('avg(n)')} AS norm_avg, bool_and(abs(n - 1) <= 0.0001) AS all_unit FROM n")
def vector_norm_profile(spark, d):
    p = evaluate.norm_profile(table(spark, d))
    return p.select("n_vectors", *[M.rounded(F.col(c)).alias(c) for c in ("norm_min", "norm_max", "norm_avg")], "all_unit")


@query(f"WITH {E_}, n AS (SELECT vec_id, v, sqrt({dot('v', 'v')}) AS n FROM e) SELECT vec_id, {r6('list_sum(list_transform(v, lambda x: abs(x / n)))')} AS abs_sum, {r6('v[1] / n')} AS first FROM n")
def normalize_vectors(spark, d):
    v = table(spark, d).select("vec_id", M.normalize(F.col("embedding")).alias("u"))
    return v.select("vec_id", M.rounded(M.total(F.transform("u", F.abs))).alias("abs_sum"), M.rounded(F.get("u", F.lit(0))).alias("first"))


@query("""WITH p AS (SELECT * FROM (VALUES (32), (64), (96), (128), (256), (384), (512), (768), (1024)) a(dim), (VALUES (0.25::DOUBLE), (1.0::DOUBLE), (4.0::DOUBLE)) b(value_size))
SELECT dim, value_size, floor(greatest(3, ceil(118 * (dim * value_size + 4) / 4096)) * 4096 / (dim * value_size + 4))::INT AS posting_limit FROM p""")
def posting_limit_table(spark, d):
    rows = [(n, s) for n in (32, 64, 96, 128, 256, 384, 512, 768, 1024) for s in (0.25, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "dim int, value_size double")
    return df.withColumn("posting_limit", params.posting_limit_column(F.col("dim"), F.col("value_size")))


# Assignment


@query(f"WITH {NEAR} SELECT vec_id, cid, {r6('dist')} AS dist FROM near WHERE rank = 1")
def assign_nearest(spark, d):
    v = table(spark, d)
    return dist6(assign.nearest(v, seeds(v)).select("vec_id", "cid", "dist"))


@query(f"WITH {NEAR} SELECT vec_id, cid, rank, {r6('dist')} AS dist FROM near WHERE rank <= 3")
def assign_topr(spark, d):
    v = table(spark, d)
    return dist6(assign.top_r(v, seeds(v), 3).select("vec_id", "cid", "rank", "dist"))


CLOSE = "SELECT vec_id, cid, rank, dist FROM (SELECT *, min(dist) OVER (PARTITION BY vec_id) AS d0 FROM near) WHERE dist <= 1.15 * d0"


@query(f"WITH {NEAR} SELECT vec_id, cid, rank, {r6('dist')} AS dist FROM ({CLOSE})")
def assign_closure(spark, d):
    v = table(spark, d)
    return dist6(assign.closure(v, seeds(v), 1.15).select("vec_id", "cid", "rank", "dist"))


@query(f"WITH {NEAR} SELECT vec_id, cid, rank, {r6('dist')} AS dist FROM ({CLOSE.replace('1.15', '9')})".replace(f"vec_id < {K})", "vec_id < 100)"))
def assign_closure_wide(spark, d):
    v = table(spark, d)
    return dist6(assign.closure(v, seeds(v, 100), 9.0).select("vec_id", "cid", "rank", "dist"))


RNG = f"lists AS (SELECT vec_id, list({{'dist': dist, 'id': cid, 'v': c}} ORDER BY dist, cid) AS l FROM (SELECT near.*, c.c FROM near JOIN c USING (cid)) GROUP BY vec_id), kept AS (SELECT vec_id, unnest({fold(8)}) AS x FROM lists), post AS (SELECT vec_id, x.id AS cid, x.dist AS dist FROM kept)"


@query(f"WITH {NEAR}, {RNG} SELECT vec_id, cid, {r6('dist')} AS dist FROM post")
def assign_rng(spark, d):
    v = table(spark, d)
    return dist6(assign.rng_filtered(v, seeds(v), 8).select("vec_id", "cid", "dist"))


@query(f"WITH {NEAR} SELECT cid, vec_id, pos FROM (SELECT cid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY dist, vec_id)::INT AS pos FROM near WHERE rank <= 3) WHERE pos <= 25")
def posting_truncate(spark, d):
    v = table(spark, d)
    return assign.truncated(assign.top_r(v, seeds(v), 3), 25).select("cid", "vec_id", "pos")


@query(f"WITH {NEAR} SELECT cid, vec_id, pos FROM (SELECT cid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY vec_id)::INT AS pos FROM near WHERE rank <= 3) WHERE pos <= 25")
def posting_first_come(spark, d):
    v = table(spark, d)
    return assign.first_come(assign.top_r(v, seeds(v), 3), 25).select("cid", "vec_id", "pos")


@query(f"WITH {NEAR} SELECT cid, vec_id FROM near WHERE rank <= 2 AND vec_id >= {K}")
def postings_without_heads(spark, d):
    v = table(spark, d)
    heads = v.filter(F.col("vec_id") < K)
    return assign.without_heads(assign.top_r(v, seeds(v), 2), heads).select("cid", "vec_id")


@query(f"WITH {NEAR}, {RNG}, n AS (SELECT vec_id, count(*) AS replicas FROM post GROUP BY vec_id) SELECT coalesce(replicas, 0) AS replicas, count(*) AS n_vectors FROM e LEFT JOIN n USING (vec_id) GROUP BY 1")
def replica_histogram(spark, d):
    v = table(spark, d)
    return assign.replica_histogram(v, assign.rng_filtered(v, seeds(v), 8))


SIZES = "n AS (SELECT cid, count(*) AS n FROM near WHERE rank <= 2 GROUP BY cid)"


@query(f"WITH {NEAR}, {SIZES} SELECT (SELECT count(*) FROM e) AS n_vectors, count(*) AS n_clusters, min(n) AS size_min, max(n) AS size_max, {r6('avg(n)')} AS size_avg, {r6('stddev_pop(n)')} AS size_std, sum(n)::BIGINT AS n_postings, {r6('sum(n) / (SELECT count(*) FROM e)')} AS replication, count(*) * 256 AS centroid_bytes FROM n")
def index_stats(spark, d):
    v = table(spark, d)
    index = VectorIndex.build(v, Config(64, assignment="top_r", replica_count=2), seeds(v))
    return index.stats().select("n_vectors", "n_clusters", "size_min", "size_max", *[M.rounded(F.col(c)).alias(c) for c in ("size_avg", "size_std", "replication")], "n_postings", "centroid_bytes")


@query(f"WITH {NEAR}, n AS (SELECT cid, count(*) AS n FROM near WHERE rank = 1 GROUP BY cid) SELECT count(*) AS n_clusters, min(n) AS size_min, max(n) AS size_max, {r6('stddev_pop(n) / avg(n)')} AS ratio FROM n")
def cluster_balance(spark, d):
    v = table(spark, d)
    return evaluate.balance(assign.nearest(v, seeds(v))).select("n_clusters", "size_min", "size_max", M.rounded(F.col("ratio")).alias("ratio"))


# Clustering


def _rounds(n: int, penalty: str | None = None) -> str:
    """CTEs of ``n`` rounds: assignments ``a1…``, centroids ``c1…`` (``c0`` are the seeds)."""
    out = [E_, f"c0 AS (SELECT vec_id::INT AS cid, v AS c, 0::DOUBLE AS cost FROM e WHERE vec_id < {K})"]
    for i in range(1, n + 1):
        out.append(f"a{i} AS (SELECT vec_id, any_value(v) AS v, arg_min(cid, (dist + cost, cid)) AS cid, arg_min(dist, (dist + cost, cid)) AS dist FROM (SELECT vec_id, v, cid, cost, {l2('v', 'c')} AS dist FROM e, c{i - 1}) GROUP BY vec_id)")
        cost = "0::DOUBLE"
        if penalty == "share":
            cost = f"coalesce((SELECT count(*) FROM a{i} WHERE a{i}.cid = c{i - 1}.cid), 0) / (SELECT count(*) FROM e)"
        elif penalty:
            out.append(f"s{i} AS (SELECT cid, count(*) AS n, max(dist) AS far, avg(dist) AS mean FROM a{i} GROUP BY cid)")
            out.append(f"w{i} AS (SELECT greatest(0, (far - mean) / (SELECT count(*) FROM e)) AS w FROM s{i} ORDER BY n DESC, cid LIMIT 1)")
            cost = f"coalesce((SELECT n FROM s{i} WHERE s{i}.cid = c{i - 1}.cid), 0) * (SELECT w FROM w{i})"
        out.append(f"m{i} AS (SELECT cid, list(m ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY cid, pos) GROUP BY cid)")
        out.append(f"c{i} AS (SELECT c{i - 1}.cid, coalesce(m{i}.c, c{i - 1}.c) AS c, {cost} AS cost FROM c{i - 1} LEFT JOIN m{i} ON m{i}.cid = c{i - 1}.cid)")
    return "WITH " + ",\n".join(out)


CENTRES = "SELECT cid, pos::INT AS pos, round(x, 5) + 0.0 AS x FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM c3)"


def _components(c: DataFrame) -> DataFrame:
    return c.select("cid", F.posexplode("centroid").alias("pos", "x")).withColumn("x", M.rounded(F.col("x"), 5))


@query(f"{_rounds(3)} {CENTRES}")
def kmeans_lloyd3(spark, d):
    v = table(spark, d)
    return _components(clustering.lloyd(v, seeds(v), 3, tolerance=0))


@query(f"{_rounds(3, 'share')} {CENTRES}")
def kmeans_share3(spark, d):
    v = table(spark, d)
    return _components(clustering.lloyd(v, seeds(v), 3, tolerance=0, penalty="share"))


@query(f"{_rounds(3, 'adaptive')} {CENTRES}")
def kmeans_balanced3(spark, d):
    v = table(spark, d)
    return _components(clustering.lloyd(v, seeds(v), 3, tolerance=0, penalty="adaptive"))


@query(f"{_rounds(3)} SELECT cid, arg_min(vec_id, (dist, vec_id)) AS vec_id FROM (SELECT vec_id, arg_min(cid, (dist, cid)) AS cid, min(dist) AS dist FROM (SELECT vec_id, cid, {l2('v', 'c')} AS dist FROM e, c3) GROUP BY vec_id) GROUP BY cid")
def kmeans_medoids(spark, d):
    v = table(spark, d)
    return clustering.medoids(v, clustering.lloyd(v, seeds(v), 3, tolerance=0)).select("cid", "vec_id")


@query()
def head_selection(spark, d):
    v = table(spark, d)
    return clustering.HierarchicalClustering(ratio=0.05).cluster(v).select("cid", F.size("centroid").alias("dim"))


# Approximate search


PROBES = f"{Q_}, probes AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c_dist, cid)::INT AS c_rank FROM (SELECT qid, q, cid, {l2('q', 'c')} AS c_dist FROM q, c))"


def _ann_sql(postings: str, probes: str = "c_rank <= 4", per_posting: str = "true", cap: str = "true", found: str = "capped", more: str = "") -> str:
    return f"""WITH {NEAR}, {PROBES}, post AS ({postings}),
scored AS (SELECT qid, q, vec_id, c_rank, c_dist, {l2('q', 'v')} AS est FROM probes JOIN post USING (cid) JOIN e USING (vec_id) WHERE {probes}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, c_rank ORDER BY est, vec_id) AS l_rank FROM scored),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY c_rank, l_rank) AS o FROM ranked WHERE {per_posting}) WHERE o = 1),
capped AS (SELECT *, est AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c_rank, l_rank) AS checked FROM once) WHERE {cap}){more},
found AS (SELECT * FROM {found}) {FINAL}"""


TWO = "SELECT cid, vec_id FROM near WHERE rank <= 2"


def _index(spark, d, **settings) -> tuple[VectorIndex, DataFrame]:
    v = table(spark, d)
    return VectorIndex.build(v, Config(64, **({"assignment": "top_r", "replica_count": 2, "n_probe": 4, "max_check": None} | settings)), seeds(v)), queries_of(v)


@query(_ann_sql(TWO))
def ann_union(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP))


@query(_ann_sql(TWO, cap="checked <= 60"))
def ann_maxcheck(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP, max_check=60))


@query(_ann_sql("SELECT cid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY vec_id) AS p FROM near WHERE rank <= 2) WHERE p <= 30"))
def ann_prefix(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP, per_posting=30))


@query(_ann_sql(TWO, probes="c_rank <= 8 AND (1.2 * (SELECT min(p.c_dist) FROM probes p WHERE p.qid = probes.qid) <= 0.1 OR c_dist <= 1.2 * (SELECT min(p.c_dist) FROM probes p WHERE p.qid = probes.qid))"))
def ann_dist_ratio(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP, n_probe=8, max_dist_ratio=1.2))


@query(_ann_sql(TWO, found="(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY est, vec_id) AS n FROM capped) WHERE n <= 7)"))
def ann_rerank_top_n(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP, rerank_top_n=7))


@query(_ann_sql(TWO, more=""", n AS (SELECT qid, c_rank, count(*) AS n FROM scored GROUP BY qid, c_rank),
run AS (SELECT qid, c_rank, sum(n) OVER w AS seen, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY qid ORDER BY c_rank)),
stop AS (SELECT qid, min(c_rank) AS stop FROM run WHERE k >= 2 AND seen >= 20 GROUP BY qid)""", found="(SELECT capped.* FROM capped LEFT JOIN stop USING (qid) WHERE stop IS NULL OR c_rank <= stop)"))
def ann_early_stop(spark, d):
    index, q = _index(spark, d)
    return dist6(index.search(q, TOP, early_stop_postings=2))


@query(_ann_sql(CLOSE.replace("vec_id, cid, rank, dist", "cid, vec_id"), probes="c_rank <= 8", more=f""", kth AS (SELECT a.qid, a.c_rank, any_value(a.c_dist) AS c_dist,
  (SELECT CASE WHEN count(*) >= {TOP} THEN list_sort(list(b.est))[{TOP}] END FROM capped b WHERE b.qid = a.qid AND b.c_rank < a.c_rank) AS kth FROM capped a GROUP BY a.qid, a.c_rank),
stop AS (SELECT qid, min(c_rank) AS stop FROM kth WHERE c_dist > kth GROUP BY qid)""", found="(SELECT capped.* FROM capped LEFT JOIN stop USING (qid) WHERE stop IS NULL OR c_rank < stop)"))
def ann_pruned(spark, d):
    index, q = _index(spark, d, assignment="closure", closure_factor=1.15, n_probe=8, pruned=True)
    return dist6(index.search(q, TOP))


# Quantisation: postings are the nearest of the seeds


RES = f"""{NEAR}, p AS (SELECT cid, vec_id, v FROM near WHERE rank = 1),
mu AS (SELECT cid, list(m ORDER BY pos) AS mu FROM (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM p) GROUP BY cid, pos) GROUP BY cid),
r AS (SELECT p.*, mu, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS r FROM p JOIN mu USING (cid))"""
ONE = f"""{RES}, b AS (SELECT *, list_transform(r, lambda x: (x > 0)::INT) AS code FROM r),
s AS (SELECT *, list_transform(code, lambda x: x - 0.5::DOUBLE) AS s FROM b),
t AS (SELECT *, {dot('r', 'r')} AS l2, {dot('r', 's')} AS irs, {dot('mu', 's')} AS ics, {dot('s', 's')} AS s2, {dot('r', 'mu')} AS rm FROM s),
f AS (SELECT *, CASE WHEN irs = 0 THEN 0 ELSE 2 * l2 * ics / irs END + l2 AS f_add, CASE WHEN irs = 0 THEN 0 ELSE -2 * l2 / irs END AS f_rescale,
  1 - rm + CASE WHEN irs = 0 THEN 0 ELSE l2 * ics / irs END AS i_add, CASE WHEN irs = 0 THEN 0 ELSE -l2 / irs END AS i_rescale,
  2 * sqrt(l2) * 1.9 * sqrt(greatest(0, CASE WHEN irs = 0 THEN 0 ELSE l2 * s2 / (irs * irs) END - 1) / (len(r) - 1)) AS f_error FROM t)"""


def _bits_sql(bits: int) -> str:
    top = (1 << bits) - 1
    return f"""{RES}, span AS (SELECT cid, min(list_min(r)) AS lo, max(list_max(r)) AS hi FROM r GROUP BY cid),
z AS (SELECT r.*, lo, CASE WHEN hi > lo THEN (hi - lo) / {top} ELSE 1 END AS scale FROM r JOIN span USING (cid)),
f AS (SELECT *, list_transform(r, lambda x: least({top}, greatest(0, round_even((x - lo) / scale, 0)::INT))) AS code FROM z)"""


def _postings(spark, d) -> DataFrame:
    v = table(spark, d)
    return assign.nearest(v, seeds(v)).select("cid", "vec_id").join(v, "vec_id")


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(f"WITH {ONE} SELECT vec_id, cid, array_to_string(code, ',') AS code FROM f")
def rabitq_codes_1bit(spark, d):
    return quantize.one_bit(_postings(spark, d)).select("vec_id", "cid", _text("code"))


@query(f"WITH {_bits_sql(2)} SELECT vec_id, cid, array_to_string(code, ',') AS code FROM f")
def rabitq_codes_2bit(spark, d):
    return quantize.multi_bit(_postings(spark, d), 2).select("vec_id", "cid", _text("code"))


@query(f"WITH {_bits_sql(4)} SELECT vec_id, cid, array_to_string(code, ',') AS code FROM f")
def rabitq_codes_4bit(spark, d):
    return quantize.multi_bit(_postings(spark, d), 4).select("vec_id", "cid", _text("code"))


@query(f"WITH {_bits_sql(8)} SELECT vec_id, cid, array_to_string(code, ',') AS code FROM f")
def rabitq_codes_8bit(spark, d):
    return quantize.multi_bit(_postings(spark, d), 8).select("vec_id", "cid", _text("code"))


@query(f"WITH {ONE} SELECT vec_id, {r6('f_add')} AS f_add, {r6('f_rescale')} AS f_rescale FROM f")
def rabitq_factors_l2(spark, d):
    return quantize.one_bit(_postings(spark, d)).select("vec_id", M.rounded(F.col("f_add")).alias("f_add"), M.rounded(F.col("f_rescale")).alias("f_rescale"))


@query(f"WITH {ONE} SELECT vec_id, {r6('i_add')} AS f_add, {r6('i_rescale')} AS f_rescale FROM f")
def rabitq_factors_ip(spark, d):
    return quantize.one_bit(_postings(spark, d), "IP").select("vec_id", M.rounded(F.col("f_add")).alias("f_add"), M.rounded(F.col("f_rescale")).alias("f_rescale"))


@query(f"WITH {ONE} SELECT vec_id, {r6('f_error')} AS f_error FROM f")
def rabitq_error_bound(spark, d):
    return quantize.one_bit(_postings(spark, d)).select("vec_id", M.rounded(F.col("f_error")).alias("f_error"))


EST = f"qr AS (SELECT *, list_transform(list_zip(q, mu), lambda p: p[1] - p[2]) AS qr FROM f, q), est AS (SELECT qid, vec_id, cid, greatest(0, f_add + {dot('qr', 'qr')} + f_rescale * ({dot('code', 'qr')} - 0.5 * list_sum(qr))) AS est FROM qr)"


@query(f"WITH {ONE}, {Q_}, {EST} SELECT qid, vec_id, {r6('est')} AS est FROM est")
def rabitq_estimate_1bit(spark, d):
    v = table(spark, d)
    return quantize.estimates(quantize.one_bit(_postings(spark, d)), queries_of(v), 1, digits=6, n=v.count())


DEC = f"list_transform(list_zip(code, mu), lambda p: p[1] * scale + lo + p[2])"  # noqa: F541
EST4 = f"dec AS (SELECT *, {DEC} AS x FROM f), est AS (SELECT qid, q, vec_id, cid, {l2('q', 'x')} AS est FROM dec, q)"


@query(f"WITH {_bits_sql(4)}, {Q_}, {EST4} SELECT qid, vec_id, {r6('est')} AS est FROM est")
def rabitq_estimate_4bit(spark, d):
    v = table(spark, d)
    return quantize.estimates(quantize.multi_bit(_postings(spark, d), 4), queries_of(v), 4, digits=6, n=v.count())


IN_PROBES = "cand AS (SELECT est.*, c_rank FROM est JOIN probes USING (qid, cid) WHERE c_rank <= 4)"


@query(f"WITH {_bits_sql(4)}, {PROBES}, {EST4.replace('qid, q, vec_id', 'q.qid, q, vec_id')}, {IN_PROBES}, found AS (SELECT qid, vec_id, est AS dist FROM cand) {FINAL}")
def ann_quantized_norerank(spark, d):
    index, q = _index(spark, d, replica_count=1, bits=4, rerank=False)
    return dist6(index.search(q, TOP))


@query(f"""WITH {_bits_sql(4)}, {PROBES}, {EST4.replace('qid, q, vec_id', 'q.qid, q, vec_id')}, {IN_PROBES},
o AS (SELECT *, row_number() OVER (PARTITION BY qid, c_rank ORDER BY est, vec_id) AS l FROM cand),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c_rank, l) AS n FROM o) WHERE n <= 60),
found AS (SELECT qid, vec_id, {l2('q', 'v')} AS dist FROM capped JOIN e USING (vec_id)) {FINAL}""")
def ann_quantized_rerank(spark, d):
    index, q = _index(spark, d, replica_count=1, bits=4)
    return dist6(index.search(q, TOP, max_check=60))


#: Postings thinned by the neighbourhood rule, the nearest twenty of each.
THIN = f"{RNG}, p AS (SELECT cid, vec_id, v FROM (SELECT post.cid, vec_id, v, row_number() OVER (PARTITION BY post.cid ORDER BY dist, vec_id) AS pos FROM post JOIN e USING (vec_id)) WHERE pos <= 20)"


@query(f"""WITH {_bits_sql(4).replace('p AS (SELECT cid, vec_id, v FROM near WHERE rank = 1)', THIN)}, {PROBES}, {EST4.replace('qid, q, vec_id', 'q.qid, q, vec_id')}, {IN_PROBES},
o AS (SELECT *, row_number() OVER (PARTITION BY qid, c_rank ORDER BY est, vec_id) AS l FROM cand),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY c_rank, l) AS w FROM o) WHERE w = 1),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c_rank, l) AS n FROM once) WHERE n <= 60),
found AS (SELECT qid, vec_id, {l2('q', 'v')} AS dist FROM capped JOIN e USING (vec_id)) {FINAL}""")
def ann_flagship(spark, d):
    v = table(spark, d)
    index = VectorIndex.build(v, preset("flagship", 64, posting_limit=20, n_probe=4), seeds(v))
    return dist6(index.search(queries_of(v), TOP, max_check=60))


@query(f"WITH {ONE} SELECT count(*) AS n_vectors, sum(4 * len(code))::BIGINT AS vector_bytes, sum(len(code) + 4)::BIGINT AS code_bytes, {r6('1 - sum(len(code) + 4) / sum(4 * len(code))')} AS saved FROM f")
def code_storage(spark, d):
    return evaluate.storage(quantize.one_bit(_postings(spark, d))).withColumn("saved", M.rounded(F.col("saved")))


def _mirror(v: str) -> str:
    """A vector of 64 components, mirrored at the plane across the diagonal."""
    return f"list_transform({v}, lambda x: x - list_sum({v}) / 32)"


_MIRRORED = ONE.replace("p AS (SELECT cid, vec_id, v FROM near WHERE rank = 1)", f"p AS (SELECT 0 AS cid, vec_id, {_mirror('v')} AS v FROM e)").replace("2 * l2 * ics / irs END + l2 AS f_add", "0 END + l2 AS f_add")


@query(f"WITH {_MIRRORED}, {Q_.replace('v AS q', _mirror('v') + ' AS q')}, {EST}, found AS (SELECT qid, vec_id, est AS dist FROM est) {FINAL}")
def rabitq_rotated(spark, d):
    v = table(spark, d)
    return dist6(quantize.rotated(v.withColumn("cid", F.lit(0)), queries_of(v), TOP, turn=np.eye(64) - 1 / 32))


# Graphs and trees over the seeds


GRAPH = f"{E_}, c AS (SELECT vec_id::INT AS cid, v AS c FROM e WHERE vec_id < 64), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst)::INT AS rank FROM (SELECT a.cid AS src, b.cid AS dst, b.c AS v, {l2('a.c', 'b.c')} AS dist FROM c a, c b WHERE a.cid <> b.cid)) WHERE rank <= 12)"


@query(f"WITH {GRAPH} SELECT src, dst, rank, {r6('dist')} AS dist FROM g")
def centroid_knn_graph(spark, d):
    return dist6(graph.knn_graph(seeds(table(spark, d), 64), 12))


@query(f"WITH {GRAPH}, lists AS (SELECT src, list({{'dist': dist, 'id': dst, 'v': v}} ORDER BY dist, dst) AS l FROM g GROUP BY src), kept AS (SELECT src, unnest({fold(6)}) AS x FROM lists) SELECT src, x.id AS dst, {r6('x.dist')} AS dist FROM kept")
def rng_graph(spark, d):
    c = seeds(table(spark, d), 64)
    return dist6(graph.thinned(graph.knn_graph(c, 12), c, 6)).select("src", "dst", "dist")


#: Seeds that a tree or graph finds its way among, and postings that it leads to.
HEADS, LED = 256, 8


def _led(spark, d, search) -> DataFrame:
    """Probes found by ``search(v, x)`` on the driver-size table of seeds, in tasks; their postings hold all vectors."""
    v = table(spark, d)
    q, c = queries_of(v), seeds(v, HEADS)
    ids, x = next(knn.matrix_blocks(c.orderBy("cid"), "cid", "centroid"))
    run = search(c, x)

    def one(batches):
        import pandas as pd

        for b in batches:
            for qid, e in zip(b["qid"], b["embedding"], strict=True):
                rows, dist = run(np.asarray(e, np.float64))
                yield pd.DataFrame({"qid": qid, "q": [e] * len(rows), "cid": ids[rows], "c_rank": np.arange(1, len(rows) + 1, dtype=np.int32), "c_dist": dist})

    probes = q.mapInPandas(one, "qid long, q array<float>, cid int, c_rank int, c_dist double")
    return dist6(plan.top_k(plan.first_met(plan.scored(probes, assign.top_r(v, c, 2), v)), TOP))


#: What a walk that ends nowhere early leads to.
_HEADED = _ann_sql(TWO, probes=f"c_rank <= {LED}").replace(f"vec_id < {K})", f"vec_id < {HEADS})")
#: The same among the seeds that edges lead to from the first.
_EDGES = GRAPH.split("c AS (", 1)[1].replace("vec_id < 64", f"vec_id < {HEADS}").replace("rank <= 12", "rank <= 32").split("g AS (", 1)[1]
_REACHED = f"""g AS ({_EDGES}, lists AS (SELECT src, list({{'dist': dist, 'id': dst, 'v': v}} ORDER BY dist, dst) AS l FROM g GROUP BY src),
kept AS (SELECT src, unnest({fold(16)}) AS x FROM lists), reached AS (SELECT 0 AS cid UNION SELECT x.id FROM reached JOIN kept ON src = cid)"""


@query(_HEADED.replace("WITH ", "WITH RECURSIVE ", 1).replace(", probes AS (", f", {_REACHED}, probes AS (", 1).replace("FROM q, c)", "FROM q, c WHERE cid IN (FROM reached))", 1))
def graph_greedy_search(spark, d):
    def make(c, x):
        g = graph.adjacency(graph.thinned(graph.knn_graph(c, 32), c, 16), len(x))
        return lambda q: graph.greedy(g, x, q, LED)

    return _led(spark, d, make)


@query(_HEADED)
def kdtree_search(spark, d):
    def make(c, x):
        nodes = tree.build_kdt(x)
        return lambda q: tree.search_kdt(nodes, x, q, LED, candidates=len(x))

    return _led(spark, d, make)


@query(_HEADED)
def bkt_rng_search(spark, d):
    def make(c, x):
        nodes = tree.build_bkt(x)
        g = graph.adjacency(graph.thinned(graph.knn_graph(c, 32), c, 16), len(x))
        return lambda q: tree.search_bkt(nodes, x, q, LED, graph=g, leaves=len(x), max_check=len(x))

    return _led(spark, d, make)


# Evaluation


_TRUTH = f"truth AS (SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (SELECT qid, vec_id, {l2('q', 'v')} AS dist FROM q, e)) WHERE rank <= {TOP})"
_RECALL = _ann_sql(TWO, cap="checked <= 60").replace(" SELECT qid, vec_id, rank, round(dist, 6) + 0.0 AS dist FROM", f", {_TRUTH}, got AS (SELECT qid, vec_id FROM") + ")"


@query(f"{_RECALL} SELECT qid, {r6(f'count(got.vec_id) / {TOP}')} AS recall FROM truth LEFT JOIN got USING (qid, vec_id) GROUP BY qid")
def recall_at_k(spark, d):
    index, q = _index(spark, d)
    truth = knn.exact(table(spark, d), q, TOP)
    return evaluate.recall(truth, index.search(q, TOP, max_check=60), TOP).withColumn("recall", M.rounded(F.col("recall")))


_SWEEP = ((4, 64), (8, 256), (16, 4096))


@query(" UNION ALL ".join(f"SELECT {p} AS n_probe, {m} AS max_check, {r6('avg(recall)')} AS recall FROM ({_RECALL.replace('c_rank <= 4', f'c_rank <= {p}').replace('checked <= 60', f'checked <= {m}')} SELECT qid, count(got.vec_id) / {TOP} AS recall FROM truth LEFT JOIN got USING (qid, vec_id) GROUP BY qid)" for p, m in _SWEEP))
def recall_sweep(spark, d):
    index, q = _index(spark, d)
    truth = knn.exact(table(spark, d), q, TOP)
    parts = [evaluate.mean_recall(truth, index.search(q, TOP, n_probe=p, max_check=m), TOP).select(F.lit(p).alias("n_probe"), F.lit(m).alias("max_check"), M.rounded(F.col("recall")).alias("recall")) for p, m in _SWEEP]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT {', '.join(f'round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}' for q in (0.5, 0.9, 0.95, 0.99))}, round(avg(value), 6) AS mean FROM events")
def latency_percentiles(spark, d):
    t = evaluate.latency(spark.read.parquet(f"{d}/events.parquet"), "value")
    return t.select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "mean")])


# Updates


@query("""WITH l AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN (vec_id % 128)::INT ELSE (128 + vec_id % 128)::INT END AS label FROM embeddings)
SELECT vec_id, coalesce(label & 128, 0) <> 0 AS is_deleted, coalesce(label & 127, 0) AS version, coalesce(label, 0) | 128 AS after_delete, coalesce(label & 127, -1) AS after_undelete,
(coalesce(label, 0) & 128) | ((coalesce(label, 0) + 1) & 127) AS after_update, (coalesce(label, 0) & 128) | ((vec_id % 300)::INT & 127) AS after_set FROM l""")
def version_labels(spark, d):
    v = F.col("vec_id")
    df = table(spark, d).select("vec_id", F.when(v % 3 == 0, F.lit(None).cast("int")).when(v % 3 == 1, (v % 128).cast("int")).otherwise((128 + v % 128).cast("int")).alias("label"))
    x = F.col("label")
    return df.select("vec_id", dynamic.is_deleted(x).alias("is_deleted"), dynamic.version(x).alias("version"), dynamic.deleted(x).alias("after_delete"), F.coalesce(dynamic.undeleted(x), F.lit(-1)).alias("after_undelete"), dynamic.bumped(x).alias("after_update"), dynamic.with_version(x, (v % 300).cast("int")).alias("after_set"))


OPS = "ops AS (SELECT event_id AS op_seq, event_id % (SELECT count(*) FROM embeddings) AS vec_id, CASE WHEN event_type = 'click' THEN 'delete' ELSE 'insert' END AS op FROM events)"


@query(f"""WITH {OPS}, l AS (SELECT vec_id, arg_max(op, op_seq) AS last, (count(*) FILTER (op = 'insert'))::INT AS n FROM ops GROUP BY vec_id),
m AS (SELECT embeddings.vec_id, ((coalesce(n, 0) & 127) | CASE WHEN last = 'delete' THEN 128 ELSE 0 END)::INT AS label FROM embeddings LEFT JOIN l USING (vec_id))
SELECT count(*) AS n_total, count(*) FILTER (label & 128 <> 0) AS n_deleted, count(*) FILTER (label & 128 = 0) AS n_active, sum(label)::BIGINT AS label_sum FROM m""")
def label_operations(spark, d):
    v = table(spark, d)
    n = v.count()
    events = spark.read.parquet(f"{d}/events.parquet")
    ops = events.select(F.col("event_id").alias("op_seq"), (F.col("event_id") % n).alias("vec_id"), F.when(F.col("event_type") == "click", "delete").otherwise("insert").alias("op"))
    labels = dynamic.apply_operations(v.select("vec_id", F.lit(0).alias("label")), ops)
    return dynamic.label_counts(labels).join(labels.agg(F.sum("label").alias("label_sum")))


@query(f"WITH {NEAR} SELECT cid, count(*) AS n, count(*) > 80 AS need_split, count(*) < 20 AS need_merge FROM near WHERE rank = 1 GROUP BY cid")
def posting_sizes_split_merge(spark, d):
    v = table(spark, d)
    return dynamic.posting_sizes(assign.nearest(v, seeds(v)), 40)


@query(f"WITH {NEAR} SELECT (SELECT max(vec_id) FROM e) + 1 + vec_id AS vec_id, cid, {r6('dist')} AS dist FROM near WHERE rank = 1 AND vec_id BETWEEN 100 AND 199")
def dyn_insert(spark, d):
    v = table(spark, d)
    top = v.agg(F.max("vec_id")).first()[0]
    new = v.filter(F.col("vec_id").between(100, 199)).withColumn("vec_id", F.col("vec_id") + top + 1)
    return dist6(dynamic.insert(seeds(v), new)).select("vec_id", "cid", "dist")


@query(_ann_sql("SELECT cid, vec_id FROM near WHERE rank <= 2 AND vec_id % 5 <> 0"))
def dyn_delete_search(spark, d):
    index, q = _index(spark, d)
    labels = dynamic.delete(index.vectors.select("vec_id", F.lit(0).alias("label")), index.vectors.filter(F.col("vec_id") % 5 == 0))
    gone = labels.filter(dynamic.is_deleted(F.col("label")))
    return dist6(index.search(q, TOP, deleted=gone))


_SPLIT = [f"{NEAR}", "p AS (SELECT cid, vec_id, v FROM near WHERE rank = 1)", "big AS (SELECT cid AS old, row_number() OVER (ORDER BY cid) - 1 AS i FROM (SELECT cid FROM p GROUP BY cid HAVING count(*) > 2 * ((SELECT count(*) FROM e) // 32)))", "b AS (SELECT cid AS old, i, vec_id, v, row_number() OVER (PARTITION BY cid ORDER BY vec_id) AS n FROM p JOIN big ON old = cid)", "h0 AS (SELECT old, (n - 1)::INT AS side, v AS c FROM b WHERE n <= 2)"]
for _i in range(4):
    _SPLIT.append(f"t{_i} AS (SELECT b.old, any_value(i) AS i, b.vec_id, any_value(v) AS v, arg_min(side, ({l2('v', 'c')}, side)) AS side FROM b JOIN h{_i} ON b.old = h{_i}.old GROUP BY b.old, b.vec_id)")
    if _i < 3:
        _SPLIT.append(f"h{_i + 1} AS (SELECT old, side, list(m ORDER BY pos) AS c FROM (SELECT old, side, pos, avg(x) AS m FROM (SELECT old, side, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t{_i}) GROUP BY old, side, pos) GROUP BY old, side)")
_SPLIT.append(f"moved AS (SELECT old, ({K} + 2 * i + side)::INT AS cid, vec_id, v FROM t3)")
SPLIT = ", ".join(_SPLIT)


def _split(spark, d):
    v = table(spark, d)
    c = seeds(v)
    held = assign.nearest(v, c).select("cid", "vec_id")
    return v, c, held, dynamic.split(c, held, v, v.count() // 32)


@query(f"WITH {SPLIT} SELECT old, cid, vec_id FROM moved")
def dyn_split(spark, d):
    return _split(spark, d)[3][1]


@query(f"""WITH {SPLIT}, fresh AS (SELECT cid, any_value(old) AS old, list(m ORDER BY pos) AS c FROM (SELECT cid, any_value(old) AS old, pos, avg(x) AS m FROM (SELECT old, cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM moved) GROUP BY cid, pos) GROUP BY cid),
allc AS (SELECT cid, c FROM c WHERE cid NOT IN (SELECT old FROM big) UNION ALL SELECT cid, c FROM fresh),
state AS (SELECT cid, vec_id, v FROM p WHERE cid NOT IN (SELECT old FROM big) UNION ALL SELECT cid, vec_id, v FROM moved),
best AS (SELECT vec_id, arg_min(cid, ({l2('v', 'c')}, cid)) AS to_cid FROM e, allc GROUP BY vec_id),
s AS (SELECT state.*, to_cid, allc.c AS own FROM state JOIN best USING (vec_id) JOIN allc ON allc.cid = state.cid),
one AS (SELECT vec_id, s.cid AS from_cid, to_cid FROM s JOIN fresh ON fresh.cid = s.cid JOIN c o ON o.cid = fresh.old WHERE {l2('v', 'o.c')} <= {l2('v', 'fresh.c')} AND to_cid <> s.cid),
nearby AS (SELECT DISTINCT cid FROM (SELECT a.cid, row_number() OVER (PARTITION BY old ORDER BY {l2('o.c', 'a.c')}, a.cid) AS n FROM big JOIN c o ON o.cid = old, allc a) WHERE n <= 24 AND cid NOT IN (SELECT cid FROM fresh)),
two AS (SELECT vec_id, s.cid AS from_cid, to_cid FROM s JOIN fresh ON fresh.cid = to_cid WHERE s.cid IN (SELECT cid FROM nearby) AND {l2('v', 'fresh.c')} <= {l2('v', 'own')})
SELECT * FROM one UNION SELECT * FROM two""")
def dyn_reassign(spark, d):
    v, c, held, (new, moved) = _split(spark, d)
    old = c.select(F.col("cid").alias("old"), F.col("centroid").alias("old_centroid"))
    retired = moved.select(F.col("old").alias("cid")).distinct()
    now = c.join(retired, "cid", "left_anti").unionByName(new.select("cid", "centroid"))
    state = held.join(retired, "cid", "left_anti").unionByName(moved.select("cid", "vec_id"))
    return dynamic.reassign(now, new.join(old, "old"), state, v, 24)


_ARRIVED = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 <> 0
  UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + vec_id - 99, embedding::DOUBLE[] FROM embeddings WHERE vec_id BETWEEN 100 AND 199),
c AS (SELECT vec_id::INT AS cid, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {K})"""
_REASSIGNED = ORACLE_SQL["dyn_reassign"].replace(C_, _ARRIVED).replace("(SELECT count(*) FROM e) // 32", "(SELECT count(*) FROM embeddings) // 32").replace("SELECT * FROM one UNION SELECT * FROM two", ", moves AS (SELECT * FROM one UNION SELECT * FROM two)")

@query(f"""{_REASSIGNED},
held AS (SELECT coalesce(moves.to_cid, state.cid) AS cid, state.vec_id, v FROM state LEFT JOIN moves ON moves.vec_id = state.vec_id),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {EVERY} = 0),
probes AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c_dist, cid)::INT AS c_rank FROM (SELECT qid, q, cid, {l2('q', 'c')} AS c_dist FROM q, allc)),
found AS (SELECT DISTINCT qid, vec_id, {l2('q', 'v')} AS dist FROM probes JOIN held USING (cid) WHERE c_rank <= 4) {FINAL}""")
def dyn_cycle(spark, d):
    """Inserts, deletes, splits with reassignment, and a search, over the stored tables of one index."""
    v = table(spark, d)
    index = DynamicIndex.create(spark, f"{shared_folder(spark)}/dynamic-{uuid.uuid4().hex}", v, seeds(v), target=v.count() // 32, reassign_k=24)
    index.insert(v.filter(F.col("vec_id").between(100, 199)), order="vec_id")
    index.delete(v.filter(F.col("vec_id") % 5 == 0))
    index.maintain()
    return dist6(index.search(queries_of(v), TOP, n_probe=4))


# Sources


def shared_folder(spark) -> str:
    """The folder that the session names for tables that all tasks see; a local one only where all tasks are on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return (path or tempfile.mkdtemp()).rstrip("/")


@query("SELECT vec_id, true AS same FROM embeddings")
def fvecs_roundtrip(spark, d):
    # A format of single files: the folder must be mounted alike everywhere.
    folder = shared_folder(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}.fvecs"
    vecs.write_vecs(table(spark, d), path)
    back = vecs.read_fvecs(spark, path, rows=200)
    return back.join(table(spark, d).withColumnRenamed("embedding", "was"), "vec_id").select("vec_id", (F.col("embedding") == F.col("was")).alias("same"))
