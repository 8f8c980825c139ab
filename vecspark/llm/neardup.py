"""SimHash near-duplicates of a wanted similarity: rare shingles as keys, fingerprints prune, every candidate checked.

Two sets whose Jaccard similarity is ``t`` or more share one of the first ``n - ceil(t * n) + 1`` shingles
in any order that is the same for all sets. So sets meet by those keys, and no pair is lost. Shingles
that a sample finds common come last in the order, which only sets how many candidates there are.

Candidates are pruned by their SimHash fingerprints before they leave a key: chains of bytes within their
budgets, then the full Hamming check, at ``PRUNE_BITS`` of 64. Fingerprints of sets of similarity 0.8 differ in 10
bits on average (12 for sets of four and five), so that a pair is lost with a chance under 1e-7; of
unrelated pairs four in five go. Parity sketches, which lose no pair, prune again; then the sets are compared.

Pairs are made in two steps, so that a dense group costs few rows: every set with one other of each key;
then, for keys whose sets are not in one component by then, all pairs between different components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace, small
from vecspark.llm.simhash import SEED, components, hexed, majority, ring_near
from vecspark.llm.textunits import released

#: Differing bits of fingerprints up to which candidates stay.
PRUNE_BITS = 28

#: A similarity this far under the threshold by rounding still counts.
EPS = 1e-9


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles (words as in ``simhash``); a shorter text is one shingle."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)), np.uint64, n))


def prefix(own: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The shingles by which a set is searched; the sorted ``common`` ones come last."""
    n = len(own)
    if n and len(common):
        last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate([own[~last], own[last]])
    return own[: n - math.ceil(least * n - EPS) + 1]


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the shingles in at least as many bits as there are shingles, a power of two: half of it folds on the other."""
    bits = 1 << max(6, (max(1, len(own)) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def may_be_similar(a: np.ndarray, n: int, b: np.ndarray, m: int, least: float) -> bool:
    """False only for sets under ``least``: sketches differ in at most as many bits as the sets in shingles."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (1 + least) <= (n + m) * (1 - least) + EPS


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - EPS


def _common(texts: DataFrame, shingle: int, work: Workspace, most: int = 1 << 19) -> np.ndarray:
    """Shingles that come in 8 or more of a sixteenth of the texts; the rarer ones are left out if there are more than ``most``."""

    def each(batches):
        for b in released(batches):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["s"])

    taste = texts.filter(F.pmod(F.col("_th"), F.lit(16)) == 0).dropDuplicates(["_th"]).select("_text").mapInArrow(each, "s long")
    seen, n = work.stage(taste.groupBy("s").agg(F.count("*").alias("n")).filter("n >= 8"), "common"), 8
    while seen.filter(F.col("n") >= n).count() > most:
        n *= 2
    return np.sort(np.array([r[0] for r in seen.filter(F.col("n") >= n).select("s").collect()], np.int64).view(np.uint64))


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id, _th, _root)`` of every document, as ``simhash.one_of_each`` asks for.

    Documents whose shingle sets have a Jaccard similarity of ``least`` (0.8 or more: the pruning is made for
    that) are linked; a null text and one without a word are the same. ``component_id`` is the smallest id
    reachable; null ids are smallest only where a component has no other. Repeated rows are returned as they
    are, other columns are not carried. Empty table: empty result.
    """
    if least < 0.8:
        raise ValueError("least must be 0.8 or more")
    work = Workspace(docs.sparkSession, "neardup")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.coalesce(text_col, F.lit("")).alias("_text"))
    common = _common(texts, shingle, work)
    kind = docs.schema[id_col].dataType.simpleString()

    def sets(batches):
        import xxhash

        for b in released(batches):
            own = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in own], np.uint64).view(np.int64)
            keys = pa.array([prefix(s, least, common).view(np.int64) for s in own], pa.list_(pa.int64()))
            bits = pa.array([sketch(s).tobytes() for s in own], pa.binary())
            fp = pa.array(np.array([majority(s) for s in own], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in own], pa.int32()), fp, keys, bits], names=["_id", "_th", "_node", "_n", "_fp", "_keys", "_bits"])

    held = work.stage(texts.mapInArrow(sets, f"_id {kind}, _th long, _node long, _n int, _fp long, _keys array<bigint>, _bits binary"), "sets")
    nodes = work.stage(held.groupBy("_node").agg(F.min("_id").alias("_least"), F.min("_th").alias("_t")), "nodes")
    first = held.select("_node", "_id", "_th", "_n", "_bits").join(nodes.select(F.col("_node").alias("_f"), "_t"), (F.col("_node") == F.col("_f")) & (F.col("_th") == F.col("_t")))
    sketches = work.stage(first.select("_node", "_n", "_bits").dropDuplicates(["_node"]), "sketches")
    keyed = held.dropDuplicates(["_node"]).select(F.explode("_keys").alias("key"), F.col("_node").alias("node"), F.col("_n").alias("n"), F.col("_fp").alias("fp"))

    def meet(batches):
        rest = [np.zeros(0, np.int64)] * 4
        for b in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, b.columns, strict=True)]
            if len(cols[0]):
                end = int(np.searchsorted(cols[0], cols[0][-1]))  # more of the last key may come
                rest = [c[end:] for c in cols]
                yield from groups([c[:end] for c in cols])
        yield from groups(rest)

    def groups(cols):
        """Rows of keys that several sets have, each with one set of its key (four choices, by the key)."""
        key, node, n, fp = cols
        if not len(key):
            return
        order = np.lexsort(((node ^ (key & 3)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * (2 * (key & 3) + 1).view(np.uint64), key))
        key, node, n, fp = key[order], node[order], n[order], fp[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        head, many = np.repeat(begin, size), np.repeat(size, size) > 1
        near = np.minimum(n, n[head]) >= least * np.maximum(n, n[head]) - EPS
        near &= ring_near((fp ^ fp[head]).view(np.uint64), PRUNE_BITS)
        at = np.where(near, node[head], node)
        yield pa.RecordBatch.from_arrays([pa.array(v[many]) for v in (key, node, n, fp, at)], names=["key", "node", "n", "fp", "head"])

    met = work.stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key long, node long, n long, fp long, head long"), "met")

    def whole(batches):
        for b in released(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "set"])

    def check(batches):
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def rough(batches):
        for b in batches:
            x, n, y, m = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            good = [may_be_similar(np.frombuffer(p, np.uint8), i, np.frombuffer(q, np.uint8), j, least) for p, i, q, j in zip(x, n, y, m, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones; only pairs whose sketches allow it have their texts read again."""
        one, other = (sketches.select(F.col("_node").alias(f"n{k}"), F.col("_bits").alias(f"s{k}"), F.col("_n").alias(f"c{k}")) for k in (1, 2))
        sides = pairs.join(one, F.col("a") == F.col("n1")).join(other, F.col("b") == F.col("n2")).select("a", "b", "s1", "c1", "s2", "c2")
        open_pairs = work.stage(sides.mapInArrow(rough, "a long, b long"), f"{name}-rough")
        ends = open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct()
        wanted = work.stage(nodes.join(ends, nodes["_node"] == ends["node"], "left_semi").select("_t", "_node"), f"{name}-wanted")
        full = texts.join(small(wanted, 24), F.col("_th") == F.col("_t")).select("_node", "_text").groupBy("_node").agg(F.first("_text").alias("_text"))
        full = work.stage(full.mapInArrow(whole, "node long, set binary"), f"{name}-full")
        one, other = (full.select(F.col("node").alias(f"n{k}"), F.col("set").alias(f"s{k}")) for k in (1, 2))
        sides = open_pairs.join(one, F.col("a") == F.col("n1")).join(other, F.col("b") == F.col("n2")).select("a", "b", "s1", "s2")
        return work.stage(sides.mapInArrow(check, "a long, b long"), name)

    pairs = met.filter("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    edges = verified(pairs, "edges")
    roots = components(edges, work)
    placed = met.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select("key", "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    placed = work.stage(placed, "placed")
    unsettled = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(F.col("key").alias("k"))
    work.drop("met")
    left = work.stage(placed.join(unsettled, F.col("key") == F.col("k"), "left_semi"), "left")
    other = left.select(F.col("key").alias("k"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("fp").alias("fq"), F.col("root").alias("r"))
    across = left.join(other, (F.col("key") == F.col("k")) & (F.col("node") > F.col("b")) & (F.col("root") != F.col("r")))
    across = across.filter((F.least("n", "m") >= least * F.greatest("n", "m") - EPS) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= PRUNE_BITS)).select(F.col("node").alias("a"), "b").distinct()
    more = verified(across, "more")
    if not more.isEmpty():
        both = Workspace(docs.sparkSession, "neardup")
        roots = components(edges.union(more), both)

    rooted = nodes.join(roots, nodes["_node"] == roots["node"], "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
    least_id = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = work.stage(rooted.join(least_id, "_root").select(F.col("_node").alias("_f"), "component_id", "_root"), "components")
    work.keep("sets", "components")
    return held.join(named, F.col("_node") == F.col("_f")).select(F.col("_id").alias(id_col), hexed(F.col("_fp")).alias("fingerprint"), "component_id", "_th", "_root")
