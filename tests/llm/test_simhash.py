import re

import numpy as np
import pytest
import xxhash

from vecspark.llm import simhash
from vecspark.llm.shared import Workspace


def plain_fingerprint(text, shingle):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, max_bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in order}


TEXTS = ["", "   \t\n", "one", "One Two three", "A b c d e f", "a b c d e f", "a b\nc\td e f", "ä Ä ß x y z", "w " * 3000, None, "x\x1cy z q r s"]


@pytest.mark.parametrize("shingle", [4, 5])
def test_fingerprints_and_components_match_brute_force(spark, shingle):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 300)) for _ in range(6)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(12):
            words = b.split()
            for k in rng.integers(0, len(words), rng.integers(0, 4)):
                words[k] = f"n{rng.integers(1000)}"
            texts.append(" ".join(words))
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x"), (4, "one", "y"), (None, "only null " * 9, "z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"), shingle=shingle, max_bits=4).collect()
    fps = {t: plain_fingerprint(t, shingle) for _, t, _ in rows}
    comp = plain_components(set(fps.values()), 4)
    least = {}
    for i, t, _ in rows:
        r = comp[fps[t]]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{fps[t]:016x}", least[comp[fps[t]]]) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len({x[2] for x in want}) < len(rows) - 20  # near copies were linked


@pytest.mark.parametrize("max_bits", [0, 2, 3, 4, 5])
def test_links_lose_nothing(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    fps = set()
    for _ in range(40):
        f = int(rng.integers(0, 2**63))
        for _ in range(8):
            g = f
            for b in rng.integers(0, 64, rng.integers(0, max_bits + 3)):
                g ^= 1 << int(b)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "_fp long")
    want = plain_components(fps, max_bits)
    for block in (1 << 16, 64):  # the second deals keys out to blocks
        work = Workspace(spark, "test")
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, max_bits, work, block=block), work).collect()}
        got = {}
        for f, s in zip(fps, signed, strict=True):
            got.setdefault(roots.get(s, s), set()).add(f)
        groups = {}
        for f, r in want.items():
            groups.setdefault(r, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_hot_keys_are_dealt_to_blocks(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {base})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    work = Workspace(spark, "test")
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "_fp long"), 4, work, block=64)
    assert not spark.read.parquet(f"{work.path}/hot").isEmpty()
    roots = simhash.components(edges, work).collect()
    assert len(roots) == len(fps) and len({r["root"] for r in roots}) == 1


@pytest.mark.parametrize("max_bits", [4, 12, 28])
def test_ring_chains_lose_no_fingerprint(max_bits):
    rng = np.random.default_rng(max_bits)
    x = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 40, 3000)]
    want = [v.bit_count() <= max_bits for v in x]
    assert simhash.ring_near(np.array(x, np.uint64), max_bits).tolist() == want
    assert simhash.ring_near(np.zeros(0, np.uint64), max_bits).tolist() == []


def test_empty_table_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id long")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, "q"), (None, None), (None, "")], "doc_id long, text string")
    groups = simhash.near_duplicates(docs, roots=True)
    kept = simhash.one_of_each(docs, groups).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a b c d e f"), (3, "q"), (None, None)], key=str)


def test_one_of_each_keeps_every_component_of_null_and_shared_ids(spark):
    texts = ["a b c d e f", "g h i j k l m", "n o p q r s t u", "v w x y z"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3].upper()), (5, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs, roots=True)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=str)


def test_the_pipelines_stage_keeps_unrelated_documents_of_one_id(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None if i % 2 else 7, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(12)], "doc_id long, text string")
    assert sorted(corpus_pipeline.near_dedup(spark, docs, "").collect(), key=str) == sorted(docs.collect(), key=str)
