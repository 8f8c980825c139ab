import random

import numpy as np
import pytest

from vecspark.llm import neardup


def plain_set(text, shingle=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(3, 250))]
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(500 + k, f"{passage} " + " ".join(word() for _ in range(k % 9 * 3))) for k in range(200)]
    return rows + [(900, None), (901, " \n"), (902, "One two"), (903, "one  TWO"), (None, "only here " * 4), (None, passage)]


def test_links_every_pair_of_similarity_and_no_other(spark):
    rows = corpus()
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
                links += a != b
    assert links > 50
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    mine, want = {}, {}
    for r in got:
        mine.setdefault(r["_root"], []).append(str(r["doc_id"]))
    for i, (d, _) in enumerate(rows):
        want.setdefault(find(i), []).append(str(d))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_the_pipelines_stage_removes_near_copies(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    words = [f"w{k}" for k in range(120)]
    near, far = list(words), list(words)
    near[30] = near[80] = "x"  # 106 of 126 shingles are shared: 0.84
    for k in range(5, 115, 10):
        far[k] = "x"
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, near, far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_sketches_lose_no_similar_pair():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1, 400)
        own = [rng.getrandbits(64) for _ in range(n)]
        other = own[: n - rng.randrange(n // 4 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(n // 4 + 1))]
        a, b = (np.unique(np.array(v, np.uint64)) for v in (own, other))
        if neardup.similar(a, b, 0.8):
            assert neardup.may_be_similar(neardup.sketch(a), len(a), neardup.sketch(b), len(b), 0.8)
