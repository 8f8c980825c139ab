import os
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from tests.llm.test_linededup import brute as dedup  # noqa: E402
from tests.llm.test_mixing import brute as mixed  # noqa: E402
from tests.llm.test_neardup import plain_set  # noqa: E402
from tests.llm.test_tokens import check_places, ids_of  # noqa: E402
from vecspark.llm import mixing  # noqa: E402
from vecspark.llm.queries import LEVELS, WEIGHTS  # noqa: E402
from vecspark.llm.shared import shared_dir  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6, 30)))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(240):
        lines = [line() for _ in range(rng.randrange(1, 6))]
        if i % 5 == 0:
            lines.append(rng.choice(shared))
        text = "\n".join(lines)
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 40 == 7:
            text = rows[-3][1]
        rows.append((i, text, rng.choice(["en", "fr"]), "src0" if i % 3 else f"src{rng.randrange(5)}", len(text)))
    rows += [(500, None, "en", "src1", None), (501, "", None, None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(240) if i % 40 != 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


class Rows:
    """Collected rows that are asked as a table is."""

    def __init__(self, rows, columns):
        self.rows, self.columns = rows, columns

    def collect(self):
        return self.rows


def test_each_stage_matches_brute_force(spark, folder):
    path, rows = folder
    own = ("domain", "epoch", "n_lines", "removed_lines", "score", "_id", "_th", "_text", "_root", "_c0", "_keep", "f_words", "component_id", "a.b")
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"concat('{c}-', doc_id) as `{c}`" for c in own])
    run = [f for _, f in corpus_pipeline.STAGES]
    assert len(run) == 5

    def whole(f):
        """The stage, its columns looked at: they are those of its input, whatever their names."""

        def g(*a):
            out = f(*a)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in own)
            return Rows(rows, out.columns)

        return g

    stages = [*map(whole, run[:-1]), run[-1]]

    kept = stages[0](spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = [i for i in range(240) if i % 6 and i % 40 != 7]
    assert len(ids & set(good)) >= 0.97 * len(good)
    assert not ids & {i for i in range(0, 240, 6) if i % 40 != 7}

    lines = stages[1](spark, docs, path)
    want = dedup([(r[0], r[1]) for r in rows])
    want = {i: t for i, t in want.items() if t is None or t.strip() or not dict((r[0], r[1]) for r in rows)[i].strip()}
    got = lines.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and lines.columns == docs.columns
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)

    one = stages[2](spark, docs, path)
    sets, least = {r[0]: plain_set(r[1]) for r in rows}, {}
    for i in sorted(sets):
        near = [least[j] for j in least if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        least[i] = min(near, default=i)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(least.values())) and one.columns == docs.columns

    mix = stages[3](spark, docs, path)
    leaf = [(r[0], f"domain{zlib.crc32((r[3] or '').encode()) % 4}", r[2], r[3], len(ids_of(P.path(corpus_pipeline.VOCABULARY), r[1])), 0) for r in rows]
    want = mixed(leaf, mixing.weights(WEIGHTS, LEVELS), 1.0, 2, 11)
    assert sorted(str(r["doc_id"]) for r in mix.collect()) == sorted(str(i) for i, _ in want) and mix.columns == docs.columns

    packed = stages[4](spark, docs, path).collect()
    want = []
    for i, text, *_ in rows:
        own = np.array(ids_of(P.path("word_bpe_49k.json"), text) + [1], "<u4")
        want += [(i, k // 4096, k, len(own[k : k + 4096]), zlib.crc32(own[k : k + 4096].tobytes())) for k in range(0, len(own), 4096)]
    assert sorted(tuple(r[:5]) for r in packed) == sorted(want)
    bins = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in packed], 4096)
    assert bins == -(-sum(w[3] for w in want) // 4096)


def test_run_chains_the_stages_and_leaves_only_its_result(spark, folder):
    path, rows = folder
    before = set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    got = corpus_pipeline.run(spark, path).collect()
    new = [d for d in set(os.listdir(shared_dir(spark))) - before if os.path.isdir(f"{shared_dir(spark)}/{d}")]
    assert len(new) == 1 and os.listdir(f"{shared_dir(spark)}/{new[0]}") == ["stage4"]
    held = {r["doc_id"] for r in got}
    assert held <= {r[0] for r in rows} and not held & {i for i in range(0, 240, 6) if i % 40 != 7} and len(held) > 100
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)


def test_stages_on_repeated_rows_and_empty_tables(spark, folder):
    path, _ = folder
    row = (3, "a line of five words", "en", "src0", 20, "x")
    twice = spark.createDataFrame([row, row, (None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, epoch string")
    # Lines of a copy go with those of its twin; one of each group stays; the budget is all tokens once, and a
    # null text has none; each row is a piece.
    for (_, f), n in zip(corpus_pipeline.STAGES[1:], (3, 2, 2, 3), strict=True):
        assert len(f(spark, twice, path).collect()) == n
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, twice.limit(0), path).collect() == []
