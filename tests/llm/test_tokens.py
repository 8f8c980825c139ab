import zlib

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from vecspark.llm import packing, tokencount, tokenfile  # noqa: E402
from vecspark.llm.shared import Workspace  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ROWS = [(5, "The end. The end", "x"), (1, None, "x"), (3, "", "x"), (None, "no id", "x"), (3, "a  b\n\nc <|endoftext|> d", "y"), (9, "long word, " * 4000, "z"), (5, "The end. The end", "x")]
SCHEMA = "doc_id long, text string, n_tokens string"


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    got = tokencount.token_counts(spark.createDataFrame(ROWS, SCHEMA), BYTES, limit=5).collect()
    want = [(i, len((t or "").encode()), n := len(ids_of(BYTES, t)), n > 5) for i, t, _ in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA), BYTES).collect() == []


def test_files_round_trip(spark):
    for block in (1 << 22, 8):
        work = Workspace(spark, "test")
        tokenfile.write_token_files(spark.createDataFrame(ROWS, SCHEMA), f"{work.path}/ids", BYTES, end_id=2, block_ids=block)
        got = tokenfile.read_token_files(spark, f"{work.path}/ids", with_ids=True).collect()
        place = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # as a signed number
        order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, place(r[1])))
        want, start = [], 0
        for i, t, _ in order:
            own = np.array(ids_of(BYTES, t) + [2], "<u4").tobytes()
            want.append((i, start, len(own) // 4, zlib.crc32(own), own))
            start += len(own) // 4
        assert [tuple(r[:4]) + (bytes(r[4]),) for r in sorted(got, key=lambda r: r["start"])] == want
    tokenfile.write_token_files(spark.createDataFrame([], SCHEMA), f"{work.path}/none", BYTES)
    assert tokenfile.read_token_files(spark, f"{work.path}/none").collect() == []


def test_one_id_that_most_rows_share_is_dealt_to_several_shards(spark):
    rows = [(7, f"text {k % 90}", "x") for k in range(900)] + [(None, "same", "x")] * 300 + [(9, "z", "x")]
    work = Workspace(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one shard
    try:
        tokenfile.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(5), f"{work.path}/ids", BYTES)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_shard = {r["shard"]: r["n"] for r in spark.read.parquet(f"{work.path}/ids").selectExpr("shard", "size(doc_ids) as n").collect()}
    assert sum(by_shard.values()) == 1201 and max(by_shard.values()) < 700
    got = sorted(tokenfile.read_token_files(spark, f"{work.path}/ids").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [7] * 900 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("ids", [[], [7], [0, 0, 5], list(range(300)) * 2, list(range(70000)), [2**32 - 1, 1, 2**31], list(np.random.default_rng(1).integers(0, 1 << 20, 5001))])
def test_block_coding(ids):
    block = tokenfile.encode_block(np.array(ids, np.uint32))
    assert tokenfile.decode_block(block).tolist() == [int(i) for i in ids]
    with pytest.raises(ValueError):
        tokenfile.decode_block(b"none" + block[4:])


def test_pieces_and_packing(spark):
    pieces = packing.token_pieces(spark.createDataFrame(ROWS, SCHEMA), WORDS, capacity=100, end_id=1)
    got = packing.pack(pieces, capacity=100).collect()
    want = []
    for i, t, _ in ROWS:
        own = ids_of(WORDS, t) + [1]
        want += [(i, k // 100, k, len(own[k : k + 100]), np.array(own[k : k + 100], "<u4").tobytes()) for k in range(0, len(own), 100)]
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(want, key=str)
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 100)
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], SCHEMA), WORDS), 4096).collect() == []


def check_places(places, capacity):
    by = {}
    for s, o, n in places:
        by.setdefault(s, []).append((o, n))
    for row in by.values():
        at = 0
        for o, n in sorted(row):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_close_to_the_bound(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in np.clip(rng.lognormal(4, 1, 3000), 1, 512)] + [77] * 1500
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "k long, length long").repartition(5)
    got = packing.pack(df, 512).collect()
    assert len(got) == len(lengths)
    bins = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 512)
    assert bins <= 1.005 * sum(lengths) / 512 + 1


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        gap = int(rng.integers(1, 60))
        used = packing.fullest(counts, sorted(counts, reverse=True), gap)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= gap)
        assert all(n <= counts[k] for k, n in used.items())


def test_wrong_lengths_are_refused(spark):
    for bad in (0, 11, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "k long, length long"), 10)


def test_columns_with_the_operators_names(spark):
    names = ["offset", "sequence_id", "_length", "_n", "_base", "_p", "_rank", "_place", "_part", "_row", "_c0", "a.b"]
    df = spark.createDataFrame([(7, *range(12))], "n long, " + ", ".join(f"`{c}` int" for c in names))
    got = packing.pack(df, 10, length_col="n").collect()
    assert [r.asDict() for r in got] == [{"n": 7, **dict(zip(names, range(12))), "sequence_id": 0, "offset": 0}]
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, _id string, ids string, length string")
    assert packing.token_pieces(docs, WORDS).columns == ["doc_id", "piece", "start", "length", "ids"]
    work = Workspace(spark, "test")
    tokenfile.write_token_files(docs.withColumn("shard", docs["_id"]), f"{work.path}/ids", BYTES)
    assert tokenfile.read_token_files(spark, f"{work.path}/ids").count() == 1
