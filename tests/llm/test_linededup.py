import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vecspark.llm import linededup

SCHEMA = "doc_id long, text string, n_lines string, removed_lines string"


def split_words(line):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """Each document's kept text: no line that an earlier one equals, none of five words or more within one edit of one."""
    seen, exact, out = [], set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        keep = []
        for line in (text or "").split("\n"):
            w = split_words(line)
            near = len(w) >= 5 and any(abs(len(w) - len(s)) < 2 and edits(w, s) <= 1 for s in seen)
            if not w or (tuple(w) not in exact and not near):
                keep.append(line)
            exact.add(tuple(w))
            if len(w) >= 5:
                seen.append(w)
        out[i] = None if text is None else "\n".join(keep)
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(6 if seed % 2 else 60)}" for _ in range(rng.randrange(3, 12))] for _ in range(15)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                how = rng.randrange(3)
                if how == 0:
                    w.insert(k, f"n{rng.randrange(9)}")
                elif w and how == 1:
                    w.pop(k % len(w))
                elif w:
                    w[k % len(w)] = f"n{rng.randrange(9)}"
            lines.append(rng.choice([" ", "  ", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
        rows.append((d, "\n".join(lines)))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (93, "short line\nshort line"), (94, "x " * 3000), (95, "x " * 2999 + "y"), (96, "é è ê ë ē\nÉ è ê ë o")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_matches_brute_force_and_sql(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(3)
    got = linededup.dedup_lines(df)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(rows)
    documents = df.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) < 5000).toPandas()  # noqa: F841  the SQL makes n * n characters of a line
    short = linededup.dedup_lines(df.filter(F.coalesce(F.length("text"), F.lit(0)) < 5000))
    want = duckdb.connect().execute(linededup.ORACLE).fetchdf()
    mine = short.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.md5("text").alias("text_md5")).toPandas()
    key = lambda x: sorted(tuple(None if v is None or v != v else v for v in r) for r in x.itertuples(index=False))
    assert key(mine) == key(want)


def test_a_variant_that_many_lines_share(spark):
    rows = [(d, f"this is page number {d} of many pages") for d in range(400)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["text"]) == [0]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    line = "a line of five words"
    rows = [(2, line), (2, line), (None, line), (7, f"{line}\nkept"), (7, "other text of this same id")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(2, ""), (2, ""), (None, line), (7, "kept"), (7, "other text of this same id")], key=str)
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_within_one(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("ab") for _ in range(rng.randrange(5))], [rng.choice("ab") for _ in range(rng.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.withColumn("near", linededup.within_one(F.col("a"), F.col("b"))).collect():
        assert r["near"] == (edits(r["a"], r["b"]) <= 1), r


def test_exact_repeats_of_short_lines(spark):
    rows = [(1, "Les.\n\nAll rights reserved."), (2, "les.\n\nall  rights RESERVED.\nAll rights\na line of five words"), (3, "Les\n \na line of six words\nAll rights")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: "\nAll rights\na line of five words", 3: "Les\n "}


def test_chains_of_prefixes(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = [(n, base[:n]) for n in (1, 5, 63, 64, 65, 127, 128, 129, 300, 400)] + [(-k, base[:k] + ["other"] + base[k + 1 :]) for k in (0, 63, 64, 200)]
    df = spark.createDataFrame([(n, w) for n, w in rows], "n int, w array<string>")
    got = {r["n"]: r["c"] for r in df.select("n", linededup._chain(F.col("w")).alias("c")).collect()}
    for n, c in got.items():
        same = n + len(base) * 0 if n > 0 else -n
        assert len(c) == (n if n > 0 else 400) + 1
        assert c[: same + 1] == got[400][: same + 1] and (n > 0 or not set(c[same + 1 :]) & set(got[400][same + 1 :]))
    assert len(set(got[400])) == 401


def test_a_line_of_very_many_words(spark):
    words = [f"w{k % 9973}" for k in range(200_000)]
    near, far = list(words), list(words)
    near[150_000] = "x"
    far[3] = far[199_999] = "x"
    rows = [(k, " ".join(w)) for k, w in enumerate((words, near, far))]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] == "" for r in got} == {0: False, 1: True, 2: False}


def test_a_document_of_very_many_candidate_lines(spark):
    lines = [f"line {k} of a very long document {k}" for k in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(f"{x} more" for x in lines))]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: len(r["text"]) for r in got} == {1: len(rows[0][1]), 2: 0}


def test_columns_with_the_operators_names(spark):
    rows = [(k, "one line of five words", f"a{k}", f"b{k}", k, k) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _removed string, _id string, _c0 int, `n.lines` int")
    got = sorted(map(tuple, linededup.dedup_lines(df).select("doc_id", "text", "_removed", "_id", "_c0", "`n.lines`").collect()))
    assert got == [(k, "" if k else "one line of five words", f"a{k}", f"b{k}", k, k) for k in range(3)]


def test_documents_that_are_repeated_very_often(spark):
    rows = [(7, "a first line of many words\nsecond line of the very same text")] * 500 + [(8, "a first line of more words")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted({(r["doc_id"], r["text"]) for r in got}) == [(7, rows[0][1]), (8, "")] and len(got) == 501
