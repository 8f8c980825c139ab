import hashlib
import random

import pytest

from vecspark.llm import mixing

LEVELS = ["domain", "lang", "source"]


def brute(rows, weight, share, epochs, seed):
    """(id, epoch) of every document taken, leaf by leaf in its seeded orders."""
    leaves = {}
    for i, *path, n, _ in rows:
        leaves.setdefault(tuple(path), []).append((i, n or 0))
    have = {p: sum(n for _, n in d) for p, d in leaves.items()}
    got = mixing.budgets({p: float(n * epochs) for p, n in have.items()}, weight, share * sum(have.values()))
    out = []
    for p, d in leaves.items():
        want = min(int(got[p] + 0.5), have[p] * epochs)
        left, e = want, 0
        while left > 0:
            key = lambda x: hashlib.md5(f"{seed}|{e}|{'null' if x[0] is None else x[0]}".encode()).hexdigest()  # noqa: B023, E731
            for i, n in sorted(d, key=key):
                if left <= 0:
                    break
                out.append((i, e))
                left -= n
            e += 1
        out += [(i, k) for i, n in d for k in range(want // have[p] if have[p] else 0) if (i, k) not in out]
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [(1.0, 2), (0.5, 1), (3.0, 4), (0.01, 1)])
def test_matches_brute_force(spark, share, epochs):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.4
        rows.append((i, "d0" if hot else rng.choice(["d0", "d1", None]), "en" if hot else rng.choice(["en", "fr"]), "s0" if hot else f"s{rng.randrange(4)}", rng.randrange(1, 200), "x"))
    weight = mixing.weights({"domain": {"d0": 1.0, "d1": 5.0}, "lang": {"en": 3.0}}, LEVELS)
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, epoch string").repartition(3)
    got = mixing.mix(df, LEVELS, weight, share, epochs, seed=9).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == brute(rows, weight, share, epochs, 9)
    want = min(share, epochs) * sum(r[4] for r in rows)
    assert want - 30 <= sum(r["n_tokens"] for r in got) <= want + 200 * 24


def test_shortages_go_to_siblings_before_ancestors():
    leaves = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 1000.0}
    got = mixing.budgets(leaves, lambda p: 1.0, 160.0)
    assert got == {("a", "x"): 10.0, ("a", "y"): 70.0, ("b", "z"): 80.0}
    got = mixing.budgets(leaves, lambda p: 1.0, 400.0)
    assert got == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 290.0}
    assert sum(mixing.budgets(leaves, lambda p: 1.0, 1e9).values()) == 1110.0


def test_shares_without_weight_and_caps():
    assert mixing.share_out(10, [0, 1], [5, 4]) == [5, 4]
    assert mixing.share_out(6, [0, 1], [5, 4]) == [2, 4]
    assert mixing.share_out(6, [1, 2], [9, 9]) == [2, 4]
    assert mixing.share_out(0, [1], [9]) == [0.0]


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (None, None, None, None, 5), (2, "d", "l", "s", None), (3, "d", "l", "s", 0), (4, "e", "l", "s", 7), (4, "e", "l", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    got = mixing.mix(df, LEVELS, lambda p: 1.0, 1.0, 1).collect()
    assert sorted((str(r["doc_id"]), r["epoch"]) for r in got) == [("1", 0), ("4", 0), ("4", 0), ("None", 0)]
    assert mixing.mix(df.limit(0), LEVELS, lambda p: 1.0).collect() == []


def test_columns_with_the_operators_names(spark):
    rows = [(k, "d", "l", "s", 5, f"w{k}", f"c{k}", f"r{k}", k, k) for k in range(6)]
    schema = "doc_id long, domain string, lang string, source string, n_tokens long, whole string, cut string, rest string, _whole int, _c0 int"
    got = mixing.mix(spark.createDataFrame(rows, schema), LEVELS, lambda p: 1.0, 1.0, 1).collect()
    assert sorted(tuple(r)[:-1] for r in got) == rows and {r["epoch"] for r in got} == {0}
    odd = spark.createDataFrame([(1, "a", "b", 3)], "doc_id long, n string, `rest` string, n_tokens long")
    assert [r["n"] for r in mixing.mix(odd, ["n", "rest"], lambda p: 1.0).collect()] == ["a"] * 1
