"""Mixing sources to target weights: hierarchical budgets over a tree, and seeded epochs of each leaf."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace, hide, quoted, show, small

#: Leaves are a catalogue of sources, not documents; more than this is taken for a mistake.
MAX_LEAVES = 1_000_000


def share_out(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``budget`` by weight, none over its cap; what a capped one leaves goes to the others by weight."""
    got, left, open_ = [0.0] * len(caps), min(budget, sum(caps)), [k for k, c in enumerate(caps) if c > 0]
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        even = total <= 0  # only those without weight are left to take the rest
        part = {k: left / len(open_) if even else left * weights[k] / total for k in open_}
        full = [k for k in open_ if part[k] >= caps[k]]
        if not full:
            for k in open_:
                got[k] = part[k]
            break
        for k in full:
            got[k] = caps[k]
            left -= caps[k]
        open_ = [k for k in open_ if k not in set(full)]
    return got


def budgets(leaves: dict[tuple, float], weight: Callable[[tuple], float], budget: float) -> dict[tuple, float]:
    """Budget of each leaf of a tree whose leaves are paths; ``leaves`` holds what each can give.

    A node's budget is shared among its children by ``weight(path)``. A child that can't give its share
    leaves the rest to its siblings; only what none of them can give goes to the siblings of their parent.
    """
    out: dict[tuple, float] = {}

    def down(prefix: tuple, paths: list[tuple], amount: float) -> None:
        if len(paths) == 1 and paths[0] == prefix:
            out[prefix] = amount
            return
        children: dict[tuple, list[tuple]] = {}
        for p in paths:
            children.setdefault(p[: len(prefix) + 1], []).append(p)
        names = sorted(children, key=str)
        caps = [sum(leaves[p] for p in children[c]) for c in names]
        for c, got in zip(names, share_out(amount, [weight(c) for c in names], caps), strict=True):
            down(c, children[c], got)

    down((), sorted(leaves, key=str), min(budget, sum(leaves.values())))
    return out


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    """Place of a document in an epoch of its leaf: 32 hexadecimal digits, in their order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))


def _edge_part(keyed: DataFrame, levels: list[str], digits: int, work: Workspace) -> DataFrame:
    """Rows of the part of each leaf (by the key's first digits) that reaches ``rest``; ``_before`` counts the tokens before it."""
    part = F.substring("_key", 1, digits)
    before = Window.partitionBy(*levels).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy(*levels, part.alias("_part")).agg(F.sum("_tokens").alias("n"), F.max("rest").alias("rest"), F.max("_before").alias("base"))
    parts = parts.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = parts.filter("before < rest AND before + n >= rest").groupBy(*levels).agg(F.min(F.struct("_part", "before")).alias("e"))
    names = {c: f"_e{k}" for k, c in enumerate(levels)}
    edge = work.stage(edge.select(*[F.col(c).alias(e) for c, e in names.items()], F.col("e._part").alias("_ep"), F.col("e.before").alias("_eb")), f"edge{digits}")
    held = keyed.join(small(edge, 128), [F.col(c).eqNullSafe(F.col(e)) for c, e in names.items()] + [part == F.col("_ep")])
    return held.withColumn("_before", F.col("_eb")).drop(*names.values(), "_ep", "_eb")


def plan(docs: DataFrame, levels: list[str], weight: Callable[[tuple], float], budget_share: float, max_epochs: int, seed: int, id_col: str, tokens_col: str, work: Workspace) -> DataFrame:
    """One row for each leaf: ``levels``, ``whole`` (epochs taken whole), ``cut`` (last key of the next epoch, or null).

    Tokens are summed by leaf and by the first two digits of the key, then in the part in which the leaf's
    budget ends by the first four, so no task gathers a leaf and none runs over more than 256 parts of it;
    only the documents of the one part of four digits are ordered one by one.
    """
    spark = docs.sparkSession
    own = docs.select(*levels, F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long").alias("_tokens"))
    leaves = own.groupBy(*levels).agg(F.sum("_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    have = {tuple(r[c] for c in levels): int(r["n"]) for r in leaves}
    total = sum(have.values())
    got = budgets({p: float(n * max_epochs) for p, n in have.items()}, weight, budget_share * total)
    rows = []
    for p, n in have.items():
        want = min(int(got[p] + 0.5), n * max_epochs)
        whole = want // n if n else 0
        rows.append((*p, int(whole), int(want - whole * n)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*levels).schema)
    split = spark.createDataFrame(rows, f"{kinds}, whole int, rest long")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in levels]
    split = work.stage(split, "split")
    partial = own.join(small(split.filter("rest > 0").withColumnsRenamed({c: f"_s{k}" for k, c in enumerate(levels)}), 128), [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(levels)])
    keyed = partial.select(*levels, "_id", "_tokens", "rest", order_key(seed, F.col("whole"), F.col("_id")).alias("_key"))
    last = work.stage(keyed, "keyed").withColumn("_before", F.lit(0).cast("long"))
    for digits in (2, 4):
        last = _edge_part(last, levels, digits, work)
    run = Window.partitionBy(*levels).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_tokens").over(run), F.lit(0))).filter("_at < rest")
    cut = last.groupBy(*levels).agg(F.max("_key").alias("cut"))
    return work.stage(split.join(cut, same(split, cut), "left").select(*[split[c] for c in levels], "whole", "cut"), "plan")


def epochs_of(docs: DataFrame, chosen: DataFrame, levels: list[str], seed: int, id_col: str, leaf: list[Column] | None = None) -> DataFrame:
    """``docs`` with a row for each epoch in which a document is taken (``epoch``, from 0). No shuffle if leaves are few.

    ``leaf``: what the levels are for a row of ``docs``, where they are not its columns. Columns of ``docs``
    may have any names but ``epoch``, which is replaced.
    """
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    df = docs.select(*[docs[quoted(c)].alias(h) for c, h in names.items()], *[c.alias(f"_leaf{k}") for k, c in enumerate(leaf or [F.col(quoted(c)) for c in levels])])
    table = chosen.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(levels)], F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    joined = df.join(small(table, 128), [F.col(f"_leaf{k}").eqNullSafe(F.col(f"_p{k}")) for k in range(len(levels))])
    whole = F.when(F.col("_whole") > 0, F.sequence(F.lit(0), F.col("_whole") - 1)).otherwise(F.array().cast("array<int>"))
    also = order_key(seed, F.col("_whole"), F.col(names[id_col])) <= F.col("_cut")
    taken = joined.withColumn("_epoch", F.explode(F.when(also, F.array_append(whole, F.col("_whole"))).otherwise(whole)))
    return show(taken, {c: h for c, h in names.items() if c != "epoch"}, F.col("_epoch").alias("epoch"))


def mix(docs: DataFrame, levels: list[str], weight: Callable[[tuple], float], budget_share: float = 1.0, max_epochs: int = 2, seed: int = 11, id_col: str = "doc_id", tokens_col: str = "n_tokens") -> DataFrame:
    """``docs`` with a row for each epoch in which a document is taken, and ``epoch int``.

    The budget is ``budget_share`` of all tokens; a leaf gives its tokens ``max_epochs`` times at most. A
    leaf's budget is filled by whole epochs, then by documents in the seeded order of the next one, up to
    and with the document that reaches it; documents that share an id stand together there. All columns stay
    (an input column ``epoch`` is replaced), whatever their names. Null levels are a child of their own; null
    ids have one place; null tokens count 0. Repeated rows are taken alike. Documents of a leaf without tokens
    are not taken. Empty table: empty result.

    ``docs`` is read several times: write it first if its tokens are costly.
    """
    work = Workspace(docs.sparkSession, "mixing")
    df, names = hide(docs)
    own = [names[c] for c in levels]
    chosen = plan(df, own, weight, budget_share, max_epochs, seed, names[id_col], names[tokens_col], work)
    work.keep("plan")
    return epochs_of(docs, chosen.withColumnsRenamed(dict(zip(own, levels, strict=True))), levels, seed, id_col)


def weights(table: dict[str, dict[str, float]], levels: list[str]) -> Callable[[tuple], float]:
    """Weight of a node from a table by level and value; a value without an entry has weight 1."""

    def weight(path: tuple) -> float:
        return float(table.get(levels[len(path) - 1], {}).get(str(path[-1]), 1.0))

    return weight
