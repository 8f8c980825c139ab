"""SimHash near-duplicates: fingerprints, pigeonring candidate search, components.

Two fingerprints that differ in at most ``max_bits`` bits are cut into ``max_bits + 1`` segments in a
ring. By the pigeonring principle some segment starts a chain whose first ``l`` segments differ in at
most ``l * max_bits / segments`` bits together, for every ``l``. The first two steps of that chain are a
key to search by (the first segment equal, the next with one bit left out); the later steps prune
candidates before the full Hamming check. No link is lost.

Few bits mean nearly equal texts: sets of shingles of similarity 0.8 differ in some ten bits of 64, and keys
for that many bits would be shared by a good part of all fingerprints. With ``least``, candidates meet by rare
shingles instead, chains over the bits prune them, and the similarity itself is checked (``neardup``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace, hide, show, small
from vecspark.llm.textunits import released

BITS = 64
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """Of 64 bits, those that are set in over half of the hashes (little-endian uint64)."""
    seen = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen += bits.sum(0, dtype=np.int32)
    on = np.packbits(2 * seen > len(hashes), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no word."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = np.array([digest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = np.concatenate([[0], ends[:-1]])[: n - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begins, stops, strict=True)), "<u8", len(begins))
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``_fp`` (the fingerprint's bits as a long). No shuffle."""
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).withColumn("_fp", F.lit(0).cast("long")).schema

    def make(batches):
        for b in released(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(make, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of ``max_bits + 1`` segments, the wider ones first."""
    m = max_bits + 1
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return list(zip(np.cumsum([0, *widths[:-1]]).tolist(), widths, strict=True))


def chain_masks(start: int, max_bits: int) -> list[tuple[int, int]]:
    """``(bits of the chain's first l segments, most differing bits)`` for ``l`` from 2 on."""
    parts = segments(max_bits)
    m, mask, out = len(parts), 0, []
    for k in range(m):
        first, width = parts[(start + k) % m]
        mask |= ((1 << width) - 1) << first
        if k:
            out.append((mask, (k + 1) * max_bits // m))
    return out


def ring_near(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which differences ``x`` (uint64) hold at most ``max_bits`` bits.

    The eight bytes lie in a ring. Only differences with a chain of bytes that keeps its budget
    (``l * max_bits / 8`` bits in ``l`` bytes) at every length up to seven come to the full check.
    """
    own = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)).astype(np.int32)
    at, total, good = np.arange(len(x)), own, 8 * own <= max_bits
    for length in range(2, 8):
        alive = good.any(1)
        at, own, total, good = at[alive], own[alive], total[alive], good[alive]
        total = total + np.roll(own, 1 - length, axis=1)
        good = good & (8 * total <= length * max_bits)
    at = at[good.any(1)]
    out = np.zeros(len(x), bool)
    out[at[np.bitwise_count(x[at]) <= max_bits]] = True
    return out


def keys_of(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(key, number in fp)``: for each start of a chain, its first segment and the next with one bit left out.

    With no bit to spare (``max_bits`` 0) the key is the fingerprint itself; with one, the next segment
    has no budget (2 * 1 // 2 = 1 bit), which the same keys cover.
    """
    if max_bits == 0:
        return fp.view(np.int64), np.arange(len(fp))
    parts, keys = segments(max_bits), []
    number, shift = 0, np.uint64(_key_bits(parts))
    for k, (first, width) in enumerate(parts):
        nxt, wide = parts[(k + 1) % len(parts)]
        own = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
        after = (fp >> np.uint64(nxt)) & np.uint64((1 << wide) - 1)
        for bit in range(wide):
            rest = after & ~np.uint64(1 << bit)
            keys.append((np.uint64(number) << shift) | (own << np.uint64(wide)) | rest)
            number += 1
    if (number - 1).bit_length() + int(shift) > 63:
        raise ValueError("max_bits is too small for a key of 63 bits")
    return np.concatenate(keys).view(np.int64), np.tile(np.arange(len(fp)), number)


def _key_bits(parts: list[tuple[int, int]]) -> int:
    return max(width + parts[(k + 1) % len(parts)][1] for k, (_, width) in enumerate(parts))


def start_of(key: int, max_bits: int) -> int:
    """The start of the chain that a key belongs to."""
    parts = segments(max_bits)
    number, start = key >> _key_bits(parts), 0
    while number >= parts[(start + 1) % len(parts)][1]:
        number -= parts[(start + 1) % len(parts)][1]
        start += 1
    return start


def stars(fp: np.ndarray, masks: list[tuple[int, int]], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one key, as ``(member, least member)`` of each linked set.

    Walks from a fingerprint to those within reach among the ones not yet met, so a dense set is met in
    a few steps and only as many rows as members come out.
    """
    left = np.sort(fp.view(np.int64))
    a, b = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            x = (left ^ todo.pop()).view(np.uint64)
            near = np.bitwise_count(x) <= max_bits
            for mask, most in masks:
                near[near] = np.bitwise_count(x[near] & np.uint64(mask)) <= most
            met = left[near]
            if len(met):
                left = left[~near]
                a.append(met)
                b.append(np.full(len(met), root))
                todo.extend(met)
    if not a:
        return left[:0], left[:0]
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, max_bits: int, work: Workspace, block: int = 1 << 16) -> DataFrame:
    """``(a, b)``: links that join the same fingerprints as all pairs within ``max_bits`` do.

    ``nodes``: one row for each different fingerprint (``_fp``). A key with more than ``block``
    fingerprints, as estimated from one in 64 of them, is dealt out: its members get a block number each,
    and every two blocks meet in a task of their own. The estimate only sets how work is dealt; the
    links are the same for any.
    """
    spark = nodes.sparkSession

    def keyed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, at = keys_of(fp, max_bits)
            for k in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(fp.view(np.int64)[at[k : k + (1 << 16)]])], names=["key", "fp"])

    keys = nodes.select("_fp").mapInArrow(keyed, "key long, fp long")
    taste = nodes.filter(F.pmod(F.xxhash64("_fp"), F.lit(64)) == 0).select("_fp").mapInArrow(keyed, "key long, fp long")
    hot = taste.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block // 64)
    hot = work.stage(hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") * 64 / block).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        dealt = keys.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    else:
        dealt = keys.join(small(hot, 24), keys["key"] == hot["hot"], "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        dealt = dealt.select("key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def linked(batches):
        rest = [np.zeros(0, np.int64)] * 4
        for b in batches:
            yield from one([np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)]) for r, c in zip(rest, b.columns, strict=True)], rest)
        yield from one(rest, None)

    def one(cols, rest):
        """Links of the groups that end in ``cols``; the last group is kept in ``rest``, as more of it may come."""
        key, fp, x, y = cols
        if not len(key):
            return
        cut = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        if rest is not None:
            rest[:] = [c[begin[-1] :] for c in cols]
            begin, end = begin[:-1], end[:-1]
        size = end - begin
        out = []
        two = begin[size == 2]  # most groups with a candidate: checked together, in full
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits]
        out.append((np.maximum(fp[near], fp[near + 1]), np.minimum(fp[near], fp[near + 1])))
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            masks = chain_masks(start_of(int(key[s]), max_bits), max_bits) if max_bits else []
            out.append(stars(fp[s:e], masks, max_bits))
        a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "fp", "x", "y").mapInArrow(linked, "a long, b long")
    return work.stage(found.distinct(), "links")


def components(edges: DataFrame, work: Workspace, rounds: int = 100) -> DataFrame:
    """``(node, root)``: the least node reachable from each node of an edge ``(a, b)``.

    Every round takes the least root among the neighbours and then the root's root; each is a join and a
    combined minimum, written to the shared folder. A hub's rows are one hot key of a join, which adaptive
    execution splits.
    """
    both = work.stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "both")
    state = work.stage(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "roots0")
    for k in range(1, rounds + 1):
        near = both.join(state, both["v"] == state["node"]).groupBy("u").agg(F.min("root").alias("near"))
        step = work.stage(state.join(near, state["node"] == near["u"], "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"step{k}")
        up = step.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = work.stage(step.join(up, step["root"] == up["r"]).select("node", "old", F.col("up").alias("root")), f"roots{k}")
        work.drop(f"step{k}")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return new.select("node", "root")
        work.drop(f"roots{k - 1}")
        state = new.select("node", "root")
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", roots: bool = False, least: float | None = None) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every document; with ``roots`` also what ``one_of_each`` asks for.

    With ``least``, documents are linked whose sets of shingles have that Jaccard similarity or more, instead
    of by ``max_bits``; the fingerprint is then that of the set.

    Words are runs of other than ASCII white space, A-Z lowered; shingles of ``shingle`` words with
    repeats (a shorter text is one shingle; without a word, or null, the fingerprint is zero). Documents
    whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id`` is the smallest id
    reachable. Null ids are smallest only where a component has no other. Repeated rows are returned as
    they are. Empty table: empty result.

    Equal fingerprints are one node, so a group of copies costs one row from there on. ``roots`` adds
    ``_th``, the hash of the text, and ``_root``, the component: ids may be null or shared, so that an id
    need not name one component.
    """
    if least is not None:
        from vecspark.llm import neardup

        held = neardup.near_duplicates(docs, shingle, least, id_col, text_col)
        return held if roots else held.drop("_th", "_root")
    work = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if roots:
        rows = rows.withColumn("_th", F.xxhash64("_text"))
    held = work.stage(fingerprints(rows, shingle, "_text"), "fingerprints")
    nodes = work.stage(held.groupBy("_fp").agg(F.min("_id").alias("_least")), "nodes")
    found = components(links(nodes, max_bits, work), work)
    rooted = nodes.join(found, nodes["_fp"] == found["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = work.stage(rooted.join(least, "_root").select(F.col("_fp").alias("_f"), "component_id", *["_root"] * roots), "components")
    work.keep("fingerprints", "components")
    return held.join(named, F.col("_fp") == F.col("_f")).select(F.col("_id").alias(id_col), hexed(F.col("_fp")).alias("fingerprint"), "component_id", *["_th", "_root"] * roots)


def hexed(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one whose id is the component's; of rows that share that id, the least text.

    ``groups`` has ``_th`` and ``_root`` (``near_duplicates`` with ``roots``), which tell apart components
    whose smallest ids are equal or null. Columns of ``docs`` may have any names.
    """
    df, names = hide(docs)
    id_, text = F.col(names[id_col]), F.col(names[text_col])
    named = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    work = Workspace(docs.sparkSession, "keep")
    keep = named.groupBy("_root", F.col(id_col).alias("_keep"), F.col("_th").alias("_kt")).agg(F.count("*").alias("_rows"))
    rows = keep.groupBy("_root").agg(F.sum("_rows").alias("_rows"), F.first("_keep").alias("_keep"), F.first("_kt").alias("_kt"))
    single = work.stage(rows.filter("_rows = 1"), "single")
    own = id_.eqNullSafe(F.col("_keep")) & (F.xxhash64(text) == F.col("_kt"))
    alone = df.join(small(single, 40), own, "left_semi")
    more = rows.filter("_rows > 1").select(F.col("_root").alias("_r"))
    shared = work.stage(keep.join(more, F.col("_root").eqNullSafe(F.col("_r")), "left_semi").drop("_rows"), "shared")
    if shared.isEmpty():
        return show(alone, names)
    # Only rows that share an id and a component are sorted by text.
    first = Window.partitionBy("_root").orderBy(text)
    several = df.join(small(shared, 40), own).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return show(alone.unionByName(several.select(*df.columns)), names)
