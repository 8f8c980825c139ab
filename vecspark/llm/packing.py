"""Best-fit packing by minimum bin slack.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers, whatever
the input), so it is made on the driver; pieces are then dealt to planned places by their rank within
their length, which is counted in two levels so that no task gathers a length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.shared import Workspace, hide, quoted, show, small
from vecspark.llm.textunits import balanced, encoder, released, tied_of


def fullest(counts: dict[int, int], order: list[int], gap: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``gap``.

    ``order``: the lengths, longest first. Bit ``s`` of the state says that the sum ``s`` can be had;
    multiples of a length are added in powers of two. Ends early once ``gap`` itself can be had.
    """
    state, steps, mask = 1, [], (1 << (gap + 1)) - 1
    for length in order:
        left = min(counts[length], gap // length)
        k = 1
        while left > 0:
            k = min(k, left)
            steps.append((state, length, k))
            state |= (state << (k * length)) & mask
            left -= k
            k *= 2
        if state >> gap & 1:
            break
    at, used = state.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(bins, {length: pieces in each})`` by minimum bin slack.

    Each bin starts with the longest piece left; bitset subset-sum finds what fills the rest best. A
    combination is repeated as often as the pieces last, so the work is bounded by the number of
    different lengths and does not grow with the number of pieces.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    order, plan = sorted(counts, reverse=True), []
    while order:
        first = order[0]
        counts[first] -= 1
        gap = capacity - first
        used = fullest(counts, [k for k in order if k <= gap and counts[k]], gap) if gap else {}
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        bins = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= bins * n
        plan.append((bins, used))
        order = [k for k in order if counts[k]]
    return plan


def runs_of(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: pieces with ranks from ``rank`` on go to bins from ``bin`` on, ``per_bin`` to each, from ``offset``."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for bins, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), first, n, offset))
            taken[length] = taken.get(length, 0) + bins * n
            offset += n * length
        first += bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "per_bin", "offset"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", work: Workspace | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (both long) to every row of ``pieces``.

    Pieces of a sequence lie gapless from offset 0 and fill at most ``capacity``. All columns are kept,
    whatever their names (those named as the two new ones are replaced); the input is written once to the
    shared folder, so that ranks and rows come from the same files. Lengths must be 1..``capacity`` (null or
    other lengths: an error, as they have no place). Equal rows each get their own place, and pieces of equal
    length any of theirs. Empty input: empty result.
    """
    spark = pieces.sparkSession
    work = work or Workspace(spark, "packing")
    stay = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces, names = hide(pieces.select(*[pieces[quoted(c)] for c in stay]))
    label, length_col = length_col, names[length_col]
    held = work.stage(pieces.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    by_part = work.stage(held.groupBy(F.col(length_col).alias("_length"), "_part").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in by_part.groupBy("_length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    if None in histogram:
        raise ValueError(f"{label} must not be null")
    runs = runs_of(plan_bins(histogram, capacity), capacity)
    # The table of runs is bounded by the number of different lengths, as the plan is.
    starts = np.searchsorted(runs["length"], np.arange(capacity + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        wide = np.int64(1) << 40
        at = np.searchsorted(runs["length"] * wide + runs["rank"], n * wide + r, side="right") - 1
        assert len(n) == 0 or (at >= starts[n]).all()
        k = r - runs["rank"][at]
        return pd.DataFrame({"sequence_id": runs["bin"][at] + k // runs["per_bin"][at], "offset": runs["offset"][at] + k % runs["per_bin"][at] * n})

    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = work.stage(by_part.select("_length", F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "base")
    work.drop("lengths")
    own = Window.partitionBy("_part", length_col).orderBy("_row")
    ranked = held.withColumn("_rank", F.row_number().over(own) - 1)
    joined = ranked.join(small(base, 24), (F.col("_part") == F.col("_p")) & (F.col(length_col) == F.col("_length")))
    placed = joined.withColumn("_place", place(F.col(length_col).cast("long"), F.col("_base") + F.col("_rank")))
    return show(placed, names, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", frugal: bool = False) -> DataFrame:
    """Every document's ids (with ``end_id`` behind them), cut into pieces of at most ``capacity``.

    ``(id, piece int, start long, length long, ids binary)``; ``ids`` are little-endian unsigned 32-bit.
    Null text counts as empty: such a document is one piece that holds ``end_id``. Null ids and repeated
    rows are kept, other columns are not carried. Empty table: empty result. No shuffle.
    """
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    tied = tied_of(tokenizer_path)

    def cut(batches):
        enc = encoder(tokenizer_path, frugal, tied)
        for b in released(batches) if frugal else batches:
            for first, last in balanced(b.column(1), (1 if frugal else 4) << 20):
                ids, n = enc.encode(b.column(1).slice(first, last - first))
                ends = np.cumsum(n)
                rows, piece, start, length, data = [], [], [], [], []
                for k, begin, end in zip(range(first, last), ends - n, ends, strict=True):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4", copy=False)
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        data.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], names=schema.names)

    pieces = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(cut, schema)
    return pieces.withColumnRenamed("_id", id_col)
