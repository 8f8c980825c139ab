"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A block holds the ids of consecutive documents:

    magic ``FRB1`` | n ids (u32) | n table entries (u32) | table (u32 each, most frequent id first)
    | control: one byte for four ids, two bits each, lowest first (bytes of the rank less one) | rank bytes

All numbers are little-endian. Blocks are the binary column of a Parquet table written by Spark's own
committer, so a lost task leaves no half-written file and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.textunits import balanced, encoder, tied_of

MAGIC = b"FRB1"
_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)
#: Bytes of each of the four ranks that a control byte speaks of.
_WIDTHS = ((np.arange(256, dtype=np.uint16)[:, None] >> _SHIFTS) & 3).astype(np.uint8) + 1


def encode_block(ids: np.ndarray) -> bytes:
    """The bytes of a block; ties of frequency go to the smaller id."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return MAGIC + np.zeros(2, "<u4").tobytes()
    if ids.max() < 1 << 22:  # count and rank by a table over the ids
        seen = np.bincount(ids)
        values = np.flatnonzero(seen)
        by_rank = values[np.argsort(-seen[values], kind="stable")]
        rank_of = np.zeros(len(seen), np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        ranks = rank_of[ids]
    else:
        values, inverse, seen = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")
        by_rank, place = values[order], np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ranks = place[inverse]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    wide = int(extra.max()) + 1
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    data = raw[np.arange(wide, dtype=np.uint8) <= extra[:, None]]
    return b"".join([MAGIC, np.array([n, len(by_rank)], "<u4").tobytes(), by_rank.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_block(block: bytes) -> np.ndarray:
    """The ids (uint32) of a block, by table look-ups over its control bytes."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, k = (int(x) for x in np.frombuffer(block, "<u4", 2, 4))
    table = np.frombuffer(block, "<u4", k, 12)
    at = 12 + 4 * k
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    width = _WIDTHS[control].reshape(-1)[:n]
    data = np.frombuffer(block, np.uint8, -1, at + len(control)) if n else np.zeros(0, np.uint8)
    end = np.cumsum(width, dtype=np.int64)
    begin = end - width
    rank = data[begin].astype(np.uint32)
    for b in (1, 2, 3):
        more = np.flatnonzero(width > b)
        if len(more):
            rank[more] |= data[begin[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return table[rank]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_ids: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every document, with ``end_id`` behind it, into blocks in ascending order of the id.

    Texts are dealt by ranges of the id (one shuffle), so shard ``k`` holds smaller ids than ``k + 1``.
    A block closes at ``block_ids`` ids and never splits a document. Null text counts as empty; null ids
    come first; documents that share an id lie together, ordered by the hash of their text, and may be dealt to
    several shards, equal ones too. Other columns are not carried. Empty table: no row.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])

    tied = tied_of(tokenizer_path)

    def write(batches):
        from pyspark import TaskContext

        enc, shard, block = encoder(tokenizer_path, tied=tied), TaskContext.get().partitionId(), 0
        arrow = schema_arrow(schema)
        doc_ids, lengths, parts, held = [], [], [], 0

        def row():
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "n_ids": len(ids), "doc_ids": doc_ids, "lengths": lengths, "data": encode_block(ids)}], schema=arrow)

        for b in batches:
            keys = b.column(0).to_pylist()
            for first, last in balanced(b.column(1), 8 << 20):
                ids, n = enc.encode(b.column(1).slice(first, last - first))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, np.uint32(end_id))
                if held and held + len(ids) > block_ids:
                    yield row()
                    doc_ids, lengths, parts, held, block = [], [], [], 0, block + 1
                doc_ids += keys[first:last]
                lengths += (n + 1).tolist()
                parts.append(ids)
                held += len(ids)
        if held:
            yield row()

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    # Ids that very many rows share (or lack) are parted by the text, and equal texts by their place in the input.
    rows = docs.select(F.col(id_col).alias("id"), text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "text")
    rows.mapInArrow(write, schema).write.option("compression", "none").parquet(path)


def schema_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before: totals of shards and of their blocks are summed
    (rows that number as the shards do), and each document adds its place within its block. A missing
    or damaged block raises an error.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    fields = [T.StructField(id_col, kind), T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def read(batches):
        arrow = schema_arrow(schema)
        for b in batches:
            for i in range(b.num_rows):
                shard, block, keys, lengths, data = (b.column(k)[i].as_py() for k in range(5))
                ids = decode_block(data).astype("<u4", copy=False)
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                if int(n.sum()) != len(ids):
                    raise ValueError(f"block {block} of shard {shard} is damaged")
                view = memoryview(ids).cast("B")
                own = [view[4 * s : 4 * e] for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, arrow.field(0).type), pa.array([shard] * len(n), pa.int32()), pa.array([block] * len(n), pa.int32()), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([bytes(x) for x in own], pa.binary())] * with_ids, schema=arrow)

    decoded = files.select("shard", "block", "doc_ids", "lengths", "data").mapInArrow(read, schema)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("at_shard"))
    blocks = files.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("at_block"))
    place = blocks.join(shards, "shard").select("shard", "block", (F.col("at_shard") + F.col("at_block")).alias("at"))
    out = decoded.join(place, ["shard", "block"])
    return out.select(id_col, (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
