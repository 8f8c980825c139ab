"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.textunits import balanced, encoder, released, tied_of

_VISIBLE_THEN_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f]) ")


def safe_pieces(text: str, size: int, special: tuple[str, ...] = ()) -> list[str]:
    """Cuts a long text before spaces that follow a visible character.

    No pre-token and no special string spans such a place, so the lengths of the pieces add up to the
    length of the text. Texts that hold a special string, and stretches without such a place, stay whole.
    """
    if len(text) <= size or any(s in text for s in special):
        return [text]
    out, begin = [], 0
    while len(text) - begin > size:
        m = _VISIBLE_THEN_SPACE.search(text, begin + size)
        if not m:
            break
        out.append(text[begin : m.start()])
        begin = m.start()
    out.append(text[begin:])
    return out


def token_lengths(texts: pa.Array, path: str, batch_bytes: int, piece_chars: int, frugal: bool = False, tied: str | None = None) -> np.ndarray:
    """Token count of each text, in batches balanced by bytes; texts over ``piece_chars`` go in pieces (under the known kinds of tokenizer)."""
    enc = encoder(path, frugal, tied)
    out = np.zeros(len(texts), np.int64)
    owner = np.arange(len(texts))
    longer = np.zeros(0, np.int64) if not enc.kind else np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) > piece_chars)
    if len(longer):
        cut = [[t] for t in texts.to_pylist()]
        for k in longer.tolist():
            cut[k] = safe_pieces(cut[k][0], piece_chars, tuple(enc.special))
        owner = np.repeat(owner, [len(c) for c in cut])
        texts = pa.array([p for c in cut for p in c], pa.string())
    for begin, end in balanced(texts, batch_bytes):
        np.add.at(out, owner[begin:end], enc.lengths(texts.slice(begin, end - begin)))
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, piece_chars: int = 1 << 18, also: tuple[str, ...] = (), frugal: bool = False) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``, and the columns ``also``.

    Only the id and the text leave the scan, and only lengths come back. No shuffle: one pass over the
    partitions of the scan. Null text: counted as empty (0 bytes, 0 tokens, not over). Null ids and
    repeated rows are returned as they are. Empty table: empty result. Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(f"_a{k}", docs.schema[c].dataType) for k, c in enumerate(also)]])

    tied = tied_of(tokenizer_path)

    def count(batches):
        for b in released(batches) if frugal else batches:
            n = token_lengths(b.column(2), tokenizer_path, min(batch_bytes, 1 << 20) if frugal else batch_bytes, piece_chars, frugal, tied)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *b.columns[3:]], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"), *[F.col(c).alias(f"_a{k}") for k, c in enumerate(also)])
    out = rows.mapInArrow(count, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *[F.col(f"_a{k}").alias(c) for k, c in enumerate(also)])
